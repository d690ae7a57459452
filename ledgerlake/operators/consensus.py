"""Consensus, votes and reputation (CON), governance (PRG)."""

_TALLY = "select proposal_id, nif(choice = 'Accept') as accepts, nif(choice = 'Reject') as rejects, nif(choice = 'Abstain') as abstains, count(*) as n from {first_votes} f group by proposal_id"

SQL = {
    "con1_proposal_lifecycle": """select proposal_id, first_s, case when now_s > first_s + 60 then 'TimedOut' else 'Open' end as state from (select proposal_id, min(epoch_s(ts)) as first_s from {votes} v group by proposal_id) p
        cross join (select max(epoch_s(ts)) as now_s from {votes} v) t""",
    "con2_completion": "select proposal_id, accepted, total, accepted * 100 >= total * 67 as complete from (select proposal_id, big(sum(case when choice = 'Accept' then power else 0 end)) as accepted, big(sum(power)) as total from {first_votes} f group by proposal_id) t",
    "con3_tally": f"""select proposal_id, accepts, rejects, abstains, idiv(2 * n, 3) + 1 as quorum, case when accepts >= idiv(2 * n, 3) + 1 then 'Accepted' when rejects >= idiv(2 * n, 3) + 1 then 'Rejected' else 'Pending' end as decision from ({_TALLY}) t""",
    "con4_parameter_changes": """select parameter, max_by(value, seq) as value from (select case event_type when 'click' then 'level' when 'view' then 'multiplier' else 'replicas' end as parameter, event_id as seq, big(json_at(props, k)) as value from {events} e) c
        where value between 1 and case parameter when 'level' then 22 when 'multiplier' then 10 else 99 end group by parameter""",
    "con7_vote_signature": "select proposal_id, voter_id, substr(concat('sig_', sha(concat(text_of(voter_id), ':', text_of(proposal_id), ':', choice))), 1, 32) as signature from {first_votes} f",
    "sup27_remote_votes": "select proposal_id, voter_id, choice from (select *, row_number() over (partition by proposal_id, voter_id order by ts desc, l_orderkey desc, l_linenumber desc, l_partkey desc, choice, power) as rn from {votes} v) t where rn = 1",
    "prg1_stake_tiers": """select node_id, staked_amount, case when staked_amount >= 1000000000000000 then 'Platinum' when staked_amount >= 100000000000000 then 'Gold' when staked_amount >= 10000000000000 then 'Silver' else 'Bronze' end as tier,
        case when staked_amount >= 1000000000000000 then 200 when staked_amount >= 100000000000000 then 150 when staked_amount >= 10000000000000 then 120 else 100 end as multiplier from {nodes} n""",
    "prg3_emission_allowance": """select day, minted from (select day, whole(case when day < 365 then 1e17 * day / 365 when day < 730 then 1e17 + 8e16 * (day - 365) / 365 when day < 1095 then 18e16 + 6e16 * (day - 730) / 365
        else least(1e18, 24e16 + 4e16 * (day - 1095) / 365) end / 1e9) as minted from series(0, 3650, day) d) t""",
    "prg4_proposal_thresholds": """select p.proposal_id, t.kind, t.quorum, t.approval, p.stake >= 10000000000000 as may_create from (select proposal_id, proposal_id % 3 as k, max(n.staked_amount) as stake from {votes} v join {nodes} n on v.voter_id = n.node_id group by proposal_id) p
        join (select 0 as k, 'Parameter' as kind, 10 as quorum, 51 as approval union all select 1, 'Treasury', 15, 60 union all select 2, 'Upgrade', 20, 67) t on p.k = t.k""",
    "prg5_voting_power": """select f.proposal_id, f.voter_id, idiv(n.staked_amount, 100) * case when n.stake_seconds < 7776000 then 100 when n.stake_seconds < 15552000 then 125 when n.stake_seconds < 31104000 then 150 else 200 end as voting_power
        from {first_votes} f join {nodes} n on f.voter_id = n.node_id""",
    "prg6_finalize": """select proposal_id, yes, no, case when yes + no = 0 then 0 else idiv(100 * yes, yes + no) end as percent, case when voted * 100 >= snapshot * 20 and yes + no > 0 and idiv(100 * yes, yes + no) >= 51 then 'Succeeded' else 'Defeated' end as outcome
        from (select f.proposal_id, big(sum(case when f.choice = 'Accept' then n.stake else 0 end)) as yes, big(sum(case when f.choice = 'Reject' then n.stake else 0 end)) as no, big(sum(n.stake)) as voted
        from {first_votes} f join (select node_id, idiv(staked_amount, 1000000000) as stake from {nodes} n) n on f.voter_id = n.node_id group by f.proposal_id) t
        cross join (select big(sum(idiv(staked_amount, 1000000000))) as snapshot from {nodes} n) s""",
    "prg7_timelock": """select proposal_id, state, eta_s, case when state = 'Succeeded' and now_s >= eta_s then 'Executed' when state = 'Succeeded' then 'Queued' else 'Cancelled' end as final from (select proposal_id, case when accepts > rejects then 'Succeeded' else 'Defeated' end as state, last_s + 172800 as eta_s
        from (select proposal_id, nif(choice = 'Accept') as accepts, nif(choice = 'Reject') as rejects, max(epoch_s(ts)) as last_s from {first_votes} f group by proposal_id) a) t cross join (select max(epoch_s(ts)) as now_s from {votes} v) w""",
    "prg9_stake_snapshot": "select p.proposal_id, big(sum(case when n.node_id <= p.proposal_id then n.staked_amount else 0 end)) as snapshot from (select distinct proposal_id from {votes} v) p cross join {nodes} n group by p.proposal_id",
}
