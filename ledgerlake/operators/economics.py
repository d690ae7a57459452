"""Pricing, settlement, staking and rewards (ECO, STK, RWD)."""

_PRICE = "case service_type when 'BlockRetrieval' then 100 + 10 * kb when 'AccountInfo' then 100 + kb when 'TransactionSubmission' then 100 + 2 * kb else 100 + kb end"
_KB = "select *, 1 + amount % 64 as kb from {payments} p"
_LOAD = "select payment_id, service_type, kb, (amount % 101) / 1e2 as load from (" + _KB + ") k"
_SCORE = """select node_id, staked_amount, least(2e0, greatest(0e0, 3e-1 * least(1e0, performance_score / 2e2) + 2e-1 * case when avg_response_time = 0 then 1e0 else 1000 / dbl(greatest(avg_response_time, 100)) end
    + 2e-1 * (used / dbl(capacity)) + 15e-2 + 1e-1 * least(1e0, used / 1e6) + 5e-2 * least(1e0, capacity / 1e9))) as score from {nodes} n"""

SQL = {
    "eco1_client_price": f"select payment_id, service_type, {_PRICE} as price from ({_KB}) k",
    "eco2_gateway_price": "select payment_id, whole(base * case when load > 8e-1 then 1 + (load - 8e-1) * 2 else 1e0 end) as price from (select *, case service_type when 'BlockRetrieval' then 100 + 10 * kb when 'AccountInfo' then 100 + kb else 100 end as base from (" + _LOAD + ") l) t",
    # a point is a payment; its rate is the number of its gateway's payments in the minute up to it
    "eco3_load": """select gateway_id, ts_s, r6(least(1e0, sum(n * rate) over w / dbl(sum(n) over w) / 1e2)) as load from (select gateway_id, ts_s, n, big(sum(n) over (partition by gateway_id order by ts_s range between 59 preceding and current row)) as rate
        from (select gateway_id, ts_s, count(*) as n from {payments} p group by gateway_id, ts_s) t) r window w as (partition by gateway_id order by ts_s range between 299 preceding and current row)""",
    "eco4_revenue_split": "select payment_id, amount, idiv(amount * 95, 100) as gateway_share, amount - idiv(amount * 95, 100) as network_share from {payments} p",
    "eco5_settlement": "select gateway_id, idiv(ts_s, 604800) as batch, count(*) as payments, big(sum(amount - idiv(amount * 95, 100))) as fees from {payments} p where confirmed group by gateway_id, idiv(ts_s, 604800)",
    "eco6_payment_channel": "select payment_id, idiv(amount, 10) as stake, ts_s + 86400 as expires_s from {payments} p",
    "eco8_size_fee": "select payment_id, whole((100 + 50 * kb) * case when amount % 2 = 0 then 15e-1 else 1e0 end) as fee from (" + _KB + ") k",
    "eco8_volume_discount": "select client_id, n, big(100 * case when n >= 30 then 75 when n >= 15 then 90 else 100 end / 100) as price from (select client_id, count(*) as n from {payments} p group by client_id) c",
    "eco8_surge": "select payment_id, r6(case when load <= 5e-1 then 1e0 else 1 + (load - 5e-1) * 2 end) as surge from (" + _LOAD + ") l",
    "eco8_batch_discount": "select client_id, n, n * 100 - idiv(n * 100 * least(25, 5 * n), 100) as price from (select client_id, count(*) as n from {payments} p group by client_id) c",
    "eco9_estimate": "select payment_id, whole(whole(100 * (1 + load)) * case payment_id % 3 when 0 then 15e-1 when 1 then 1e0 else 8e-1 end) as estimate from (" + _LOAD + ") l",
    # errors take stake out, other events of the minimum or more put it in its place; what the last of these leaves is drawn down in order
    "stk1_stake_ledger": """select node_id, staked from (select s.node_id, drawn(u.event_id, u.event_id, u.amount, s.staked) as staked from (select user_id as node_id, max_by(amount, event_id) as staked, max(event_id) as since from {ledger} l where event_type <> 'error' and amount >= 10 group by user_id) s
        left join (select * from {ledger} l where event_type = 'error') u on u.user_id = s.node_id and u.event_id > s.since group by s.node_id, s.staked) t where staked > 0""",
    "stk2_pending_rewards": "select node_id, whole(whole(staked_amount / 1000000 * 8e-2) * (stake_seconds / 315576e2) * (performance_score / 1e2)) as pending from {nodes} n",
    "stk3_slashing": "select node_id, severity, whole(round(staked_amount / 1000 * case severity when 0 then 5e-2 when 1 then 15e-2 when 2 then 3e-1 else 5e-1 end, 3)) as slashed from (select *, node_id % 4 as severity from {nodes} n) t",
    "rwd1_performance_score": f"select node_id, r6(score) as score from ({_SCORE}) s",
    "rwd2_epoch_reward": f"""select node_id, whole(1000000e0 * round(score * staked_amount / 1e12, 6) / total) as reward from ({_SCORE}) s cross join (select sum(round(score * staked_amount / 1e12, 6)) as total from ({_SCORE}) t) u""",
    "rwd3_chain_reward": """select node_id, idiv(idiv(cast(floor(1000000000 * (cast(staked_amount / 1000000000 as bigint)) / dbl(total)) as bigint) * performance_score, 100) * multiplier, 100) as reward from (select node_id, staked_amount, performance_score,
        case when staked_amount >= 1000000000000000 then 200 when staked_amount >= 100000000000000 then 150 when staked_amount >= 10000000000000 then 120 else 100 end as multiplier from {nodes} n) t
        cross join (select big(sum(cast(staked_amount / 1000000000 as bigint))) as total from {nodes} n) s""",
    "rwd4_epoch_advance": """select epoch, paid, greatest(0, 100000000 - paid) as remaining, fees from (select idiv(ts_s, 86400) as epoch, big(sum(idiv(amount * 95, 100))) as paid, big(sum(amount - idiv(amount * 95, 100))) as fees from {payments} p where confirmed group by idiv(ts_s, 86400)) t""",
    "rwd4_fee_records": "select gateway_id, count(*) as n, big(sum(amount - idiv(amount * 95, 100))) as fees, max(ts_s) as last_s from {payments} p where confirmed group by gateway_id",
    "sup36_reward_inputs": "select node_id, max_by(messages_total, ts_s * 1000000 + seq) as messages, max(ts_s) as last_s from {snapshots} s group by node_id",
}
