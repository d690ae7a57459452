"""Joins, top-k, placement and routing (JON, TOP), network reads and writes (NET)."""

# XOR of two hashes by their first 13 hex digits, which a long holds
_XOR = "(hex_int(substr(sha(text_of({a})), 1, 13)) {op} hex_int(substr(sha(text_of({b})), 1, 13)))"

SQL = {
    "jon1_metrics_stakes": "select n.node_id, n.staked_amount, m.events, m.value from {nodes} n join (select user_id, count(*) as events, r6(sum(value)) as value from {events} e group by user_id) m on n.node_id = m.user_id",
    "jon2_replica_peers": "select r.slot, r.node_id, n.zone from {replicas} r join {nodes} n on r.node_id = n.node_id",
    "jon3_snapshot_stake": "select s.node_id, s.messages, coalesce(n.staked_amount, 0) as stake from (select node_id, max(messages_total) as messages from {snapshots} s group by node_id) s left join {nodes} n on s.node_id = n.node_id",
    "jon4_proposal_verification": """select b.slot, coalesce(bool_or(v.choice = 'Accept'), false) as verified from {blocks} b left join {votes} v on b.slot = v.proposal_id group by b.slot""",
    "jon5_preferred_gateway": """select p.client_id, coalesce(min_by(p.gateway_id, p.payment_id), min(n.node_id)) as gateway from {payments} p left join {nodes} n on p.gateway_id = n.node_id group by p.client_id""",
    "jon7_under_replicated": "select slot, count(*) as copies from {replicas} r group by slot having count(*) < 3 order by copies, slot limit 5",
    "top1_replica_placement": "select node_id, available from (select node_id, capacity - used as available from {nodes} n) t where available > 0 order by available desc, node_id limit 3",
    "top4_gateway_choice": """select min_by(node_id, fee * 1000000 + node_id) as cheapest, min_by(node_id, avg_response_time * 1000000 + node_id) as fastest, min_by(node_id, (fee + 2 * avg_response_time) * 1000000 + node_id) as balanced
        from (select node_id, avg_response_time, 100 + node_id % 50 as fee from {nodes} n) t""",
    "top5_eviction": "select slot, ts_s from (select slot, block_time as ts_s, row_number() over (order by block_time, slot) as rn, count(*) over () as n from {blocks} b) t where rn <= idiv(n, 4)",
    "top7_replication_policy": "select slot, count(*) as copies, count(*) >= 2 as readable, count(*) < 3 as under_replicated from {replicas} r group by slot",
    "net2_write_path": "select b.slot, b.size_bytes, b.block_hash, sha(concat(b.block_hash, ':', text_of(b.slot))) as metadata_key from {blocks} b where b.size_bytes between 1 and 50000000",
    "net3_location_lists": "select slot, count(*) as n, listed(node_id) as nodes from {replicas} r group by slot",
    "net5_stale_peers": """select node_id, now_s - last_s >= 900 as stale, now_s - last_s >= 3600 as republish from (select node_id, max(ts_s) as last_s from {snapshots} s group by node_id) p
        cross join (select max(ts_s) as now_s from {snapshots} s) t""",
    "net6_heartbeat_status": """select node_id, case when now_s - last_s > 30 then 'Disconnected' else 'Connected' end as status from (select node_id, max(ts_s) as last_s from {snapshots} s group by node_id) p
        cross join (select max(ts_s) as now_s from {snapshots} s) t""",
    "net7_peer_prune": "select r.node_id, r.reputation from {reputations} r join (select node_id, max_by(event_type, seq) as last from {evidence} e group by node_id) t on r.node_id = t.node_id where t.last <> 'error'",
    "net1_read_decision": """select a.seq, a.slot, case when b.slot is not null and a.slot % 2 = 0 then 'local' when r.copies > 0 then 'peer' else 'miss' end as source from {access_log} a left join {blocks} b on a.slot = b.slot
        left join (select slot, count(*) as copies from {replicas} r group by slot) r on a.slot = r.slot""",
    "net4_find_value": "select q.slot, r.node_id from (select distinct slot from {access_log} a) q join {replicas} r on q.slot = r.slot",
    "sup28_peer_keys": "select node_id, concat('pubkey_', substr(sha(text_of(node_id)), 1, 16)) as public_key from {nodes} n",
}

SQL |= {
    "snk2_push_series": "select idiv(ts_s, 60) * 60 as tick_s, count(*) as messages, max(messages_total) as top from {snapshots} s group by idiv(ts_s, 60) * 60",
    "sta8_timeouts": """select payment_id, ts_s + 60 as proposal_at, ts_s + 900 as peer_at, ts_s + 86400 as channel_at, ts_s + 1209600 as unbonding_at from {payments} p""",
    "sta9_periodic_ticks": "select gateway_id, idiv(ts_s, 300) as tick, count(*) as n from {payments} p group by gateway_id, idiv(ts_s, 300)",
    "sup31_client_requests": """select client_id, payment_id, amount, big(sum(amount) over (partition by client_id order by ts_s, payment_id rows between unbounded preceding and current row)) as spent from {payments} p where confirmed""",
    # fixed values: 300 samples of a node, 1000 latencies of an operation, 100 results of a strategy, 10 keys of a client
    "sta7_ring_buffers": """select ring, member, seq, big(age) as age from (select 'samples' as ring, text_of(node_id) as member, seq, row_number() over (partition by node_id order by seq desc) as age, 300 as size from {snapshots} s
        union all select 'latencies', op, seq, row_number() over (partition by op order by seq desc), 1000 from {latency} l
        union all select 'results', strategy, seq, row_number() over (partition by strategy order by seq desc), 100 from {results} r
        union all select 'keys', text_of(client_id), seq, row_number() over (partition by client_id order by seq desc), 10 from {access_log} a) t where age <= size""",
    # templates below 1000 are built in, others are the commonest data; the longest that data begins with is its template
    "sup8_template_lookup": """select data, template, template < 1000 as built_in from (select d.data, t.template, row_number() over (partition by d.data order by nbytes(t.prefix) desc, t.template) as best from (select distinct data, substr(data, 1, 2) as head from {instructions} i where length(data) >= 2) d
        join (select template, prefix, substr(prefix, 1, 2) as head from (select 1 as template, 'con' as prefix union all select 2, 'pre' union all select 3, 'un' union all select 4, 'over'
        union all select whole(1000 + c.rank), c.data from (select data, row_number() over (order by n desc, data) as rank from (select data, count(*) as n from {instructions} i where length(data) >= 3 group by data order by n desc, data limit 100) l) c) p) t
        on d.head = t.head and substr(d.data, 1, length(t.prefix)) = t.prefix) m where best = 1""",
}
