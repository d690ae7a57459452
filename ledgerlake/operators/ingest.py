"""Sources, scans and sinks (SRC, SNK) and point operations on stores (SUP)."""

SQL = {
    "src1_fetch_block": "select slot, size_bytes, transaction_count, block_time, block_hash, parent_slot from {blocks} b",
    "src2_client_stats": "select count(*) as blocks, big(sum(size_bytes)) as bytes, r6(avg(size_bytes)) as average_bytes from {blocks} b",
    "src3_range_scan": "select slot, size_bytes, block_hash from {blocks} b where slot between 100 and 300",
    "src3_range_gaps": "select s.slot from series(0, 2000, slot) s anti join {blocks} b on s.slot = b.slot",
    "src4_recent_blocks": "select slot, block_time from {blocks} b where slot >= (select max(slot) - 10 from {blocks} c)",
    "src5_latest_slot": "select max(slot) as latest from {blocks} b",
    "src6_block_exists": "select distinct a.slot from {access_log} a semi join {blocks} b on a.slot = b.slot",
    "src7_high_activity": "select slot, transaction_count from {blocks} b where slot between 0 and 900 and transaction_count >= 500 order by slot limit 10",
    "src8_stratified_sample": """select stratum, slot from (select stratum, slot, row_number() over (partition by stratum order by slot) as rn from
        (select slot, case when transaction_count < 100 then 'Small' when transaction_count > 1000 then 'HighVolume' when size_bytes > 10000 then 'Large' else 'Mixed' end as stratum from {blocks} b) c) d
        where rn <= 3""",
    "src10_block_store": """select count(*) as stored, big(sum(size_bytes)) as used_bytes from (select slot, size_bytes from {blocks} b where slot % 2 = 0
        union all select n.slot, n.size_bytes from {blocks} n anti join (select slot from {blocks} b where slot % 2 = 0) i on n.slot = i.slot) s""",
    "src11_kv_categories": """select category, count(*) as entries, big(sum(size)) as bytes from (select case slot % 4 when 0 then 'blocks' when 1 then 'metadata' when 2 then 'cache' else 'index' end as category,
        size_bytes as size from {blocks} b) k group by category""",
    "src13_rpc_decode": """select id, json_at(body, method) as method, big(json_at(body, params[0])) as slot from
        (select id, concat('{"method":"', method, '","params":[', text_of(param), ']}') as body from {requests} r) q""",
    "src16_method_router": """select r.id, r.method, case when r.method in ('getBlock', 'getConfirmedBlock') then case when b.slot is null then 'error' else 'block' end
        when r.method = 'getSlot' then 'slot' when r.method = 'getHealth' then 'ok' when r.method = 'getVersion' then 'version' else 'message' end as outcome, b.block_hash
        from {requests} r left join {blocks} b on r.param = b.slot and r.method in ('getBlock', 'getConfirmedBlock')""",
    "snk1_rest_snapshot": "select node_id, concat('{\"node_id\":', text_of(node_id), ',\"capacity\":', text_of(capacity), ',\"used\":', text_of(used), '}') as body from {nodes} n",
    "snk3_counters": "select method, count(*) as requests, nif(param > 50) as historical from {requests} r group by method",
    "snk5_cost_analysis": "select count(*) as blocks, r6(count(*) / 1e6) as terabytes, r6(count(*) / 1e6 * 23e0) as archive_cost, r6(count(*) / 1e6 * 23e0 * 1e-1) as network_cost from {blocks} b",
    "set2_concat_strata": """select 'small' as stratum, slot from {blocks} b where transaction_count < 100 union all select 'large' as stratum, slot from {blocks} b where size_bytes > 10000
        union all select 'high' as stratum, slot from {blocks} b where transaction_count > 1000""",
    "top6_range_listing": "select slot from {blocks} b where slot >= 50 and slot < 150 order by slot",
    "sup1_kv_get": """select k, seq, size_bytes from (select slot as k, seq, size_bytes, ts_s, row_number() over (partition by slot order by ts_s desc, seq desc) as rn from {access_log} a) l
        where rn = 1 and not (select max(ts_s) from {access_log} b) > ts_s + 86400""",
    "sup2_usage_accounting": "select big(sum(case when seq % 3 = 0 then -size_bytes else size_bytes end)) as usage from {access_log} a",
    "sup3_read_path": "select a.seq, a.slot, b.block_hash, case when b.slot is null then 'missing' else 'file' end as served from {access_log} a left join {blocks} b on a.slot = b.slot",
    "sup4_capacity_admit": "select node_id, capacity - used as available, used + 900000000 <= capacity as admits from {nodes} n",
    "sup5_node_registry": "select node_id, zone, capacity, used from {nodes} n",
    "sup6_dictionary_lookup": """select i.slot, d.idx, count(*) as refs from {instructions} i join (select program, big(19 + row_number() over (order by program)) as idx
        from (select distinct program from {instructions} j) p) d on i.program = d.program group by i.slot, d.idx""",
    "sup26_consensus_lookup": "select b.slot from {blocks} b semi join (select proposal_id from {votes} v where choice = 'Accept') p on b.slot = p.proposal_id",
    "sup30_paid_requests": """select payment_id, gateway_id, amount, case service_type when 'BlockRetrieval' then 100 + 10 * (amount % 64) when 'AccountInfo' then 100 + amount % 64 else 100 end as price
        from {payments} p where amount <> 0 and confirmed""",
    "sup34_slot_ratio": "select r.seq as slot, t.ratio from {results} r cross join (select r6(sum(original) / sum(compressed)) as ratio from {results} s) t",
    "sup37_stake_info": """select node_id, staked_amount, case when staked_amount >= 1000000000000000 then 'Platinum' when staked_amount >= 100000000000000 then 'Gold'
        when staked_amount >= 10000000000000 then 'Silver' else 'Bronze' end as tier, performance_score from {nodes} n""",
    "sup38_genesis": "select big(1000000000000000000) as max_supply, big(9) as decimals, big(1000000000000) as minimum_stake, big(1209600) as unbonding_seconds, big(86400) as epoch_seconds",
    "sup39_cached_high_activity": """select h.slot, coalesce(c.n, 0) as cached from (select slot from {blocks} b where transaction_count >= 500) h
        left join (select slot, count(*) as n from {access_log} a group by slot) c on h.slot = c.slot""",
}
