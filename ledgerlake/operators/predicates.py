"""Predicates and projections (PRD) and scalar generators (GEN)."""

SQL = {
    "prd6_likely_signature": "select slot, nbytes(data) = 64 as likely_signature, count(*) as n from {instructions} i group by slot, nbytes(data) = 64",
    "prd7_likely_timestamp": "select payment_id, ts_s > 1577836800 and ts_s < 1893456000 as likely from {payments} p",
    "prd9_block_class": """select slot, case when transaction_count < 100 then 'Small' when transaction_count > 1000 then 'HighVolume' when size_bytes > 100000 then 'Large'
        when hits(text, the) > 10 then 'DeFi' else 'Mixed' end as class from {blocks} b""",
    # fixed values: the ten tokens; more than ten of them make a block heavy
    "prd10_keyword_count": "select slot, keywords, keywords > 10 as heavy from (select slot, hits(text, Swap) + hits(text, swap) + hits(text, DEX) + hits(text, dex) + hits(text, AMM) + hits(text, amm) + hits(text, liquidity) + hits(text, pool) + hits(text, stake) + hits(text, yield) as keywords from {blocks} b) t",
    "prd11_defi_ratio": "select slot, r6(least(1e0, (hits(text, swap) + hits(text, the)) / greatest(dbl(transaction_count), 1e0))) as ratio from {blocks} b",
    "prd12_compression_potential": """select slot, r6(least(1e0, case when n > 1000 then 2e-1 else 0e0 end + case when n / dbl(kinds) > 10 then 2e-1 else 0e0 end
        + case when caps / dbl(n) > 15e-2 then 3e-1 else 0e0 end + case when n / dbl(kinds) > 3 then 3e-1 else 0e0 end)) as potential
        from (select slot, count(*) as n, count(distinct data) as kinds, nif(matches(data, ^[A-Z])) as caps from {instructions} i group by slot) s""",
    "prd13_block_validity": "select slot, size_bytes from {blocks} b where size_bytes between 1 and 50000000",
    "prd14_ttl_validity": """select seq, now_s - ts_s < 86400 as file_cache, not now_s > ts_s + 86400 as engine, not now_s - ts_s > 86400 as tier_cache, ts_s + 86400 > now_s as client
        from (select a.seq, a.ts_s, m.now_s from {access_log} a cross join (select max(ts_s) as now_s from {access_log} b) m) t""",
    "prd15_historical_routing": "select id, param, case when 244999550 + param < 245000505 - 1000 + 50 then 'historical' else 'recent' end as route from {requests} r",
    "prd16_api_token": """select slot, matches(token, ^vault_[0-9a-fA-F]{32}$) as valid from (select slot, concat(case when slot % 3 = 0 then 'key_' else 'vault_' end, substr(block_hash, 1, case when slot % 5 = 0 then 31 else 32 end)) as token from {blocks} b) t""",
    "prd17_may_vote": """select n.node_id, coalesce(r.rep, 1e0) >= 5e-1 as may_vote from {nodes} n left join (select node_id, reputation as rep from {reputations} e) r
        on n.node_id = r.node_id""",
    "prd18_payment_valid": "select payment_id, amount from {payments} p where amount <> 0 and confirmed",
    "prd20_rate_limit": "select id, n <= 100 as allowed from (select seq as id, row_number() over (partition by idiv(ts_s, 3600) order by ts_s, seq) as n from {access_log} a) w",
    "gen3_block_totals": "select slot, count(*) as n_instructions, big(sum(nbytes(data))) as data_bytes, count(distinct data) as kinds, count(distinct program) as programs from {instructions} i group by slot",
    "gen5_approximate_tx_count": "select slot, case when size_bytes > 100 then least(50, idiv(size_bytes - 100, 200)) else 0 end as approximate from {blocks} b",
    "gen7_word_bigrams": """select slot, gram, count(*) as n from (select slot, lag(data) over (partition by slot order by data) || ' ' || data as gram from {instructions} i) g
        where gram is not null group by slot, gram""",
    "gen8_hex_integers": "select slot, hex_int(substr(block_hash, 1, 8)) as high32, hex_int(substr(block_hash, 57, 8)) as low32 from {blocks} b",
    "enc4_top_programs": "select program, refs, big(row_number() over (order by refs desc, program)) as rank from (select program, count(*) as refs from {instructions} i group by program) p order by refs desc, program limit 10",
    "enc5_cluster_efficiency": "select r6(case when refs > 0 then (31 * refs - 32 * entries) / dbl(32 * refs) else 1e0 end) as efficiency from (select count(*) as refs, count(distinct program) as entries from {instructions} i) s",
    "enc9_template_usage": "select data, count(*) as used, count(*) * greatest(0, max(nbytes(data)) - 5) as bytes_saved from {instructions} i group by data having count(*) > 1",
    "enc10_learn_templates": "select data, count(*) as n from {instructions} i group by data having count(*) >= 3 and max(nbytes(data)) >= 8",
    "enc26_strategy_choice": """select slot, case when the_rate > 2e-2 then 'token' when repeats > 4e-1 then 'repetitive' else 'model' end as strategy from
        (select slot, r6(nif(data = 'the') / dbl(count(*))) as the_rate, r6(1 - count(distinct data) / dbl(count(*))) as repeats from {instructions} i group by slot) s""",
    "enc27_best_of": """select seq, max_by(strategy, ratio * 10 - ord) as best, r6(max(ratio)) as ratio from (select seq, s.strategy, s.ord, cast(idiv(original * 100, compressed + s.ord * 7) as bigint) as ratio from {results} r
        cross join (select 'dictionary' as strategy, 0 as ord union all select 'rle', 1 union all select 'tree', 2 union all select 'hybrid', 3) s) c group by seq""",
    "enc28_block_hash": "select slot, sha(text) as hash, sha(concat(text_of(slot), ':', block_hash)) as link from {blocks} b",
    "enc29_integrity_check": "select slot from {blocks} b where sha(text) <> block_hash",
    "pat1_instruction_patterns": "select data, count(*) as n, count(*) * max(nbytes(data)) as potential from {instructions} i group by data having count(*) >= 2 and max(nbytes(data)) > 4",
    "pat2_account_patterns": "select client_id, count(*) as n, count(*) * 32 as potential from {payments} p group by client_id having count(*) >= 2",
    "pat3_signature_prefixes": "select prefix, count(*) as n, count(*) * 64 as potential from (select substr(block_hash, 1, 2) as prefix from {blocks} b) s group by prefix having count(*) >= 2",
    "pat4_ranked_patterns": """select kind, pattern, n, size, n * size as gain from (select 'instruction' as kind, data as pattern, count(*) as n, max(nbytes(data)) as size from {instructions} i group by data having count(*) >= 2 and max(nbytes(data)) > 4
        union all select 'account', text_of(client_id), count(*), big(32) from {payments} p group by client_id having count(*) >= 2) u order by gain desc, kind, pattern limit 1000""",
    "pat5_pattern_learning": "select data, count(*) as frequency, big(sum(nbytes(data))) as total_size, min(slot) as first_seen, max(slot) as last_seen from {instructions} i group by data",
    "pat6_pattern_counts": "select case when nbytes(data) <= 4 then 'short' when nbytes(data) <= 8 then 'medium' else 'long' end as kind, count(distinct data) as patterns from {instructions} i group by 1",
    "set1_distinct": "select count(distinct program) as programs, count(distinct data) as instructions, count(distinct slot) as slots from {instructions} i",
}
