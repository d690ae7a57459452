"""Aggregations and metrics (MET)."""

# bucket i of 50 ends at 10^(6 i / 50) microseconds; counts beyond the last have no bucket
_BUCKETS = """select op, value_us, case when value_us > 1000000 then cast(null as bigint) else greatest(0, big(ceil(round(50 * log10(value_us) / 6, 9)))) end as bucket from {latency} l"""
_CUMULATIVE = f"""select op, bucket, c, big(sum(c) over (partition by op order by bucket)) as upto, big(sum(c) over (partition by op)) as total
    from (select op, coalesce(bucket, 50) as bucket, count(*) as c from ({_BUCKETS}) b group by op, coalesce(bucket, 50)) g"""


def _percentile(p: int, name: str) -> str:
    return f"r6(power(1e1, 6 * min(case when upto >= greatest(1, idiv(total * {p} + 99, 100)) then bucket end) / 50e0)) as {name}"


_SPLIT = "count(*) as payments, big(sum(amount)) as revenue, big(sum(idiv(amount * 95, 100))) as gateway_share, big(sum(amount - idiv(amount * 95, 100))) as network_share"

SQL = {
    "met1_workflow_totals": "select count(*) as blocks, big(sum(original)) as original, big(sum(compressed)) as compressed, r6(sum(original) / dbl(sum(compressed))) as average_ratio from {results} r",
    "met2_storage_stats": """select r.node_id, count(*) as blocks, big(sum(b.size_bytes)) as used_bytes, max(n.capacity) as capacity, max(n.capacity) - big(sum(b.size_bytes)) as available
        from {replicas} r join {blocks} b on r.slot = b.slot join {nodes} n on r.node_id = n.node_id group by r.node_id""",
    "met3_network_capacity": "select count(*) as nodes, big(sum(capacity)) as capacity, big(sum(used)) as used, big(sum(capacity - used)) as available from {nodes} n",
    "met4_cache_hit_rate": """select client_id, hits_, requests - hits_ as misses, r6(case when requests = 0 then 0 else hits_ / dbl(requests) end) as hit_rate
        from (select client_id, count(*) as requests, nif(rn > 1) as hits_ from (select client_id, row_number() over (partition by client_id, slot order by ts_s, seq) as rn from {access_log} a) s group by client_id) t""",
    "met5_latency_histogram": f"select op, bucket, count(*) as n from ({_BUCKETS}) b where bucket is not null group by op, bucket",
    "met6_latency_percentiles": f"select op, max(total) as n, {_percentile(50, 'p50')}, {_percentile(95, 'p95')}, {_percentile(99, 'p99')} from ({_CUMULATIVE}) c group by op",
    "met7_throughput": """select op, count(*) as n, r6(avg(value_us)) as average, r6(max(value_us)) as most, r6(min(value_us)) as least
        from (select op, value_us, row_number() over (partition by op order by seq desc) as rn from {latency} l) t where rn <= 1000 group by op""",
    "met8_memory_trend": """select node_id, r6(case when n < 10 or prev = 0 then 0 else (last - prev) / prev end) as trend from (select node_id, count(*) as n,
        avg(case when rn <= 5 then dbl(used) end) as last, avg(case when rn between 6 and 10 then dbl(used) end) as prev
        from (select node_id, used, row_number() over (partition by node_id order by ts_s desc, seq desc) as rn from {snapshots} s) t group by node_id) u""",
    "met9_message_rates": """select node_id, seq, r6(case when before is null or before = 0 or ts_s = before_s then 0 else (messages_total - before) / dbl(ts_s - before_s) end) as per_second from
        (select node_id, seq, ts_s, messages_total, lag(messages_total) over w as before, lag(ts_s) over w as before_s, row_number() over (partition by node_id order by ts_s desc, seq desc) as rn
        from {snapshots} s window w as (partition by node_id order by ts_s, seq)) t where rn <= 300""",
    "met10_health_score": """select node_id, r6(case when fill > 8e-1 then 8e-1 else 1e0 end * case when avg_response_time > 400 then 85e-2 else 1e0 end * case when performance_score < 100 then 9e-1 else 1e0 end) as score
        from (select *, used / dbl(capacity) as fill from {nodes} n) t""",
    "met11_performance_report": """select l.op, l.n, l.average, e.errors from (select op, count(*) as n, r6(avg(value_us)) as average from {latency} l group by op) l
        cross join (select nif(event_type = 'error') as errors from {events} e) e""",
    "met12_dashboard_snapshot": """select n.node_id, n.capacity, n.used, coalesce(r.blocks, 0) as blocks, coalesce(v.votes, 0) as votes, coalesce(e.reputation, 1e0) as reputation from {nodes} n
        left join (select node_id, count(*) as blocks from {replicas} r group by node_id) r on n.node_id = r.node_id
        left join (select voter_id, count(*) as votes from {votes} v group by voter_id) v on n.node_id = v.voter_id
        left join {reputations} e on n.node_id = e.node_id""",
    "met13_running_response_time": "select op, count(*) as served, r6(sum(value_us) / count(*)) as mean_us from {latency} l group by op",
    "met14_codec_stats": """select size_bucket, n, best, average, r6(last_ratio) as last_ratio from (select idiv(original, 1000) * 1000 as size_bucket, count(*) as n, r6(max(original / dbl(compressed))) as best,
        r6(sum(original) / dbl(sum(compressed))) as average, max_by(original / dbl(compressed), seq) as last_ratio from {results} r group by idiv(original, 1000) * 1000) t""",
    "met15_strategy_report": "select strategy, count(*) as used, big(sum(original)) as bytes_in, big(sum(compressed)) as bytes_out, r6(min(original / dbl(compressed))) as least, r6(max(original / dbl(compressed))) as most from {results} r group by strategy",
    "met16_strategy_means": "select strategy, r6(avg(original / dbl(compressed))) as mean_ratio, count(*) as used from {results} r group by strategy",
    "met17_stage_stats": "select version, r6(sum(original) / dbl(sum(compressed))) as ratio, r6(1e2 * (sum(original) - sum(compressed)) / sum(original)) as saved_percent from {results} r group by version",
    "met18_revenue_by_service_day": f"select service_type, idiv(ts_s, 86400) as day, {_SPLIT} from {{payments}} p where amount <> 0 and confirmed group by service_type, idiv(ts_s, 86400)",
    "met18_revenue_by_service": f"select service_type, {_SPLIT} from {{payments}} p where amount <> 0 and confirmed group by service_type",
    "met18_revenue_by_client": "select client_id, count(*) as requests, big(sum(amount)) as paid, min(ts_s) as first_s, max(ts_s) as last_s, idiv(big(sum(amount)), count(*)) as average from {payments} p where amount <> 0 and confirmed group by client_id",
    "met18_revenue_grouping_sets": """select coalesce(service_type, '*') as service_type, coalesce(gateway_id, -1) as gateway_id, count(*) as n, big(sum(amount)) as revenue from {payments} p where confirmed
        group by grouping sets ((service_type, gateway_id), (service_type), (gateway_id), ())""",
    "met19_gateway_stats": "select gateway_id, count(*) as requests, count(distinct client_id) as sessions from {payments} p group by gateway_id",
    "met20_client_usage": "select client_id, gateway_id, count(*) as requests, big(sum(amount)) as spent, r6(avg(amount)) as average from {payments} p group by client_id, gateway_id",
    "met21_network_health": """select count(*) as nodes, nif(rep > 5e-1) as active, r6(avg(avg_response_time)) as response, r6(nif(rep >= 8e-1) / dbl(count(*))) as participation
        from (select n.node_id, n.avg_response_time, coalesce(r.rep, 1e0) as rep from {nodes} n left join (select node_id, reputation as rep from {reputations} e) r on n.node_id = r.node_id) t""",
    "met22_transport_stats": "select event_type as status, count(distinct user_id) as peers, nif(event_type in ('click', 'view')) as connected from {events} e group by event_type",
    "met23_pool_stats": """select class, count(*) as buffers, big(sum(size_bytes)) as used, r6(1 - sum(size_bytes) / dbl(sum(room))) as fragmentation from (select size_bytes, case when size_bytes <= 1024 then 'small' when size_bytes <= 16384 then 'medium' else 'large' end as class,
        case when size_bytes <= 1024 then 1024 when size_bytes <= 16384 then 16384 else 1048576 end as room from {blocks} b) t group by class""",
    "met24_stake_summary": "select count(*) as stakers, big(sum(staked_amount)) as total, idiv(big(sum(staked_amount)), count(*)) as average from {nodes} n",
    "met25_version_comparison": """select r6(v2.ratio / v1.ratio) as ratio_improvement, r6(1e2 * (v1.bytes - v2.bytes) / v1.bytes) as size_improvement, v1.took as v1_us, v2.took as v2_us from
        (select sum(original) / dbl(sum(compressed)) as ratio, dbl(sum(compressed)) as bytes, big(sum(took_us)) as took from {results} r where version = 1) v1 cross join
        (select sum(original) / dbl(sum(compressed)) as ratio, dbl(sum(compressed)) as bytes, big(sum(took_us)) as took from {results} r where version = 2) v2""",
    "met26_cost_analysis": "select lang, count(*) as blocks, r6(count(*) / 1e6 * 23e0) as archive_usd, r6(count(*) / 1e6 * 23e-1) as network_usd from {blocks} b group by lang",
    "met27_database_stats": "select program as category, count(*) as entries, big(sum(size_bytes)) as bytes, min(slot) as first_slot, max(slot) as last_slot from {blocks} b group by program",
    "met28_dictionary_stats": "select count(distinct program) as entry_count, r6((32 - 10) / 32e0) as delta_saving from {instructions} i",
    "sup33_savings_percent": "select r6(1e2 * (sum(original) - sum(compressed)) / sum(original)) as savings from {results} r",
    "sup35_latency_bundle": "select op, count(*) as n, r6(sum(value_us) / count(*)) as mean_us, r6(max(value_us)) as worst from {latency} l group by op",
    "sup43_block_reports": "select strategy, version, count(*) as blocks, r6(avg(original / dbl(compressed))) as ratio, big(sum(took_us)) as took_us from {results} r group by strategy, version",
    "ml9_bandit_arms": """select strategy, n, r6(mean) as mean, r6(mean + sqrt(2 * ln(total) / n)) as ucb from (select strategy, count(*) as n, avg(original / dbl(compressed)) as mean, big(sum(count(*)) over ()) as total
        from (select *, row_number() over (partition by strategy order by seq desc) as rn from {results} r) t where rn <= 100 group by strategy) u""",
    "ml10_history_variance": """select seq, strategy, r6(v) as variance from (select seq, strategy, n, var_pop(original / dbl(compressed)) over (partition by strategy order by seq rows between 19 preceding and current row) as v from
        (select *, row_number() over (partition by strategy order by seq) as n from {results} r) h) t where n % 50 = 0""",
    "ml11_trainer_rollup": """select strategy, r6(-avg(ratio)) as mean_loss, r6(avg(case when rn <= 10 then ratio end)) as last_ten, r6(case when count(*) < 10 then 5e-1 else 1 / (1 + var_pop(case when rn <= 20 then ratio end)) end) as stability
        from (select strategy, original / dbl(compressed) as ratio, row_number() over (partition by strategy order by seq desc) as rn from {results} r) t group by strategy""",
    "ml12_importance_vector": """select pos, r6(s / sum(s) over ()) as importance from (select seq % 50 as pos, sum(original / dbl(compressed)) as s from {results} r group by seq % 50) t""",
    "ml6_class_rounding": "select seq, least(5, greatest(0, big(round(original / dbl(compressed))))) as class from {results} r",
    "sup17_estimates": "select slot, r6((1 + 1 - u / dbl(n)) * (8 - e) / 8) as potential from (select slot, count(*) as u, sum(c) as n, lg2(sum(c)) - sum(c * lg2(dbl(c))) / sum(c) as e from {byte_counts} b group by slot) t",
}
