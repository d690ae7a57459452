"""Byte features in relational form (FEA): bytes counted or windowed once, then arithmetic."""

_M = "select slot, big(sum(c)) as n, sum(b * c) / dbl(sum(c)) as mean, sum(b * b * c) / dbl(sum(c)) - power(sum(b * c) / dbl(sum(c)), 2) as variance from {byte_counts} k group by slot"
_E = "lg2(dbl(sum(c))) - sum(c * lg2(dbl(c))) / sum(c)"
_CHUNK = "select slot, chunk, big(sum(c)) as n, " + _E + " as e from (select slot, idiv(pos, {size}) as chunk, b, count(*) as c from {{byte_rows}} r group by slot, idiv(pos, {size}), b) k group by slot, chunk"


def _chunks(size: int) -> str:
    return _CHUNK.replace("{size}", str(size)).replace("{{", "{").replace("}}", "}")


def _top_grams(n: int) -> str:
    key = "b * 256 + p" if n == 2 else "(b * 256 + p) * 256 + pp"
    return f"""select slot, big(rank) as rank, gram, r6(c / dbl(total)) as frequency from (select slot, gram, c, sum(c) over (partition by slot) as total, row_number() over (partition by slot order by c desc, gram) as rank
        from (select slot, {key} as gram, count(*) as c from {{byte_pairs}} w where {"p" if n == 2 else "pp"} is not null group by slot, {key}) g) t where rank <= 5"""


SQL = {
    "fea1_moments": "select m.slot, r6(m.mean) as mean, r6(m.variance) as variance, r6(sqrt(greatest(0e0, m.variance))) as deviation, x.least, x.most, x.most - x.least as spread from (" + _M + ") m join (select slot, min(b) as least, max(b) as most from {byte_counts} k group by slot) x on m.slot = x.slot",
    "fea2_quartiles": """select slot, min(case when upto > idiv(n, 4) then b end) as q1, min(case when upto > idiv(n, 2) then b end) as q2, min(case when upto > idiv(3 * n, 4) then b end) as q3
        from (select slot, b, big(sum(c) over (partition by slot order by b)) as upto, big(sum(c) over (partition by slot)) as n from {byte_counts} k) t group by slot""",
    "fea3_skew_kurtosis": "select slot, r6(case when s2 <= 0 then 0 else s3 / power(s2, 15e-1) end) as skewness, r6(case when s2 <= 0 then 0 else s4 / (s2 * s2) - 3 end) as kurtosis from (select k.slot, sum(c * power(b - mean, 2)) / sum(c) as s2, sum(c * power(b - mean, 3)) / sum(c) as s3, sum(c * power(b - mean, 4)) / sum(c) as s4 from {byte_counts} k join (" + _M + ") m on k.slot = m.slot group by k.slot) t",
    "fea4_histogram": "select slot, idiv(b, 32) as bin, r6(sum(c) / max(n)) as share from (select slot, b, c, dbl(sum(c) over (partition by slot)) as n from {byte_counts} k) t group by slot, idiv(b, 32)",
    "fea5_repetition": "select slot, r6(avg(case when b = p then 1e0 else 0e0 end)) as repetition, r6(avg(case when b = (p + 1) % 256 then 1e0 else 0e0 end)) as sequential, r6(avg(case when b = pp and b <> p then 1e0 else 0e0 end)) as alternating from {byte_pairs} w where p is not null group by slot",
    "fea6_top_bigrams": _top_grams(2),
    "fea6_top_trigrams": _top_grams(3),
    "fea7_run_lengths": "select slot, r6(avg(n)) as mean_run, max(n) as longest from (select slot, run, count(*) as n from (select slot, sum(case when b = p then 0 else 1 end) over (partition by slot order by pos) as run from {byte_pairs} w) r group by slot, run) t group by slot",
    "fea8_complexity": "select slot, r6(count(*) / 256e0) as complexity from {byte_counts} k group by slot",
    "fea9_header_score": "select slot, r6(avg(case when e > 4 then 1e0 else 0e0 end)) as score from (" + _chunks(32) + ") c group by slot",
    "fea10_alignment": "select slot, r6(sum(case when b = 1 then c else 0 end) / dbl(sum(c))) as marker, r6(ceil(sum(c) / 4e0) / sum(c)) as aligned4, r6(ceil(sum(c) / 8e0) / sum(c)) as aligned8 from {byte_counts} k group by slot",
    "fea11_size_features": "select slot, r6(lg2(dbl(size_bytes))) as log_size, r6((size_bytes % 1024) / 1024e0) as remainder from {blocks} b where size_bytes > 0",
    "fea12_address_signature_counts": "select a.slot, a.addresses, s.signatures from (select slot, nif(e > 2 and e < 7 and n = 32) as addresses from (" + _chunks(32) + ") c group by slot) a join (select slot, nif(e > 5 and n = 64) as signatures from (" + _chunks(64) + ") c group by slot) s on a.slot = s.slot",
    "fea15_structure_score": "select slot, r6((least(1e0, transaction_count / 1e3) + least(1e0, size_bytes / 1e5) + case when parent_slot = slot - 1 then 1e0 else 0e0 end) / 3) as score from {blocks} b",
    "fea16_top_bytes": "select slot, big(rank) as rank, b, r6(c / n) as frequency from (select slot, b, c, dbl(sum(c) over (partition by slot)) as n, row_number() over (partition by slot order by c desc, b) as rank from {byte_counts} k) t where rank <= 5",
    "fea18_entropy": "select slot, r6(" + _E + ") as entropy, r6((" + _E + ") / 8) as normalised from {byte_counts} k group by slot",
    "fea19_conditional_entropy": "select slot, r6(sum(c * lg2(of / c)) / sum(c)) as conditional from (select slot, p, b, dbl(count(*)) as c, dbl(sum(count(*)) over (partition by slot, p)) as of from {byte_pairs} w where p is not null group by slot, p, b) t group by slot",
    "fea20_estimates": "select slot, r6(least(1e1, 8 / greatest(e, 1e0))) as gzip, r6(e * n) as information from (select slot, " + _E + " as e, dbl(sum(c)) as n from {byte_counts} k group by slot) t",
    "fea23_named_features": "select slot, 'unique' as feature, r6(count(*) / 256e0) as importance from {byte_counts} k group by slot union all select slot, 'zero_ratio', r6(sum(case when b = 0 then c else 0 end) / dbl(sum(c))) from {byte_counts} k group by slot union all select slot, 'high_ratio', r6(sum(case when b > 200 then c else 0 end) / dbl(sum(c))) from {byte_counts} k group by slot",
    "fea24_domain_features": "select slot, r6(sum(case when b <= 5 then c else 0 end) / dbl(sum(c))) as instruction_share, r6(sum(case when b = 3 then c else 0 end) / dbl(sum(c))) as transfer_share from {byte_counts} k group by slot",
    "fea26_characteristics": "select slot, r6((" + _E + ") / 8) as entropy, r6(max(c) / dbl(sum(c))) as commonest from {byte_counts} k group by slot",
    "fea27_usage_ranking": "select data as feature, count(*) as used, big(row_number() over (order by count(*) desc, data)) as rank from {instructions} i group by data order by used desc, feature limit 100",
    "sup16_basic_features": "select slot, r6((" + _E + ") / 8) as entropy, r6(count(*) / 256e0) as diversity from {byte_counts} k group by slot",
    "enc2_dictionary_stats": "select count(distinct program) as entries, count(*) as occurrences, r6(case when count(distinct program) = 0 then 1e0 else 30e0 * count(*) / (30e0 * count(*) + 32e0 * count(distinct program)) end) as ratio from {instructions} i",
}

SQL |= {
    "fea14_timestamp_density": "select payment_id % 100 as grp, r6(count_in / dbl(n)) as density from (select payment_id % 100 as payment_id, nif(ts_s > 1577836800 and ts_s < 1893456000) as count_in, count(*) as n from {payments} p group by payment_id % 100) t",
    "sup14_model_inputs": "select slot, max(case when feature = 'unique' then importance else 0e0 end) as u, max(case when feature = 'zero' then importance else 0e0 end) as z from (select slot, 'unique' as feature, r6(count(*) / 256e0) as importance from {byte_counts} k group by slot union all select slot, 'zero', r6(sum(case when b = 0 then c else 0 end) / dbl(sum(c))) from {byte_counts} k group by slot) f group by slot",
    "sup21_model_complexity": "select r6((128 * 64 + 64 * 32 + 32 * 16) / 1e3) as complexity",
    "sup22_feature_groups": "select slot, listed(b) as first_bytes from (select slot, b, row_number() over (partition by slot order by c desc, b) as rank from {byte_counts} k) t where rank <= 20 group by slot",
    "sup24_combined_stats": "select strategy, version, r6(sum(original) / dbl(sum(compressed))) as ratio, count(*) as blocks from {results} r group by strategy, version",
    "sup18_model_insights": "select strategy, used, rank from (select strategy, count(*) as used, big(row_number() over (order by count(*) desc, strategy)) as rank from {results} r group by strategy) t",
}
