"""Domain relations as projections of the driver's tables.

Fixed values: the projections' constants stand for block times, prices and
capacities and are the same for both engines.
"""

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

RELATIONS = {
    "blocks": """select doc_id as slot, nbytes(text) as size_bytes, cast(length(text) - length(replace(text, ' ', '')) + 1 as bigint) as transaction_count,
        1609459200 + idiv(doc_id * 400, 1000) as block_time, sha(text) as block_hash, case when doc_id > 0 then doc_id - 1 else 0 end as parent_slot,
        source as program, lang, text from {documents}""",
    "instructions": "select slot, program, data from (select doc_id as slot, source as program, words_of(text) as data from {documents}) t where data <> ''",
    "payments": """select o_orderkey as payment_id, o_custkey as client_id, o_orderkey % 7 as gateway_id, cast(floor(o_totalprice) as bigint) as amount,
        case substr(o_orderpriority, 1, 1) when '1' then 'BlockRetrieval' when '2' then 'TransactionSubmission' when '3' then 'AccountInfo'
        when '4' then 'ProgramExecution' else 'DataStorage' end as service_type, o_orderdate as ts, epoch_s(o_orderdate) as ts_s, o_orderstatus <> 'P' as confirmed from {orders}""",
    "nodes": """select s_suppkey as node_id, 1000000000 + s_suppkey * 1000000 as capacity, cast(floor(abs(s_acctbal)) as bigint) * 10000 as used,
        cast(case s_suppkey % 4 when 0 then 1500 when 1 then 15000 when 2 then 150000 else 1500000 end as bigint) * 1000000000 as staked_amount,
        (s_suppkey * 37) % 500 as avg_response_time, 80 + s_suppkey % 121 as performance_score, s_suppkey * 86400 * 11 as stake_seconds,
        cast(s_nationkey as bigint) as zone from {supplier}""",
    "votes": """select l_orderkey % 500 as proposal_id, l_suppkey as voter_id, case l_returnflag when 'A' then 'Accept' when 'R' then 'Reject' else 'Abstain' end as choice,
        cast(l_quantity as bigint) as power, l_shipdate as ts, l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey from {lineitem}""",
    "first_votes": """select proposal_id, voter_id, choice, power, ts from (select *, row_number() over (partition by proposal_id, voter_id
        order by ts, l_orderkey, l_linenumber, l_partkey, choice, power) as rn from {votes}) v where rn = 1""",
    "evidence": """select user_id as node_id, event_id as seq, ts, event_type, dbl(case event_type when 'click' then 0.05 when 'view' then 0.02
        when 'purchase' then 0.1 when 'error' then -0.2 else -0.1 end) as impact from {events}""",
    "ledger": "select user_id, event_id, ts, event_type, big(floor(value)) as amount from {events}",
    "reputations": "select node_id, r6(clamped(ts, seq, impact)) as reputation from {evidence} e group by node_id",
    "latency": "select event_type as op, value * 1000 as value_us, event_id as seq from {events}",
    "access_log": "select event_id as seq, user_id as client_id, slot, slot * 20000 + 1000 as size_bytes, ts, epoch_s(ts) as ts_s from (select *, big(json_at(props, k)) as slot from {events}) e",
    "snapshots": """select user_id as node_id, epoch_s(ts) as ts_s, event_id as seq, big(sum(cast(floor(value) as bigint)) over (partition by user_id order by ts, event_id
        rows between unbounded preceding and current row)) as messages_total, big(floor(value)) as used from {events}""",
    "replicas": "select distinct l_partkey as slot, l_suppkey as node_id from {lineitem}",
    "byte_rows": "select slot, big(pos) as pos, hex_int(h) as b from (select doc_id as slot, hex_bytes(text) from {documents}) x",
    "byte_counts": "select slot, b, count(*) as c from {byte_rows} y group by slot, b",
    "byte_pairs": "select slot, pos, b, lag(b) over (partition by slot order by pos) as p, lag(b, 2) over (partition by slot order by pos) as pp from {byte_rows} y",
    "results": """select doc_id as seq, case doc_id % 4 when 0 then 'dictionary' when 1 then 'rle' when 2 then 'tree' else 'hybrid' end as strategy,
        case when doc_id % 2 = 0 then 1 else 2 end as version, nbytes(text) as original, 1 + idiv(nbytes(text), 2 + doc_id % 5) as compressed, doc_id % 97 as took_us from {documents}""",
    "requests": """select event_id as id, case event_type when 'click' then 'getBlock' when 'view' then 'getConfirmedBlock' when 'purchase' then 'getSlot'
        when 'error' then 'getHealth' else 'getTransaction' end as method, big(json_at(props, k)) as param from {events}""",
}
