"""Operators on windows and chunks of whole blocks (ENC22, FEA13, FEA17, FEA25, JON6): one Arrow pass, no shuffle.

The oracles are written apart: DuckDB cuts the bytes in hex at every phase and counts rows.
Null texts count as empty ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ledgerlake.functions import byte_windows as bw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_HEX = "h as (select doc_id as slot, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents)"
_WINDOWS = " union all ".join(f"select slot, {s} as size, unnest(regexp_extract_all(substr(h, 2 * p + 1), '.{{{2 * s}}}')) as w from h, range({s}) t(p)" for s in bw.SIZES)


def _chunks(sizes) -> str:
    return " union all ".join(f"select slot, n, {s} as size, unnest(range(n // {s})) as i, unnest(regexp_extract_all(h, '.{{{2 * s}}}')) as c from h" for s in sizes)


_PAIRS = "select a.slot, a.c, b.c as d from ({chunks}) a join ({chunks}) b on a.slot = b.slot and b.i > a.i and b.i <= a.i + {far}"


def _same(size: int) -> str:
    return " + ".join(f"(substr(c, {2 * i + 1}, 2) = substr(d, {2 * i + 1}, 2))::int" for i in range(size))


def _register(name: str, schema: str, rows: Callable[[bytes], list[tuple]], oracle: str, places: int = 6) -> None:
    """``rows`` makes the rows of a block, after its slot; doubles are rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = _parse_datatype_string(f"slot long, {schema}")
        arrow = to_arrow_schema(kind)

        def made(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    few = batch.slice(at, 64)
                    out = [(s, *r) for s, t in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True) for r in rows(t or b"")]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("slot"), F.col("text").cast("binary").alias("raw"))
        got = docs.mapInArrow(made, kind)
        return got.select(*[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in kind])

    QUERIES[name], ORACLE[name] = run, oracle


_register(
    "enc22_pattern_mining", "rank int, pattern string, frequency long, gain long", bw.patterns,
    f"""with {_HEX}, g as (select slot, size, w, count(*) as c from ({_WINDOWS}) x group by all having count(*) >= {bw.LEAST}),
        r as (select *, row_number() over (partition by slot order by c * size desc, size desc, w) as rank from g)
        select slot, rank::int as rank, w as pattern, c as frequency, c * size as gain from r where rank <= {bw.TOP}""",
)

_register(
    "fea17_periodicity", ", ".join(f"period{p} double" for p in bw.PERIODS), lambda raw: [tuple(bw.periodicity(raw))],
    f"""with {_HEX}, e as (select slot, size, c = lag(c) over (partition by slot, size order by i) as same from ({_chunks(bw.PERIODS)}) x),
        s as (select slot, size, avg(same::int) as share from e group by slot, size)
        select h.slot, {", ".join(f"round(coalesce(max(case when size = {p} then share end), 0), 6) as period{p}" for p in bw.PERIODS)} from h left join s on h.slot = s.slot group by h.slot""",
)

_register(
    "fea25_multi_scale", ", ".join(f"repetition{s} double" for s in bw.SIZES) + ", periodicity double, near_duplicates double",
    lambda raw: [(*bw.repetition(raw), bw.widest_period(raw), bw.near_duplicates(raw))],
    f"""with {_HEX}, g as (select slot, size, w, count(*) as c from ({_WINDOWS}) x group by all),
        r as (select slot, size, sum(case when c > 1 then c else 0 end) / sum(c) as share from g group by slot, size),
        e as (select slot, size, n, i, c = lag(c) over (partition by slot, size order by i) as same from ({_chunks(range(2, 17))}) x),
        p as (select slot, max(share) as share from (select slot, size, sum((same and i <= n // size - 2)::int) / (max(n) // size - 2) as share from e where n >= 16 and n // size >= 3 group by slot, size) q group by slot),
        k as (select slot, count(*) as pairs, sum(case when first > 0.6 and share > 0.7 and share < 0.95 then share else 0 end) as total
            from (select slot, ({_same(8)}) / 8 as first, ({_same(32)}) / 32 as share from ({_PAIRS.format(chunks=_chunks([bw.CHUNK]), far=bw.ALIKE)}) y) z group by slot)
        select h.slot, {", ".join(f"round(coalesce(max(case when r.size = {s} and h.n >= {2 * s} then r.share end), 0), 6) as repetition{s}" for s in bw.SIZES)},
        round(coalesce(max(p.share), 0), 6) as periodicity, round(coalesce(max(k.total / k.pairs), 0), 6) as near_duplicates
        from h left join r on h.slot = r.slot left join p on h.slot = p.slot left join k on h.slot = k.slot group by h.slot""",
)

_register(
    "jon6_chunk_similarity", "chunks long, pairs long, similarity double", lambda raw: [bw.chunk_similarity(raw)],
    f"""with {_HEX}, k as (select slot, count(*) as pairs, avg(({_same(8)}) / 8) as similarity from ({_PAIRS.format(chunks=_chunks([bw.CHUNK]), far=bw.SIMILAR)}) y group by slot)
        select h.slot, h.n // {bw.CHUNK} as chunks, coalesce(pairs, 0) as pairs, round(coalesce(similarity, 0), 6) as similarity from h left join k on h.slot = k.slot""",
)


_register(
    "fea13_pattern_density", "system_program double, token_program double, instructions double, constants double", lambda raw: [tuple(bw.densities(raw))],
    f"""with {_HEX}, w as (select slot, w from ({_WINDOWS}) x where size in (4, 32)),
        b as (select slot, unnest(range(n)) as i, unnest(regexp_extract_all(h, '..')) as b from h),
        d as (select slot, sum((w = '{bw.SYSTEM_PROGRAM.hex()}')::int) as s, sum((w = '{bw.TOKEN_PROGRAM.hex().upper()}')::int) as t, sum((w in ({", ".join(f"'{p.hex()}'" for p in bw.INSTRUCTIONS)}))::int) as i from w group by slot),
        c as (select slot, sum((b in ('00', '01'))::int) + sum((b = 'FE' and before = 'FF')::int) as c from (select slot, b, lag(b) over (partition by slot order by i) as before from b) y group by slot)
        select h.slot, round(coalesce(s, 0) / greatest(n, 32), 6) as system_program, round(coalesce(t, 0) / greatest(n, 4), 6) as token_program,
        round(coalesce(i, 0) / greatest(n, 1), 6) as instructions, round(coalesce(c, 0) / greatest(n, 1), 6) as constants
        from h left join d on h.slot = d.slot left join c on h.slot = c.slot""",
)


#: Scores of a block that a model is trained on, each with gain and cover.
SCORES, WIDTH = 20, 3
# Gain of a repetition score and of a period by importance.
_GAIN = {**{f"repetition{s}": 0.3 for s in bw.SIZES}, "periodicity": 0.35, "near_duplicates": 0.4}


def _half_up(x: float) -> float:
    return math.floor(x * 1e6 + 0.5) / 1e6


def _training_row(raw: bytes) -> list[tuple[int, float]]:
    """Importance, gain and cover of each score, padded with zeros to ``SCORES``."""
    scores = dict(zip(_GAIN, (*bw.repetition(raw), bw.widest_period(raw), bw.near_duplicates(raw)), strict=True))
    flat = [x for name, s in scores.items() for x in (_half_up(s), _half_up(s) * _GAIN[name], float(len(raw)))]
    return list(enumerate(flat + [0.0] * (SCORES * WIDTH - len(flat))))


_PARTS = " union all ".join(
    f"select f.slot, {i * WIDTH + j} as position, {x} as value from f join d on f.slot = d.slot"
    for i, (name, gain) in enumerate(_GAIN.items()) for j, x in enumerate((name, f"{name} * {gain}e0", "d.n::double"))
)
_register(
    "sup15_training_features", "position int, value double", _training_row,
    f"""with f as materialized ({ORACLE["fea25_multi_scale"]}), d as (select doc_id as slot, strlen(coalesce(text, '')) as n from documents),
        p as ({_PARTS} union all select slot, unnest(range({len(_GAIN) * WIDTH}, {SCORES * WIDTH})), 0e0 from f) select slot, position::int as position, round(value, 8) as value from p""", 8,
)
