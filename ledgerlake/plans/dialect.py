"""One SQL text for two engines: relation names and a few functions are written for each.

Catalyst plans the Spark form, the DuckDB form is its oracle.  A text names its
relations in braces (``{payments}``) and uses the functions below where the
engines differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.sources.relations import RELATIONS, TABLES

#: name: (Spark, DuckDB); ``{0}`` is the first argument and so on.
FUNCTIONS = {
    "idiv": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "whole": ("cast({0} as bigint)", "cast(trunc({0}) as bigint)"),
    "big": ("cast({0} as bigint)", "cast({0} as bigint)"),
    "dbl": ("cast({0} as double)", "cast({0} as double)"),
    "r6": ("round(cast({0} as double), 6)", "round(cast({0} as double), 6)"),
    "nif": ("count_if({0})", "cast(count_if({0}) as bigint)"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "nbytes": ("cast(octet_length({0}) as bigint)", "cast(strlen({0}) as bigint)"),
    "json_at": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "epoch_s": ("unix_seconds(cast({0} as timestamp))", "cast(floor(epoch({0})) as bigint)"),
    "words_of": ("explode(split({0}, ' '))", "unnest(string_split({0}, ' '))"),
    "series": ("(select id as {2} from range({0}, {1}))", "(select range as {2} from range({0}, {1}))"),
    "hits": ("cast(regexp_count({0}, '{1}') as bigint)", "cast(len(regexp_extract_all({0}, '{1}')) as bigint)"),
    "matches": ("({0} rlike '{1}')", "regexp_matches({0}, '{1}')"),
    "listed": ("array_join(array_sort(collect_list(cast({0} as string))), ',')", "array_to_string(list_sort(list(cast({0} as varchar))), ',')"),
    "text_of": ("cast({0} as string)", "cast({0} as varchar)"),
    "hex_bytes": ("posexplode(split(rtrim(regexp_replace(hex({0}), '(..)', '$1 ')), ' ')) as (pos, h)", "unnest(range(strlen({0}))) as pos, unnest(regexp_extract_all(hex(encode({0})), '..')) as h"),
    "hex_int": ("cast(conv({0}, 16, 10) as bigint)", "cast(('0x' || {0}) as bigint)"),
    # 1 plus every {2} in the order of {0} and {1}, kept within 0 and 2 after each
    "clamped": (
        "aggregate(transform(array_sort(collect_list(struct({0} as o, {1} as p, {2} as x))), y -> y.x), 1D, (s, x) -> least(2D, greatest(0D, s + x)))",
        "list_reduce(list({2} order by {0}, {1}), lambda s, x: least(2e0, greatest(0e0, s + x)), 1e0)",
    ),
    # {3} less every {2} in the order of {0} and {1} that is not more than what is left
    "drawn": (
        "aggregate(transform(array_sort(collect_list(struct({0} as o, {1} as p, {2} as x))), y -> y.x), {3}, (s, x) -> case when x <= s then s - x else s end)",
        "list_reduce(list({2} order by {0}, {1}), lambda s, x: case when x <= s then s - x else s end, {3})",
    ),
    "lg2": ("log2({0})", "log2({0})"),
    "dec": ("cast({0} as decimal(38,0))", "cast({0} as hugeint)"),
    "dec_div": ("cast(floor({0} / {1}) as bigint)", "cast({0} // {1} as bigint)"),
}


def _call(sql: str, name: str, form: str) -> str:
    """``sql`` with every call of ``name`` written as ``form``; arguments may hold calls."""
    while m := re.search(rf"(?<![\w.]){name}\(", sql):
        depth, args, at, quoted = 1, [], m.end(), False
        start = at
        while depth:
            c = sql[at]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                if c == "," and depth == 1:
                    args.append(sql[start:at].strip())
                    start = at + 1
                depth += (c == "(") - (c == ")")
            at += 1
        args.append(sql[start : at - 1].strip())
        text = form
        for i, a in enumerate(args):
            text = text.replace("{%d}" % i, a)
        sql = sql[: m.start()] + text + sql[at:]
    return sql


def render(sql: str, engine: int, path: Callable[[str], str]) -> str:
    """The text for an engine (0 Spark, 1 DuckDB), tables named by ``path``."""
    for _ in range(4):  # relations are made of relations
        sql = re.sub(r"\{([a-z_]+)\}", lambda m: path(m[1]) if m[1] in TABLES else f"({RELATIONS[m[1]]})", sql)
    for name, forms in FUNCTIONS.items():
        sql = _call(sql, name, forms[engine])
    return sql


def spark_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query from its text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(render(sql, 0, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))

    return query


def duckdb_sql(sql: str) -> str:
    """The same for DuckDB, over views named as the tables."""
    return render(sql, 1, lambda t: t)
