"""Preference formatting of chosen and rejected conversations.

Method.  Two conversations are compared turn by turn; the longest common prefix
of turns (equal role and text) is the prompt and is rendered once.  What follows
in either is its completion.  Each completion carries the character ranges that
are trained on: the texts of assistant turns and their end markers, so that stopping is
learnt.  Markers inside texts are escaped, so that no text can end its turn.

Pairs.  :func:`pairs` takes conversations with the same first user turn (and
what stands before it) as answers to one request: the one with the smallest id
is the chosen one of its group and every other one of the group is rejected in
its favour, so that a group of n gives n - 1 pairs.  A conversation that shares
its request with none, but has two different assistant texts, is paired with
itself, its last assistant text replaced by its first.

Scale.  Turns are collected by conversation, a record of the size of a dialogue.
Groups are joined by their chosen conversation's id, with requests named by a hash,
so no group is ever collected; a join skewed by a common request is split by
adaptive execution.

Cases.  Turns go by number; of equal numbers, by role and text.  Null roles and
texts count as empty.  Rows without a conversation id are left out.  If one
conversation is the beginning of the other, the shorter completion is empty.
Equal conversations differ in nothing: both completions are empty and
``n_prompt_turns`` is all of them.  Empty tables give empty results; only
``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order."""
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(own)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pairs(convs: DataFrame) -> DataFrame:
    """``chosen_id``, ``rejected_id``, ``chosen`` and ``rejected`` turns."""
    users = F.transform("turns", lambda x: (x["role"] == "user").cast("int"))
    request = F.slice("turns", F.lit(1), F.greatest(F.array_position(users, 1), F.lit(1)).cast("int"))
    named = convs.withColumn("request", F.sha2(F.to_json(request), 256))
    groups = named.groupBy("request").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n"))
    member = named.join(groups, "request")
    shared = member.filter((F.col("n") > 1) & (F.col("conv_id") != F.col("chosen_id"))).select("chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    shared = shared.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")
    alone = member.filter(F.col("n") == 1).withColumn("said", F.filter("turns", lambda x: x["role"] == "assistant"))
    alone = alone.filter(F.size("said") > 1).withColumn("first", F.element_at("said", 1)["text"]).filter(F.col("first") != F.element_at("said", -1)["text"])
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda x: (x["role"] == "assistant").cast("int"))), 1)
    swapped = F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), F.when(i == last, F.col("first")).otherwise(x["text"]).alias("text")))
    alone = alone.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), swapped.cast(TURNS).alias("rejected"), F.col("turns").alias("chosen"))
    return shared.unionByName(alone)


def escaped(text: str) -> str:
    """Text in which nothing is a marker: a backslash goes between ``<`` and ``|``, and one more where some stand."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def render(turns: list[dict]) -> tuple[str, list[dict]]:
    """The text of turns, and the ranges of assistant texts in it."""
    parts, at, ranges = [], 0, []
    for t in turns:
        head, body = f"<|{escaped(t['role'])}|>\n", escaped(t["text"])
        if t["role"] == "assistant":
            ranges.append({"start": at + len(head), "end": at + len(head) + len(body) + len(END)})
        part = f"{head}{body}{END}\n"
        parts.append(part)
        at += len(part)
    return "".join(parts), ranges


def formatted(paired: DataFrame) -> DataFrame:
    """Prompt and masked completions of each pair."""
    mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, prompts, sides = [], [], ([], [], [], [])
            for c, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = next((i for i, (a, b) in enumerate(zip(c, r, strict=False)) if a != b), min(len(c), len(r)))
                shared.append(n)
                prompts.append(render(c[:n])[0])
                for k, x in ((0, c), (2, r)):
                    text, ranges = render(x[n:])
                    sides[k].append(text)
                    sides[k + 1].append(ranges)
            cols = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(prompts, pa.string())]
            cols += [pa.array(s, mask if k % 2 else pa.string()) for k, s in enumerate(sides)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    ranges = "array<struct<start:bigint,end:bigint>>"
    schema = f"chosen_id long, rejected_id long, n_prompt_turns long, prompt string, chosen string, chosen_mask {ranges}, rejected string, rejected_mask {ranges}"
    return paired.select("chosen_id", "rejected_id", "chosen", "rejected").mapInArrow(run, schema)
