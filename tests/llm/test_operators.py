"""The training-data operators on small fixtures, against brute force, and on edge cases."""

import hashlib
import re
import tracemalloc
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import public_tokenizers
from ledgerlake.llm import bpe, common, html_text, line_dedup, mixing, ngram_join, nn_descent, preference, span_dedup, toxicity, vafile
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `mix_key` int, `key` string, `token` long"
LONG = "word " * 30_000 + "x" * 50_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    base = "One two three four five six.\nSeven eight nine ten eleven twelve.\nThirteen fourteen fifteen sixteen seventeen eighteen nineteen."
    texts = [None, "", base, base, base + "\nMore.", LONG, " \n\t", "a", "A", "it's 's 士😀  x\r\n", base]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None, "r", 1, "k", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2], (None, base, None, None, None, None, None, None, None)], ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


def test_bpe_equals_tiktoken(spark, odd):
    ranks = bpe.load_ranks(VOCABULARY)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(odd, VOCABULARY, public_tokenizers.PATTERN, ids=True, text=True).collect()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    assert sorted(r["ids"] for r in got) == sorted(known.encode_ordinary(t) for t in texts)
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest()
        assert r["n_tokens"] == len(r["ids"])
    assert sorted(bytes(r["decoded"]) for r in got) == sorted(t.encode() for t in texts)
    back = bpe.decode(spark.createDataFrame([(1, known.encode_ordinary("héllo")), (2, None)], "doc_id long, ids array<int>"), VOCABULARY).collect()
    assert [bytes(r["decoded"]) for r in sorted(back)] == ["héllo".encode(), b""]


def test_bpe_in_steps_and_by_replay():
    codec = bpe.Codec(bpe.load_ranks(VOCABULARY), public_tokenizers.PATTERN)
    words = [w.encode() for w in ["aaaaaaaa", "ababababab", "thinghere", "======", "éé士士", "x"]]
    ids, counts = codec.replay(words)
    parts = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert parts == [[codec.ranks[w]] if w in codec.ranks else codec.stepwise(w) for w in words]


def test_bpe_memory_is_bounded():
    ranks, rng = bpe.load_ranks(VOCABULARY), np.random.default_rng(5)
    texts = [" ".join(f"{w:06x}" for w in rng.integers(0, 1 << 24, 150).tolist()) for _ in range(3000)]  # 3.1 million characters
    bpe._kinds.cache_clear()
    tracemalloc.start()
    try:
        codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
        n = sum(m for m, _, _ in codec.batches(texts))
        peak = tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
    assert n == len(texts)
    assert peak < 90


def test_workers_give_back_what_they_freed():
    if common._libc() is None:
        pytest.skip("the C library keeps free memory")

    def resident():
        return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    full = [bytes(2000) for _ in range(100_000)]
    last = full.pop()  # lies above the others, so the heap can't shrink by itself
    del full
    held = resident()
    assert next(common.pieces(iter([pa.record_batch({"x": [1]})]))).num_rows == 1
    assert resident() < held - 100
    assert len(last) == 2000


THUE = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
OTHER = THUE.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_words_apart(spark):
    """Words that polynomials modulo 2^64 confuse, a word of 2 MB behind a blank, and pieces whose hashes are made to collide."""
    docs = spark.createDataFrame([(1, THUE), (2, OTHER), (3, "a b c " + "x" * 2_000_000), (4, "a b c " + "x" * 2_000_001)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, 4, 85, 100).collect()} == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4)}
    codec = bpe.Codec(bpe.load_ranks(VOCABULARY), public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    texts = [THUE, OTHER, f"{THUE} {OTHER}", "it's  x\n\n y", "", "one two  three " * 50]

    def encoded(**limit):
        return [x.tolist() for _, ids, counts in codec.batches(texts, **limit) for x in np.split(ids, np.cumsum(counts)[:-1])]

    want = [known.encode_ordinary(t) for t in texts]
    assert encoded() == want and encoded(chars=30) == want
    codec._forget()
    codec._hashes = lambda code, start, end: np.asarray((end - start) % 3, dtype=np.uint64)
    assert encoded() == want


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    docs = [(i, "\n".join(f"line {k}" for k in rng.integers(0, 40, int(rng.integers(0, 12))))) for i in range(120)]
    got = {r["id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).select(F.col("row.doc_id").alias("id"), "text").collect()}
    seen, want = set(), {}
    for i, text in docs:
        lines, gone = text.split("\n") if text else [], set()
        for p in range(len(lines) - 1):
            if (pair := (lines[p], lines[p + 1])) in seen:
                gone |= {p, p + 1}
            seen.add(pair)
        want[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert got == want


def test_span_dedup_equals_plain_search(spark):
    """Every sentence in a later place of a run of two with 20 words, or of one with 25, is removed, and no other."""
    rng = np.random.default_rng(9)
    pool = [" ".join(f"w{rng.integers(0, 500)}" for _ in range(int(rng.integers(3, 30)))) + "." for _ in range(60)]
    docs = [(i, " ".join(pool[k] for k in rng.integers(0, 60, int(rng.integers(0, 9))))) for i in range(60)]
    docs += [(60, "I agree. Thanks for reading this post and please leave a comment below."), (61, "I agree. Thanks for reading this post and please leave a comment below.")]
    got = {r["row"]["doc_id"]: r["removed"] for r in span_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    runs, want = defaultdict(list), {i: set() for i, _ in docs}
    for i, text in docs:
        parts = [text[a:b].strip() for a, b in span_dedup.sentences_of(text)]
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                n = sum(len(x.split()) for x in parts[a:b])
                if n >= 25 or (b - a >= 2 and n >= 20):
                    runs[tuple(parts[a:b])].append((i, a, b))
    for places in runs.values():
        for i, a, b in places[1:]:
            want[i] |= set(range(a, b))
    assert got == {i: sorted(x) for i, x in want.items()}
    assert got[61] == []


def test_html_template_of_a_host(spark):
    """A template's advert, menu and comments go; classes of a page's own inside the article say nothing."""
    body = '<html><body><div class="top-menu"><a>m</a></div><div class="post"><p>Text {0} one</p><p>Share this</p>{1}</div><div class="comments"><p>said {0}</p></div></body></html>'
    pages = [(i, f"https://c.example/{i}", body.format(i, '<div class="share price">own</div>' if i == 3 else "")) for i in range(8)]
    pages += [(20, None, '<article><div class="share price">keep me</div><p class="notice-of-motion">and me</p></article>'), (21, None, "<p>&l<b>t;</b> &amp;</p>"), (22, None, "<div>" * 100_000 + "deep")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()}
    assert got[2] == "Text 2 one" and got[3] == "Text 3 one\nown"
    assert got[20] == "keep me\nand me" and got[21] == "&lt; &" and got[22] == "deep"


def test_empty_tables(spark, nothing):
    assert bpe.encode(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert line_dedup.dedup(nothing).count() == 0
    assert span_dedup.dedup(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert ngram_join.join(nothing).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert preference.formatted(preference.pairs(preference.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vafile.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    assert nn_descent.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_line_dedup_keeps_first_and_guarantees(spark, odd):
    docs = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\n\nb\nz"), (4, "p\nq\np\nq\np\nq"), (5, "b"), (6, None), (7, "a\nb\nc\nd")]
    got = {r["id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).select(F.col("row.doc_id").alias("id"), "text", "n_lines", "n_removed").collect()}
    assert got[1] == ("a\nb\nc\nd", 4, 0)
    assert got[2] == ("x\ny", 5, 3)
    assert got[3] == ("z", 3, 2)
    assert got[4] == ("p\nq", 6, 4)
    assert got[5] == ("b", 1, 0)
    assert got[6] == (None, 0, 0)
    assert got[7] == ("", 4, 4)
    done = line_dedup.dedup(odd)
    assert done.count() == odd.count()
    assert done.filter("row.doc_id = 2").select("n_removed").distinct().collect() == [(0,)]


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 1 << 60, 3).astype(np.uint64)
        left, right = (np.concatenate([rng.integers(0, 1 << 60, k).astype(np.uint64), shared, rng.integers(0, 1 << 60, 2).astype(np.uint64)]) for k in (1, 4))
        prints = [{int(g[i]) for i in at} for g, at in (line_dedup.winnow(x, 2, 2) for x in (left, right))]
        assert prints[0] & prints[1]


def test_span_dedup_equals_brute_force(spark, odd):
    long = "This passage is long enough to hold more than a few words. It goes on here for a while with others. And it ends now with some more words."
    docs = [(1, f"Start. {long} End."), (2, f"Other start here.\n{long}\nOther end."), (3, "Nothing shared at all. Quite so."), (4, None), (5, long)]
    done = span_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r["row"]["doc_id"]: r for r in done}
    assert got[1]["removed"] == [] and got[1]["text"] == docs[0][1]
    assert "passage" not in got[2]["text"] and "Other start" in got[2]["text"] and "Other end" in got[2]["text"]
    assert got[3]["removed"] == [] and got[4]["text"] is None
    assert got[5]["text"].strip() == ""
    assert span_dedup.dedup(odd).count() == odd.count()


def test_sentences_cover_the_text():
    for t in ("", "a", "A b. C d!  E\n\n f", "\n\nx. y", "no end", "a.b c"):
        assert "".join(t[a:b] for a, b in span_dedup.sentences_of(t)) == t


def test_toxicity_learns_pairs_and_holds_out(spark, odd):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(800):
        words = [f"w{k}" for k in rng.integers(0, 300, 30)]
        insult, group = rng.random(2) < 0.5
        words += ["idiot"] * int(insult) + ["people"] * int(group)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, truth)).join(truth, "doc_id").filter("held_out").toPandas()
    assert (scored["predicted"] == scored["toxic"]).mean() > 0.95
    again = toxicity.score(odd, toxicity.train(odd, truth.limit(0)))
    assert again.count() == odd.count()
    assert again.filter("score is null or score < 0 or score > 1").count() == 0


def test_mixing_targets():
    assert mixing.targets([]) == []
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000, 0]) == pytest.approx([30, 980, 0])


def test_splitting_tree_is_exact():
    quotas = [17, 0, 5, 101]
    for shards in (1, 2, 7):
        runs = [mixing.shard_quotas(quotas, shards, s, 1) for s in range(shards)]
        for source, q in enumerate(quotas):
            at = 0
            for start, own in runs:
                assert start[source] == at
                at += own[source]
            assert at == q
        sizes = [int(own.sum()) for _, own in runs]
        assert max(sizes) - min(sizes) <= 1


def test_mixing_draws(spark, odd):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    a, b = (mixing.draws(docs).select("row.*", "mix_size", "mix_target", F.size("mix_draws").alias("n")).toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    assert a.equals(b)
    assert a["n"].max() <= 3
    taken = (a["mix_size"] * a["n"]).groupby(a["source"]).sum()
    assert np.allclose(taken, a.groupby("source")["mix_target"].first(), rtol=0.02)
    assert mixing.draws(odd).count() == odd.count()
    assert mixing.mix(odd).columns == odd.columns


def _pages():
    made = []
    for i in range(12):
        body = "".join(f"<p>Text {i} of  block {k} &amp; more&lt;</p>" for k in range(3))
        made.append((i, f"https://a.example/{i}", f"<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='x'><p>Share this</p>{body}</div><footer>f</footer></body></html>"))
    return made


def test_html_text(spark):
    other = [(100, None, None), (101, "https://b.example/", "<article><h1>T</h1><p>a<b>b</b><br>c<p>d &am"), (102, "https://b.example/2", "<p>x<script>no</script><form>no</form><div id=comments>no</div>"), (101, "https://b.example/", "<article><h1>T</h1><p>a<b>b</b><br>c<p>d &am")]
    got = defaultdict(list)
    for r in html_text.extract(spark.createDataFrame([*_pages(), *other], "page_id long, url string, html string")).collect():
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["\n".join(f"Text 3 of block {k} & more<" for k in range(3))]  # 'Share this' is in the slot's class
    assert got[100] == [""]
    assert got[101] == ["T\nab c\nd &am"] * 2
    assert got[102] == ["x"]


def _components(rows, size, num, den):
    sets, parent = {}, {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_ngram_join_equals_brute_force(spark, odd, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = [f"v{k}" for k in rng.integers(0, 60, 80)]
        for _ in range(int(rng.integers(1, 40))):
            words = list(base)
            for _ in range(int(rng.integers(0, 8))):
                words[int(rng.integers(0, len(words)))] = f"n{rng.integers(0, 10_000)}"
            rows.append((len(rows), " ".join(words[: int(rng.integers(70, 81))])))
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks a hub
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, num in ((4, 85), (5, 80), (2, 50)):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs, size, num, 100).collect()}
        assert got == _components(rows, size, num, 100)
    found = ngram_join.join(odd, 4, 85, 100).collect()
    want = _components([(r["doc_id"], r["text"]) for r in odd.filter("doc_id is not null").collect()], 4, 85, 100)
    assert len(found) == odd.count()
    assert all(r["component_id"] == want[r["doc_id"]] for r in found if r["doc_id"] is not None)
    assert {r["n_shingles"] for r in found if r["doc_id"] in (0, 1, 6)} == {0}


def test_divide_skip_equals_scan():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 120, int(rng.integers(1, 90)))).astype(np.uint64) for _ in range(60)]
    index = ngram_join.Index(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 40 * len(np.union1d(q, s))]
        assert sorted(index.search(q, 40, 100)) == want


def _vectors(spark, rng, n, d=16):
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d)], 0) for i in range(n)]
    rows[7] = (7, rows[3][1], 0)
    rows += [(n + i, rows[50][1], 0) for i in range(30)]  # copies of one vector
    rows += [(1000, None, 0), (1050, [1.0, None] * (d // 2), 0), (1100, [float("nan")] * d, 0), (1150, [], 0), (None, rows[1][1], 0), (50, rows[50][1], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_exact_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, frame = _vectors(spark, rng, 300)
    monkeypatch.setattr(vafile, "CANDIDATE_BLOCK", 100)
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    got = vafile.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    want = []
    for q in sorted(i for i in good if i % 50 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert [tuple(r) for r in got] == want


def _recall(found, good, k=20):
    hit = total = 0
    for q, own in found.items():
        best = sorted((i for i in good if i != q and len(good[i]) == len(good[q])), key=lambda i: (-float(good[q] @ good[i]), i))[:k]
        hit += len(set(best) & {i for i, _ in own})
        total += len(best)
        assert all(abs(s - float(good[q] @ good[i])) < 1e-9 for i, s in own)
    return hit / total


def test_nn_descent_recall(spark):
    """The shipped constants over 5,000 vectors, of which some are longer, some repeated, some unusable."""
    rng = np.random.default_rng(6)
    rows, frame = _vectors(spark, rng, 5000)
    longer = [(10_000 + i, [float(np.float32(x)) for x in rng.normal(size=24)], 0) for i in range(300)]
    frame = frame.unionByName(spark.createDataFrame(longer, "vec_id long, embedding array<float>, label int"))
    good = {i: np.array(v) for i, v, _ in [*rows, *longer] if i is not None and v and None not in v and np.isfinite(v).all()}
    got = defaultdict(list)
    for r in nn_descent.nearest(frame.withColumn("id", F.lit("x")).withColumn("task", F.lit(1)), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 20 == 0}
    assert all(len(x) == 20 for x in got.values())
    assert _recall(got, good) >= 0.9


def test_nn_descent_returns_k(spark):
    rows, frame = _vectors(spark, np.random.default_rng(7), 600)
    got = nn_descent.nearest(frame, F.col("vec_id") % 100 == 0, k=120).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in got} == {0, 100, 200, 300, 400, 500, 600} and {r["count"] for r in got} == {120}
    few = frame.filter("vec_id < 5")
    assert nn_descent.nearest(few, F.col("vec_id") == 0).count() == 4


def test_nn_descent_builds_until_settled(spark, monkeypatch):
    _, frame = _vectors(spark, np.random.default_rng(6), 200)
    rounds = []

    def descend(graph):
        rounds.append(1)
        return graph.withColumn("new", F.transform("new", lambda x: F.lit(len(rounds) < 7)))

    monkeypatch.setattr(nn_descent, "descend", descend)
    nn_descent.build(nn_descent.nodes_of(frame)[0])
    assert len(rounds) == 7


def test_nn_descent_tasks_follow_the_bytes(spark):
    """Five times the vectors are dealt to as many tasks as long as these hold them, so each is brought to no more tasks."""
    rng = np.random.default_rng(8)
    for n in (3_000, 15_000):
        rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(n, 8)).astype(np.float32))]
        nodes, _ = nn_descent.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert nodes.select("task").distinct().count() == nn_descent.TASKS


def test_nn_descent_scores_a_node_once(spark, monkeypatch):
    """A search never asks again for a node that it has scored."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(3_000, 24)).astype(np.float32))]
    real, asked, steps = nn_descent.durable, [], []

    def durable(df):
        table = real(df)
        if "want" in table.columns:
            asked.extend((r["query"], r["want"]) for r in table.select("query", F.explode("want").alias("want")).collect())
            steps.append(1)
        return table

    monkeypatch.setattr(nn_descent, "durable", durable)
    assert nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 100 == 0).count() == 600
    assert len(steps) > 3 and len(asked) == len(set(asked))


def test_nn_descent_merges_in_pieces(spark, monkeypatch):
    _, frame = _vectors(spark, np.random.default_rng(10), 500)
    nodes, _ = nn_descent.nodes_of(frame)
    columns = ["id", "near", "sim", "new"]
    whole = nn_descent.start(nodes).select(columns).orderBy("id").collect()
    monkeypatch.setattr(nn_descent, "PAIRS", 100)
    assert nn_descent.start(nodes).select(columns).orderBy("id").collect() == whole


def test_preference_pairs(spark):
    turns = [(1, 0, "user", "Q"), (1, 1, "assistant", "A"), (1, 2, "user", "R"), (1, 3, "assistant", "B")]
    turns += [(2, 0, "user", "Q"), (2, 1, "assistant", "A"), (2, 2, "user", "R"), (2, 3, "assistant", "C")]
    turns += [(3, 0, "user", "Q"), (3, 1, "assistant", "A")]
    turns += [(4, 0, "system", None), (4, 1, "user", "x"), (4, 2, "assistant", "y"), (4, 3, "user", "z"), (4, 4, "assistant", "w")]
    turns += [(5, 0, "user", "alone"), (None, 0, "user", "lost"), (6, 0, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r["chosen_id"], r["rejected_id"]): r for r in preference.formatted(preference.pairs(preference.conversations(frame))).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, 4)}
    r = got[1, 2]
    assert r["n_prompt_turns"] == 3 and r["prompt"] == "<|user|>\nQ<|end|>\n<|assistant|>\nA<|end|>\n<|user|>\nR<|end|>\n"
    for side, answer in (("chosen", "B"), ("rejected", "C")):
        (m,) = r[f"{side}_mask"]
        assert r[side][m["start"] : m["end"]] == answer + "<|end|>"
    assert got[1, 3]["rejected"] == "" and got[1, 3]["n_prompt_turns"] == 2
    assert got[4, 4]["rejected"] == "<|assistant|>\ny<|end|>\n"
