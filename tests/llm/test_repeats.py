"""Substring dedup by words and by bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import queries, substring_dedup, suffix_dedup
from framewright.llm.exchange import pack, unpack


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    arrays = [np.arange(5000), np.array([], np.int64), np.array([7]), rng.integers(-(1 << 62), 1 << 62, 999), np.array([-(1 << 62), (1 << 63) - 1]), rng.integers(0, 255, 70).astype(np.uint8), np.repeat(3, 100), np.array([5, 5, 300, 2])]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_blocks_of_large_corpora(spark):
    """Chunks and buckets grow with the corpus, up to a bound, unless they are set."""
    from framewright.llm.exchange import BUCKET, CHUNK_BYTES, GROWS, Plan

    small, four, huge = Plan.of(1 << 27), Plan.of(16 * GROWS), Plan.of(1 << 45)
    assert (small.chunk_bytes, four.chunk_bytes, huge.chunk_bytes) == (CHUNK_BYTES, 4 * CHUNK_BYTES, 16 * CHUNK_BYTES)
    for plan, items, times in ((small, 1 << 27, 1), (four, 16 * GROWS, 4), (huge, 1 << 45, 16)):
        assert times * BUCKET / 2 <= items / plan.buckets <= times * BUCKET * 2
    spark.conf.set("spark.framewright.chunkBytes", "77")
    try:
        assert Plan.of(1 << 45, spark).chunk_bytes == 77
    finally:
        spark.conf.unset("spark.framewright.chunkBytes")


def test_shared_folder(spark):
    """Only one machine alone may make a folder of its own."""
    from types import SimpleNamespace

    from framewright.llm import common

    def session(master, at):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: at), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None))

    assert common.shared_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y" and common.shared_dir(session("local[3]", None))
    for master in ("yarn", "local-cluster[2,1,512]", "spark://a:7077"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master, None))


def words_by_hand(rows, k):
    first = {}
    parts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in parts:
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, d), d, key=lambda x: (x is None, x or 0))
    out = []
    for d, w in parts:
        gone = set()
        for i in range(len(w) - k + 1):
            f = first[tuple(w[i : i + k])]
            if f is not None and (d is None or f < d):
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def tuples(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


W = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_words_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = words_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], 13)
    assert tuples(substring_dedup.substring_dedup(docs), W) == want
    assert sum(x[2] for x in want) > 1000


def test_words_small_windows_ties_and_nulls(docs_of, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, "", " \n", *[" ".join(rng.choice("abcdé") for _ in range(rng.randrange(30))) for _ in range(6)]])) for _ in range(60)]
    rows += [(30, "\ta  b\nc d  "), (31, "x a b c d"), (31, "x a b c d"), (31, "a b c y")]
    docs = docs_of(rows).repartition(5).withColumn("start", F.lit(1)).withColumn("src", F.lit("x"))
    assert tuples(substring_dedup.substring_dedup(docs, k=3), W) == words_by_hand(rows, 3)
    assert substring_dedup.substring_dedup(docs_of([])).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.substring_dedup(docs_of([(1, "a b c"), (2, "z a b c y")]), k=3, texts=True).collect()}
    assert kept == {1: "a b c", 2: "z y"}


def test_words_wrong_hash_is_caught(docs_of, monkeypatch):
    """With hashes of one byte in the blocks, different windows meet; the sources' words tell, and it is done again."""
    from framewright.llm import exchange

    whole = exchange.Plan.of
    calls = []

    def poor(items, spark=None, spare=7):
        p = whole(items)
        p.width = 1
        calls.append(p)
        return p

    monkeypatch.setattr(exchange.Plan, "of", staticmethod(poor))
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(200))) for i in range(20)]
    assert tuples(substring_dedup.substring_dedup(docs_of(rows), k=4), W) == words_by_hand(rows, 4)
    assert len(calls) == 2


def test_words_twins_and_texts_without_ids(docs_of):
    """Windows that no polynomial modulo 2 ** 64 tells apart; and many texts without an id, each with its own paths."""
    from test_similar import twins

    rng = random.Random(14)
    common = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{common} {twins()[0]}"), (2, f"{common} {twins()[1]}"), (3, f"{common} other"), (4, f"{common} {twins()[1]}")]
    rows += [(None, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for _ in range(80)]
    docs = docs_of(rows).repartition(3)
    assert tuples(substring_dedup.substring_dedup(docs), W) == words_by_hand(rows, 13)
    # digests in place of polynomials, as after a failure; sources that are asked in parts
    assert tuples(substring_dedup.substring_dedup(docs, k=3, attempt=1, asks=2), W) == words_by_hand(rows, 3)


def test_words_walks_are_cut_at_branching_nodes(spark, docs_of, monkeypatch):
    """A document's runs are cut where more than one distinct repeated edge enters or leaves, and nowhere else."""
    from collections import defaultdict

    from framewright.llm.exchange import NO_ID, Plan, with_text

    rng, k = random.Random(19), 4
    base = ["".join(rng.choice("abcdefgh") for _ in range(2)) for _ in range(700)]
    rows = []
    for i in range(40):
        a, b = sorted(rng.sample(range(700), 2))
        w = base[a:b]
        for _ in range(len(w) // 40):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    docs = {d: t.split() for d, t in rows}
    of = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - k + 1):
            of[tuple(w[i : i + k])].add(d)
    enters, leaves = defaultdict(set), defaultdict(set)
    for e, who in of.items():
        if len(who) > 1:
            enters[e[1:]].add(e)
            leaves[e[:-1]].add(e)
    branch = {v for v in {*enters, *leaves} if len(enters[v]) > 1 or len(leaves[v]) > 1}
    text = with_text(docs_of(rows).repartition(4))
    keyed = text.withColumns({"_d": F.coalesce("doc_id", F.lit(NO_ID)), "_t": F.col("text_hash")})
    monkeypatch.setattr(substring_dedup, "STRETCH", 3)
    walk = substring_dedup.graph(text, keyed, Plan.of(5000), k)
    n_cuts = 0
    for r in walk.collect():
        w = docs[r["src"]]
        places = range(r["src_start"] + 1, r["src_start"] + r["n"])
        assert r["cuts"] == [c for c in places if tuple(w[c : c + k - 1]) in branch]
        assert docs[r["_d"]][r["start"] : r["start"] + r["n"] + k - 1] == w[r["src_start"] : r["src_start"] + r["n"] + k - 1] and r["src"] < r["_d"]
        n_cuts += len(r["cuts"])
    assert n_cuts > 30 and branch
    assert tuples(substring_dedup.substring_dedup(docs_of(rows), k=k), W) == words_by_hand(rows, k)
    # degrees are an aggregation, the cuts joins
    nodes = spark.createDataFrame([], "node long, enters boolean, leaves boolean, src long, src_tag long, at int")
    runs = spark.createDataFrame([], "doc_id long, text_hash long, start array<int>, n array<int>, src array<long>, src_tag array<long>, src_start array<int>")
    plan = substring_dedup.walks(runs, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [node" in plan and plan.count("Join ") == 3 and "Python" not in plan


def test_words_a_passage_many_times_in_a_document(spark, docs_of, monkeypatch):
    """A document that goes over the same stretch of a source many times asks once where that is cut."""
    monkeypatch.setattr(substring_dedup, "STRETCH", 3)
    runs = [(2, 22, list(range(0, 400, 8)), [5] * 50, [1] * 50, [11] * 50, [10] * 50, [], []), (3, 33, [0, 90], [5, 20], [1, 1], [11, 11], [10, 4], [], [])]
    runs = spark.createDataFrame(runs, "doc_id long, text_hash long, start array<int>, n array<int>, src array<long>, src_tag array<long>, src_start array<int>, own_start array<int>, own_n array<int>")
    nodes = spark.createDataFrame([(7, True, True, 1, 11, 12), (7, True, True, 1, 11, 21), (8, True, True, 1, 11, 13)], "node long, enters boolean, leaves boolean, src long, src_tag long, at int")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        walk = substring_dedup.walks(runs, nodes)
        got = sorted((r["_d"], r["start"], r["n"], r["src_start"], r["cuts"]) for r in walk.collect())
        todo, made = [walk._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName() == "Generate" and "sequence" in node.toString().split("\n")[0]:
                made.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got == sorted([(2, a, 5, 10, [12]) for a in range(0, 400, 8)] + [(3, 0, 5, 10, [12]), (3, 90, 20, 4, [12, 21])])
    assert made == [5]  # runs of document 2 and 3 from 10 to 15, and the one from 4 to 24, by stretches of 8
    rows = [(1, "a b c d e f g h"), (2, "c d e f x"), (3, " ".join("a b c d e f g h y c d e f z".split() * 40))]
    assert tuples(substring_dedup.substring_dedup(docs_of(rows), k=3), W) == words_by_hand(rows, 3)


@pytest.mark.parametrize("seed", range(8))
def test_hashes_of_all_seeds(seed):
    """Equal spans have equal hashes wherever they stand, also behind a very long one; twins and lengths differ."""
    from test_similar import twins

    from framewright.llm import common

    a, b = (np.frombuffer(t.encode(), np.uint8) for t in twins())
    buf = np.concatenate([a, b, a, np.zeros(1 << 21, np.uint8), b[:70], np.zeros(1 << 21, np.uint8)])
    start = np.array([0, 1024, 2048, 3072, 3072 + (1 << 21), 3142 + (1 << 21)])
    end = np.array([1024, 2048, 3072, 3072 + (1 << 21), 3142 + (1 << 21), 3141 + (1 << 22)])
    h = common.spans_hash(buf, start, end, seed)
    assert h[0] == h[2] != h[1] and h[3] != h[5] and len(set(h.tolist())) == 5
    assert h[4] == common.spans_hash(b, np.array([0]), np.array([70]), seed)[0]
    assert h[0] != common.spans_hash(buf, start, end, (seed + 1) % 8)[0]
    long = np.concatenate([np.arange(7, dtype=np.uint8)] + [np.tile(buf, 5)] * 2)
    n = 5 * len(buf)
    assert n > 1 << 24 and len(set(common.spans_hash(long, np.array([7, 7 + n]), np.array([7 + n, 7 + 2 * n]), seed).tolist())) == 1


def bytes_by_hand(rows, size):
    parts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + size] for _, b in parts for i in range(len(b) - size + 1))
    out = []
    for d, b in parts:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"x" * size
        runs = len(re.findall(b"x+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


B = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("size,gram", [(12, 8), (30, 8), (30, 20)])
def test_bytes_small_sizes(docs_of, size, gram):
    rng = random.Random(size + gram)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randrange(150))) for _ in range(6)]
    rows = [(None, base[0]), (None, None), (7, ""), (7, "short"), (8, "ab" * 60), (9, "x" * 100), (10, "x" * (size + 1)), (11, "y" * size), (12, base[1]), (12, base[1])]
    for i in range(120):
        t = rng.choice(base)
        a, b = sorted(rng.randrange(len(t) + 1) for _ in range(2))
        u = list(rng.choice(base)[:40] + t[a:b] + rng.choice(base)[-30:])
        for _ in range(rng.randrange(3)):
            if u:
                u[rng.randrange(len(u))] = rng.choice("abz")
        rows.append((20 + i % 100, "".join(u)))
    docs = docs_of(rows).repartition(6).withColumn("marks", F.lit(1)).withColumn("start", F.lit("x"))
    want = bytes_by_hand(rows, size)
    assert tuples(suffix_dedup.suffix_dedup(docs, size, gram), B) == want
    # grams of more than two suffixes go by their strings' hashes
    assert tuples(suffix_dedup.suffix_dedup(docs, size, gram, most=2), B) == want
    assert suffix_dedup.suffix_dedup(docs_of([])).count() == 0


def test_bytes_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = bytes_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], 400)
    assert tuples(queries.op4_suffix_dedup(spark, "/root/testdata/sf0.01"), B) == want
    assert sum(x[2] for x in want) > 10_000


def test_merge_of_front_coded_runs():
    rng = random.Random(10)
    for n in (1, 2, 3, 7, 8):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(rng.randrange(20))) for _ in range(n)]
        coded = [suffix_dedup.front_coded(r) for r in runs if r]
        got = list(suffix_dedup.merged([suffix_dedup.decoded(a.tolist(), b.tolist(), c) for a, b, c in coded]))
        want = sorted(x for r in runs for x in r)
        assert [s for _, _, s in got] == want
        assert [p for _, p, _ in got] == [suffix_dedup.common(a, b) for a, b in zip([b"", *want], want)]


def test_reaches_of_random_groups():
    rng = random.Random(12)
    for _ in range(300):
        m, size = rng.randrange(2, 30), rng.randrange(4, 12)
        members = sorted((("z" + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))).encode(), "".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode()) for _ in range(m))
        right = np.array([0] + [suffix_dedup.common(a[0], b[0]) for a, b in zip(members, members[1:])])
        ask = np.array([rng.random() < 0.7 for _ in range(m)])
        got = sorted(suffix_dedup.reaches(right, [x[1] for x in members], ask, size))
        want = []
        for i in np.flatnonzero(ask).tolist():
            pairs = [(suffix_dedup.common(members[i][1], y[1]), suffix_dedup.common(members[i][0], y[0])) for j, y in enumerate(members) if j != i]
            pairs = [p for p in pairs if sum(p) >= size]
            if pairs:
                want.append((i, max(p[0] for p in pairs), max(p[1] for p in pairs)))
        assert got == want


def test_second_hashes(docs_of, monkeypatch):
    """As at a size where 64 bits are too few: the results are the same."""
    from framewright.llm import exchange, ngram_join

    whole = exchange.Plan.of

    def large(items, spark=None, spare=7):
        p = whole(items)
        p.width, p.check = 8, True
        return p

    assert whole(1 << 43).check and not whole(1 << 27).check
    monkeypatch.setattr(exchange.Plan, "of", staticmethod(large))
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(40))) for i in range(40)]
    assert tuples(substring_dedup.substring_dedup(docs_of(rows), k=4), W) == words_by_hand(rows, 4)
    assert tuples(suffix_dedup.suffix_dedup(docs_of(rows), 20, 8, most=3), B) == bytes_by_hand(rows, 20)
    assert ngram_join.ngram_join(docs_of(rows)).count() == 40
