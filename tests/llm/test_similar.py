"""N-gram join and decontamination against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framewright.llm import decontaminate, graph, ngram_join, queries

SF = "/root/testdata/sf0.01"


def words(t, lower=True):
    t = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components_by_hand(texts, percent=75, k=5):
    """Root of each index, over all pairs that share a shingle."""
    sets = [shingle_set(t, k) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    seen = set()
    for ids in at.values():
        if len(ids) > 1:
            for n, i in enumerate(ids):
                for j in ids[n + 1 :]:
                    if (i, j) not in seen and find(i) != find(j):
                        seen.add((i, j))
                        o = len(sets[i] & sets[j])
                        if 100 * o >= percent * len(sets[i] | sets[j]):
                            up[find(j)] = find(i)
    return sets, [find(i) for i in range(len(texts))]


def want_rows(rows, percent=75, k=5):
    sets, root = components_by_hand([t for _, t in rows], percent, k)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted([(d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root)], key=str)


def got_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.fixture(scope="module")
def near_copies():
    """Groups of edited copies around the threshold, exact copies, a passage that many share, short and odd texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, 14)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = word()
            rows.append((n := n + 1, " ".join(t)))
    for _ in range(15):
        rows.append((n := n + 1, " ".join([word() for _ in range(8)] + passage + [word() for _ in range(rng.randrange(3, 12))])))
    rows += [(1000, None), (1001, ""), (1002, "One  Two"), (1003, "one two"), (1004, "a b c d e"), (None, "A B c d e"), (None, None), (None, "lonely words in here now"), (1005, rows[0][1].upper()), (1005, rows[0][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("group", [2000, 4])
def test_join_by_hand(docs_of, near_copies, group):
    docs = docs_of(near_copies).repartition(3).withColumn("node", F.lit(1)).withColumn("n", F.lit("x"))
    assert got_rows(ngram_join.ngram_join(docs, group=group)) == want_rows(near_copies)


@pytest.mark.parametrize("group,wide", [(2000, 64), (4, 64), (4, 1), (2000, 0), (4, 3)])
def test_join_counts_every_link(docs_of, near_copies, group, wide):
    sets = [shingle_set(t) for _, t in near_copies]
    want = [sum(i != j and bool(x) and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    docs = docs_of(near_copies).repartition(3)
    got = ngram_join.ngram_join(docs, group=group, wide=wide).select("doc_id", "n_shingles", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(d, len(s), n) for (d, _), s, n in zip(near_copies, sets, want)], key=str)
    assert max(want) > 3
    assert got_rows(ngram_join.ngram_join(docs, group=group, spanning=True, wide=wide)) == want_rows(near_copies)


def test_join_of_groups_that_grow_together(spark, docs_of):
    """A chain of texts that share passages is one candidate group; by token, few of its sets meet in one task."""
    rng = random.Random(22)
    passage = [" ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40)) for _ in range(240)]
    rows = [(i, f"{passage[i]} {passage[i + 1]}") for i in range(239)] + [(300 + i, f"{passage[i]} {passage[i + 1]} more") for i in range(0, 239, 5)]
    docs = docs_of(rows)
    want = want_rows(rows)
    assert got_rows(ngram_join.ngram_join(docs, percent=75, group=20, wide=2)) == want and sum(d != c for d, _, c in want) == 48
    sets = [(bytes([i // 256, i % 256]), 80, 1, b"") for i in range(1, 280)]
    reps = spark.createDataFrame(sets, "node binary, n long, m long, tokens binary")
    post = spark.createDataFrame([(t, x[0]) for i, x in enumerate(sets) for t in (i, i + 1, 7 if i < 50 else 1000 + i)], "token long, node binary")
    met = ngram_join.by_tokens(reps, post, 20).groupBy("cc", "i", "j").count().agg(F.max("count"), F.sum("count")).first()
    assert met[0] <= 60 and met[1] < 4 * len(sets) + 50 * 3


def test_join_local_emits_every_link():
    """In a group of near copies each pair is a link, also where others join both already."""
    sets = [sorted({*range(40)} - {i}) for i in range(12)]
    links = [tuple(sorted(x)) for x in ngram_join.join_local(sets, [39] * 12, 75)]
    assert sorted(links) == [(a, b) for a in range(12) for b in range(a + 1, 12)]


def test_join_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = want_rows(rows)
    assert got_rows(queries.op7_ngram_join(spark, SF)) == want
    assert sum(d != c for d, _, c in want) > 20
    one = ngram_join.one_of_each(docs, ngram_join.ngram_join(docs))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in want}) and one.columns == docs.columns


def test_join_one_of_each_repeated_rows(docs_of):
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "x y"), (None, "x y"), (None, None), (5, None)])
    got = ngram_join.one_of_each(docs, ngram_join.ngram_join(docs)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == [(1, "a b c d e f"), (3, "x y"), (5, None)] and len(got) == 4
    assert ngram_join.ngram_join(docs_of([])).count() == 0


def test_join_local_derives_answers():
    """Highly similar sets answer each other; the links still give the components of all pairs."""
    rng = random.Random(8)
    for _ in range(40):
        base = list(range(60))
        sets = []
        for _ in range(25):
            s = set(base)
            for _ in range(rng.randrange(12)):
                s.discard(rng.randrange(60))
                s.add(rng.randrange(60, 90))
            sets.append(sorted(s))
        df = {t: sum(t in s for s in sets) for s in sets for t in s}
        ordered = [sorted(s, key=lambda t: (df[t], t)) for s in sets]
        count: dict = {}
        links = ngram_join.join_local(ordered, [len(s) for s in sets], 80, count=count)
        uf, want = ngram_join.Union(25), ngram_join.Union(25)
        for a, b in links:
            assert 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})
            uf.join(a, b)
        for a in range(25):
            for b in range(a):
                if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]}):
                    want.join(a, b)
        assert [uf.find(i) for i in range(25)] == [want.find(i) for i in range(25)]
    assert count


@pytest.mark.parametrize("local", [0, 30, 1000])
def test_components(spark, local):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    uf = ngram_join.Union(200)
    for a, b in links:
        uf.join(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long"), local).collect()}
    assert got == {n: uf.find(n) for ab in links if ab[0] != ab[1] for n in ab}
    assert graph.components(spark.createDataFrame([], "a long, b long"), local).count() == 0


# ------------------------------------------------------------------ decontamination


def leaks_by_hand(docs, items, contained=0.75, k=5):
    out = []
    for d, t in docs:
        w = words(t)
        have = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, k + 1)}
        for i, x in items:
            s = shingle_set(x, k)
            if s:
                o = len(s & have[len(next(iter(s)))])
                if o and o >= contained * len(s):
                    out.append((d, i, o, len(s)))
    return sorted(out, key=str)


def found_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "item_id", "shared", "shingles").collect()), key=str)


def test_leaks_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = leaks_by_hand(docs, items)
    assert found_rows(queries.op6_decontaminate(spark, SF)) == want and want


def test_leaks_hashes_of_small_items():
    """Also an item just above half of its class's size is missed by all hashes with a chance of 3e-10 at most."""
    for n in (33, 40, 64, 65):
        items = decontaminate.Items([1], [" ".join(f"w{i}" for i in range(n + 4)).encode()], 5, decontaminate.HASHES)
        ((size, tables),) = items.classes.items()
        o = -(-3 * n // 4)
        p = o / (2 * size + n - o)
        assert len(items.sets[0]) == n and (1 - p) ** len(tables) <= 3e-10


def test_leaks_edges(spark, docs_of):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 17, 60])))) for i in range(40)] + [(None, None), (41, ""), (42, " \n"), (None, "Null item of six words here"), (3, "same id other text of an item")]
    docs = []
    for i in range(150):
        t = [word() for _ in range(rng.randrange(400))]
        for _, x in rng.sample(items, 3):
            p = (x or "").split()
            if p and rng.random() < 0.5:
                p[rng.randrange(len(p))] = word()
            a = rng.randrange(len(t) + 1)
            t[a:a] = [q.upper() for q in p]
        docs.append((i, " ".join(t)))
    docs += [(None, items[7][1]), (1005, None), (1006, "")] + docs[:2]
    d, b = docs_of(docs).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    found = decontaminate.leaks(d, b)
    assert found_rows(found) == leaks_by_hand(docs, items)
    assert found_rows(decontaminate.leaks(d, b, per_round=10)) == leaks_by_hand(docs, items)
    clean = decontaminate.decontaminated(d, found)
    bad = {x[0] for x in leaks_by_hand(docs, items)}
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == {x[0] for x in docs if x[0] not in bad}
    assert decontaminate.leaks(docs_of([]), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


# ------------------------------------------------------------------ words that share their polynomials modulo 2 ** 64


def twins(n=10):
    """Two words of 2 ** n letters a and b, complements of each other, that no polynomial modulo 2 ** 64 tells apart from n = 10 on."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_twins_are_different(spark, docs_of):
    a, b = twins()
    assert sorted(r["component_id"] for r in ngram_join.ngram_join(docs_of([(1, a), (2, b)])).collect()) == [1, 2]
    items = spark.createDataFrame([(7, a), (8, f"one two three {b} five six")], "item_id long, text string")
    docs = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"x one two three {a} five six"), (4, f"x one two three {b} five six")]
    assert found_rows(decontaminate.leaks(docs_of(docs), items)) == sorted([(1, 7, 1, 1), (3, 7, 1, 1), (4, 8, 2, 2)], key=str)
