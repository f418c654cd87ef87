"""N-gram Jaccard join with set-relation skipping.

1. The shingle sets of all documents meet by hash (:mod:`exchange`), which gives each shingle its exact document count.
   A document too few of whose shingles are in another one can have no partner and ends there, without becoming a set row.
2. Equal sets become one class; one representative goes on.
3. Shingles are in one order, rare first.  Two sets that link share a shingle of their prefixes; who shares one falls into
   one candidate group (a few Spark joins), and a group's sets meet in one task, or in pairs of blocks if they are many.
   Where groups have grown together to more than ``WIDE`` blocks, as those of large corpora may, their sets meet by the
   tokens of their prefixes instead, which copies a set as often as its prefix is long and no more; a token that many sets
   have is dealt in pairs of blocks again, and a link belongs to the first token that both prefixes have.
4. In a task the sets are joined exactly.  The index lists are cut in blocks by position; blocks whose position leaves too
   little room for the overlap are skipped.  A set that is highly similar to one already answered derives its answers from
   that one's: |x & y| lies within what x and z differ in of |z & y|, so many partners are accepted or rejected unread.
   Every link is found and counted for both its sets; what leaves the task are these counts, a row a set, and the links
   that span its components, as the links of a group of near copies grow with its square.  Where only components are asked
   for (``spanning``), partners of one already are skipped.
5. Connected components of the spanning links, and each document's number of links, where a class counts for all its
   documents.  Nodes are ordered by doc_id, so a component's root tells its smallest one.

Two shingles count as one if the bits of their hashes that the exchange's plan keeps are the same (62 of 64 up to some GB,
94 beyond): different ones do with a chance below one in a hundred for any two of the whole corpus.

Defined results: null text and text without words has 0 shingles and no links; fewer words than k are one shingle; a null
doc_id is nobody's smallest, and its component_id is null if it links with nothing; repeated rows link with each other; an
empty table gives an empty table; further columns are not looked at.  A very long text is a chunk of its own, and its set
one row; words may be of any length.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, fresh, lean, released, shingles, written
from .exchange import NO_ID, Docs, Plan, alike, blocks, exchange, pack, unpack, with_text
from .graph import components

K = 5
#: Sets that meet in one task; larger candidate groups are dealt in pairs of blocks.
GROUP = 2000
#: Blocks of a candidate group beyond which its sets meet by token.
WIDE = 64
#: Positions in a block of an index list.
STEP = 16
_SETS = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("set", pa.binary()), ("tokens", pa.binary())])


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): each document's distinct shingles, ascending."""
    doc, h = shingles(Words(texts, lower=True), k)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), h


def _emit(k: int):
    def emit(plan: Plan, chunk: int, ids: np.ndarray, hashes: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        first, h = _sets(texts, k)
        return blocks(plan, chunk, Docs(ids, hashes, first), np.arange(len(h)), h, times=True, places=False)

    return emit


def _counted(plan: Plan, bucket: int, sent: list[list[np.ndarray]]) -> Iterator[bytes | None]:
    """For each chunk's shingles of two or more documents: (position, documents, identity)."""
    sizes = [len(x[0]) for x in sent]
    key, order, new = alike(plan, sent)
    times = np.concatenate([x[6] for x in sent])
    edge = np.flatnonzero(new)
    df = np.empty(len(order), np.int64)
    df[order] = np.repeat(np.add.reduceat(times[order], edge), np.diff(np.append(edge, len(order))))
    at = 0
    # as much of the hash as the plan kept, made one number again
    front = np.uint64(bucket) << np.uint64(64 - plan.bits)
    for x, n in zip(sent, sizes):
        d = df[at : at + n]
        i = np.flatnonzero(d > 1)
        kept = key[at : at + n][i]
        token = (kept << np.uint64(64 - 8 * plan.width)) >> np.uint64(plan.bits) | front if plan.width < 8 else kept
        yield pack(x[0][i], d[i], token.astype("<u8").view("V8")) if len(i) else None
        at += n


def _candidates(percent: int):
    def gather(docs: Docs, own: list[np.ndarray], answers: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        size = int(docs.first[-1])
        df, token = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        for pos, d, t in answers:
            df[pos], token[pos] = d, np.frombuffer(t.tobytes(), "<u8")
        other, rep = own
        df[other], token[other] = df[rep], token[rep]
        n = np.diff(docs.first)
        at = np.flatnonzero(df > 1)
        doc = docs.of(at)
        s = np.bincount(doc, minlength=len(n))
        may = (s > 0) & (100 * s >= percent * n)
        at = at[may[doc]]
        at = at[np.lexsort((token[at], df[at], docs.of(at)))]  # rare first
        cuts = np.searchsorted(docs.of(at), np.arange(len(n) + 1))
        t, d = token[at].astype("<u8"), df[at]
        cols: tuple[list, ...] = ([], [], [], [], [])
        for i in range(len(n)):
            same = tokens = None
            node = struct.pack(">Qq", int(docs.ids[i]) + (1 << 63), int(docs.text_hash[i]))
            if may[i]:
                mine = t[cuts[i] : cuts[i + 1]]
                tokens = pack(mine.view("V8"), d[cuts[i] : cuts[i + 1]])
                same = hashlib.blake2b(np.sort(mine).tobytes(), digest_size=16).digest() if len(mine) == n[i] else node
            for c, v in zip(cols, (None if docs.ids[i] == NO_ID else int(docs.ids[i]), node, int(n[i]), same, tokens)):
                c.append(v)
            if len(cols[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SETS)], schema=_SETS)
                cols = ([], [], [], [], [])
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SETS)], schema=_SETS)

    return gather


def _least(n: int, percent: int) -> int:
    """Overlap that a set of n needs with any partner."""
    return -(-percent * n // 100)


def _postings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            tokens, nodes = [], []
            for node, n, t in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist()):
                mine = np.frombuffer(unpack(t)[0].tobytes(), "<i8")
                # shingles of one document only come first in the order and meet nobody
                upto = n - _least(n, percent) + 1 - (n - len(mine))
                tokens.append(mine[: max(0, upto)])
                nodes += [node] * len(tokens[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)), pa.array(nodes, pa.binary())], names=["token", "node"])

    return run


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def join_local(sets: list[list[int]], sizes: list[int], percent: int, side: list[int] | None = None, known: list[int] | None = None, count: dict | None = None, spanning: bool = False, only: int | None = None) -> Iterator[tuple[int, int]]:
    """Links among ``sets`` (shared tokens in one order, rare first; ``sizes`` with the others), each of them once.

    With ``side``, only sets of different sides are compared.  With ``spanning``, only links that span each component come
    out; ``known`` has numbers of components known before then.  With ``only``, links whose sets have another token than that
    as the first one in both prefixes are left to it.
    """
    uf, stats = Union(len(sets)), count if count is not None else {}
    if known:
        seen: dict[int, int] = {}
        for i, c in enumerate(known):
            uf.join(seen.setdefault(c, i), i)
    as_set: dict[int, set[int]] = {}
    index: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    answers: dict[int, dict[int, int]] = {}
    prefixes: dict[int, set[int]] = {}
    for x in sorted(range(len(sets)), key=lambda i: sizes[i]):
        n, mine, least = sizes[x], sets[x], _least(sizes[x], percent)
        unique = n - len(mine)
        shared: Counter[int] = Counter()
        prefix = mine[: max(0, n - least + 1 - unique)]
        for i, t in enumerate(prefix):
            if t not in index:
                continue
            room = n - unique - i
            for block, ys in index[t].items():
                # what stands at or behind this position in a partner of at most this size
                if min(room, n - block * STEP) < least:
                    stats["blocks skipped"] = stats.get("blocks skipped", 0) + 1
                    continue
                shared.update(ys)
        mine_set = as_set[x] = set(mine)
        if only is not None:
            prefixes[x] = set(prefix)
        found: dict[int, int] = {}
        z = None  # the most similar set that has been answered
        for y, _ in shared.most_common():
            if 100 * sizes[y] < percent * n or (side is not None and side[x] == side[y]) or (spanning and uf.find(x) == uf.find(y)):
                continue
            if only is not None and next(t for t in prefix if t in prefixes[y]) != only:
                continue
            need = -(-percent * (n + sizes[y]) // (100 + percent))
            if z is not None and (o := answers[z].get(y)) is not None:
                if o - (len(sets[z]) - found[z]) >= need:
                    stats["accepted unread"] = stats.get("accepted unread", 0) + 1
                    uf.join(x, y)
                    yield x, y
                    continue
                if o + (len(mine) - found[z]) < need:
                    stats["rejected unread"] = stats.get("rejected unread", 0) + 1
                    continue
            o = len(mine_set & as_set[y])
            found[y] = o
            if z is None or o > found[z]:
                z = y
            if o >= need:
                uf.join(x, y)
                yield x, y
        answers[x] = found
        if side is None:  # sets of one side have no answers to derive from
            for y, o in found.items():
                answers[y][x] = o
        for i, t in enumerate(prefix):
            index[t][(unique + i) // STEP].append(x)


_MEET = ["cc", "i", "j"]
#: A link that spans, or with no ``b`` the number of documents that those of ``a`` link with here.
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def _join(percent: int, spanning: bool, by_token: bool):
    """Joins the sets of each run of equal keys; one run is in memory at a time."""

    def out(rows: list[dict]) -> Iterator[tuple]:
        sets = [np.frombuffer(unpack(r["tokens"])[0].tobytes(), "<i8").tolist() for r in rows]
        cross = rows[0]["i"] != rows[0]["j"]
        known = [r["known"] for r in rows] if cross and spanning and not by_token else None
        uf, linked = Union(len(rows)), [0] * len(rows)
        for a, b in join_local(sets, [r["n"] for r in rows], percent, [r["b"] for r in rows] if cross else None, known, spanning=spanning, only=rows[0]["cc"] if by_token else None):
            linked[a] += rows[b]["m"]
            linked[b] += rows[a]["m"]
            if uf.join(a, b):
                yield rows[a]["node"], rows[b]["node"], None
        if not spanning:
            yield from ((r["node"], None, n) for r, n in zip(rows, linked) if n)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        key, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (now := tuple(r[c] for c in _MEET)) != key:
                    if len(rows) > 1:
                        yield rows
                    key, rows = now, []
                rows.append(r)
        if len(rows) > 1:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        links = (link for rows in runs(batches) for link in out(rows))
        while some := list(islice(links, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), _LINKS)], schema=_LINKS)

    return run


def _meet(dealt: DataFrame, percent: int, spanning: bool, by_token: bool = False) -> DataFrame:
    cols = dealt.select(*_MEET, "b", "node", "n", "m", "tokens", "known")
    return cols.repartition(*_MEET).sortWithinPartitions(*_MEET).mapInArrow(_join(percent, spanning, by_token), "a binary, b binary, n long")


def _pairs(dealt: DataFrame) -> DataFrame:
    """``dealt(b, blocks)`` with ``i, j``: a copy for each pair of the row's block and another."""
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("b"))
    return dealt.withColumn("other", F.explode(other)).withColumns({"i": F.least("b", "other"), "j": F.greatest("b", "other")})


def by_tokens(sets: DataFrame, post: DataFrame, group: int) -> DataFrame:
    """``cc, i, j, b, node, n, m, tokens, known``: copies of ``sets`` for each token of their prefixes that another has too."""
    mine = post.join(sets.select("node"), "node", "left_semi")
    size = mine.groupBy("token").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("token").alias("cc"), F.ceil(F.col("_n") / group).cast("int").alias("blocks"))
    copies = mine.select(F.col("token").alias("cc"), "node").join(size, "cc").join(sets, "node")
    dealt = copies.withColumns({"b": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "known": F.lit(0).cast("long")})
    return dealt.withColumns({"i": F.col("b"), "j": F.col("b")}).unionByName(_pairs(dealt.filter("blocks > 1")).drop("other"))


def links(reps: DataFrame, percent: int, group: int = GROUP, spanning: bool = False, wide: int = WIDE) -> DataFrame:
    """``a, b, n``: links between ``reps(node, n, m, tokens)`` that span each component, and rows without ``b``, whose ``n`` add
    up to the ``m`` of all that a node links with; with ``spanning``, none of these.
    """
    post = written(reps.select("node", "n", "tokens").mapInArrow(_postings(percent), "token long, node binary"), "postings")
    first = post.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select("token", "a")
    near = components(post.join(first, "token").filter("node != a").select("a", F.col("node").alias("b")).distinct())
    labels = written(near.select("node", F.col("root").alias("cc")), "candidates")
    sized = labels.groupBy("cc").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    every = reps.select("node", "n", "m", "tokens").join(labels.join(sized, "cc"), "node")
    mine = every.filter(F.col("blocks") <= wide).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    within = _meet(mine.withColumns({"i": F.col("b"), "j": F.col("b"), "known": F.lit(0).cast("long")}), percent, spanning)
    most = sized.agg(F.max("blocks").alias("most"), F.max(F.when(F.col("blocks") <= wide, F.col("blocks"))).alias("many")).first()
    out = within
    if (most["many"] or 0) > 1:
        # groups of many blocks: every two blocks meet for the rest; what the blocks' own links join is known
        many = mine.filter("blocks > 1").withColumn("known", F.lit(0).cast("long"))
        if spanning:
            out = within = written(within, "links")
            known = components(within.select("a", "b")).select("node", F.xxhash64("root").alias("known"))
            many = many.drop("known").join(known, "node", "left").withColumn("known", F.coalesce("known", F.xxhash64("node")))
        out = out.unionByName(_meet(_pairs(many), percent, spanning))
    if (most["most"] or 0) > wide:
        grown = written(every.filter(F.col("blocks") > wide).select("node", "n", "m", "tokens"), "grown")
        out = out.unionByName(_meet(by_tokens(grown, post, group), percent, spanning, True))
    return out


def ngram_join(docs: DataFrame, k: int = K, percent: int = 75, group: int = GROUP, spanning: bool = False, wide: int = WIDE) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` of each row of ``docs(doc_id, text)``, and ``node`` and ``component``, the
    row's and the component's identity.  ``n_links`` is the number of other rows that link with the row; with ``spanning``,
    only components are made, and it is left out.

    Two documents link if 100 * |x & y| >= percent * |x | y| for their sets of distinct lower-cased k-word shingles.
    """
    rows = with_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan.of(size // 5, docs.sparkSession)
    sets = written(exchange(rows, plan, _emit(k), _counted, _candidates(percent), "doc_id long, node binary, n long, set binary, tokens binary"), "sets")
    released(docs.sparkSession, size)
    some = sets.filter(F.col("set").isNotNull())
    reps = written(some.groupBy("set").agg(F.min_by(F.struct("node", "n", "tokens"), "node").alias("r"), F.count("*").alias("m")).select("set", "m", "r.*"), "classes")
    linked = links(reps, percent, group, spanning, wide)
    linked = linked if spanning else written(linked, "links")
    roots = components(linked.filter(F.col("b").isNotNull()).select("a", "b"))
    of = reps.select("set", "node", "m").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = [] if spanning else ["n_links"]
    if not spanning:
        # a link between classes links each document of the one with each of the other; those of one class link too
        others = linked.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        of = of.join(others, "node", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("m") - 1)
    least = F.nullif(_number("root", 1).bitwiseXOR(F.lit(-(1 << 63))), F.lit(NO_ID))
    classes = of.select("set", least.alias("component_id"), *counted, F.col("root").alias("component"))
    out = some.select("doc_id", "n", "node", "set").join(classes, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *counted, "node", "component")
    alone = sets.filter(F.col("set").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in counted], "node", F.col("node").alias("component"))
    return out.unionByName(alone)


def _number(col: str, at: int) -> Column:
    """The 8 bytes of a node from a place on, as a long."""
    return F.conv(F.hex(F.substring(col, at, 8)), 16, -10).cast("long")


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, of the smallest doc_id.

    The row number after the join needs no further exchange, as it is dealt by the same two columns.
    """
    i, h, nth = fresh(docs, "_id", "_h", "_nth")
    first = joined.filter("node = component").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(i), _number("node", 9).alias(h)).distinct()
    rows = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), h: F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = rows.join(first, [i, h])
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(i, h).orderBy(F.lit(0)))).filter(F.col(nth) == 1).select(*docs.columns)
