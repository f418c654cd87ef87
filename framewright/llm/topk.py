"""Exact top-k inner-product search by the three-phase uniform threshold.

The components are dealt to ``NODES`` nodes.  A node has its own components of all vectors and no others; its local score of a
vector is the inner product over these, and the sum of the nodes' local scores is the score.

1. Each node lists its best vectors for a query, block by block.  What is listed is resolved, and the k-th best score of it
   is a lower bound t of the k-th best of all.
2. The safe cutoff t / m for m nodes is broadcast back with the queries.  A vector of score t or more has a local score of
   t / m or more at one node at least, so each node hands in its entries from there on: these suffice.
3. For each entry the scores that other nodes have not handed in are resolved exactly from their components, and the k best
   stay, ties to the smaller id.  Only what was handed in gets a score: with two nodes about a twentieth of all pairs of
   vectors without any order, fewer where they have some.

Vectors and queries are dealt in blocks, and each node joins its blocks of both.  Blocks of vectors grow with the table to
``MOST_ROWS``, so queries are copied as rarely as memory allows.  A block hands on k scores a query at most, which loses
nothing, as the k best of all are among the k best of each block.

Defined results: a vector that is null, empty, or holds null or non-finite components takes no part; vectors meet those of
their own length only; a query with fewer than k candidates returns them all; an empty table gives an empty table; repeated
ids are separate candidates unless they are the query's own, and repeated queries share one list; scores are longs, modulo
2 ** 64; further columns are not looked at; a very long vector is held whole by its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .exchange import pack, unpack

NODES = 2
#: Vectors in a block, at least and at most, and queries; of vectors, ``ROWS`` are scored at once.
ROWS, MOST_ROWS, QUERIES = 4096, 65_536, 512
#: Quantized components are exact in a double product below this.
_EXACT = float(1 << 53)
#: Below every score: no bound.
_NONE = -(1 << 63)


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) as array<long>, without vectors that take no part."""
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", F.when(fine, F.transform(x, lambda c: F.floor(c * scale).cast("long"))).alias("v")).filter(F.col("v").isNotNull())


def _blocks(rows: DataFrame, n: int, nodes: int) -> DataFrame:
    """Rows dealt to n blocks by id: ``b, dim, ids, parts``, little-endian longs; ``parts`` has each node's components."""

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(part["v"].to_numpy()).astype("<i8")
        parts = [_small(x) for x in np.array_split(v, min(nodes, v.shape[1]), axis=1)]
        return pd.DataFrame({"b": [part["b"].iloc[0]], "dim": [v.shape[1]], "ids": [part["vec_id"].to_numpy().astype("<i8").tobytes()], "parts": [parts]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(n)).cast("int")).withColumn("dim", F.size("v"))
    return dealt.groupBy("b", "dim").applyInPandas(deal, "b int, dim int, ids binary, parts array<binary>")


def _small(v: np.ndarray) -> bytes:
    """In as few bytes a component as hold them all; the first byte says how many."""
    for kind in ("<i1", "<i2", "<i4"):
        if v.size and np.iinfo(kind).min <= v.min() and v.max() <= np.iinfo(kind).max:
            return bytes([int(kind[-1])]) + v.astype(kind).tobytes()
    return b"\x08" + v.astype("<i8").tobytes()


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(n, -1)


def _exact(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether a product of the two is exact in doubles."""
    return float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(r.astype(float)).max(initial=0)) * q.shape[1] < _EXACT


def _entries(pairs: DataFrame, k: int, nodes: int) -> DataFrame:
    """``rb, qb, dim, node, n, entries`` of each node's pairs of blocks: with the column ``cuts`` all local scores from a
    query's cutoff on, else the k best of each query; ``entries`` has (query, vector, local score) by place in the blocks.
    """
    cut = "cuts" in pairs.columns

    def chosen(local: np.ndarray, own: np.ndarray, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        if least is not None:
            return np.nonzero((local >= least[:, None]) & ~own)
        m = min(k + 1, local.shape[1])
        at = np.argpartition(local, local.shape[1] - m, axis=1)[:, local.shape[1] - m :]
        i = np.repeat(np.arange(len(local)), m)
        fine = ~own[i, at.ravel()]
        return i[fine], at.ravel()[fine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                qi, ri = np.frombuffer(b.qids, "<i8"), np.frombuffer(b.ids, "<i8")
                q, r = _matrix(b.qdata, len(qi)), _matrix(b.data, len(ri))
                fine = _exact(q, r)
                kind = np.float64 if fine else np.int64
                least = None
                if cut:  # the least whole number from t / m on; scores that may overflow are all handed in
                    m = min(nodes, b.dim)
                    t = np.frombuffer(b.cuts, "<i8")
                    least = np.where(t == _NONE, -np.inf if fine else _NONE, -((-t) // m)) if fine else np.full(len(t), _NONE)
                got: list[list[np.ndarray]] = [[], [], []]
                for lo in range(0, len(ri), ROWS):
                    local = q.astype(kind) @ r[lo : lo + ROWS].astype(kind).T
                    x, y = chosen(local, qi[:, None] == ri[None, lo : lo + ROWS], least)
                    for c, v in zip(got, (x, y + lo, local[x, y].astype(np.int64))):
                        c.append(v)
                x, y, s = (np.concatenate(c) for c in got)
                yield pd.DataFrame({"rb": [b.rb], "qb": [b.qb], "dim": [b.dim], "node": [b.node], "n": [len(x)], "entries": [pack(x, y, s)]})

    return pairs.mapInPandas(run, "rb int, qb int, dim int, node int, n long, entries binary")


def _resolved(entries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of what was handed in: the k best of each query in each pair of blocks.

    Of an entry's local scores those that a node has handed in are known; the others are made from its components.
    """

    def local(q: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for lo in range(0, len(x), 1 << 17):
            i = slice(lo, lo + (1 << 17))
            out[i] = np.einsum("ij,ij->i", q[x[i]].astype(np.int64), r[y[i]].astype(np.int64))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                qi, ri = np.frombuffer(b.qids, "<i8"), np.frombuffer(b.ids, "<i8")
                sent = [(e["node"], *unpack(e["entries"])) for e in b.sent]
                key = np.unique(np.concatenate([x * len(ri) + y for _, x, y, _ in sent]))
                x, y = key // max(len(ri), 1), key % max(len(ri), 1)
                total = np.zeros(len(key), np.int64)
                told = {node: (i * len(ri) + j, s) for node, i, j, s in sent}
                for node, (qd, rd) in enumerate(zip(b.qparts, b.parts)):
                    lacks = np.ones(len(key), bool)
                    if node in told:
                        at = np.searchsorted(key, told[node][0])
                        total[at] += told[node][1]
                        lacks[at] = False
                    total[lacks] += local(_matrix(qd, len(qi)), _matrix(rd, len(ri)), x[lacks], y[lacks])
                order = np.lexsort((ri[y], ~total, x))  # by query, the highest score first
                x, y, total = x[order], y[order], total[order]
                nth = np.arange(len(x)) - np.searchsorted(x, x)
                best = nth < k
                yield pd.DataFrame({"query_id": qi[x[best]], "vec_id": ri[y[best]], "score": total[best]})

    return entries.mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, nodes: int = NODES, rows: int | None = None, queries: int = QUERIES, counted: list | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every``, the k best of all others.

    ``rows`` is the number of vectors in a block, by default as the table and the number of tasks have it.  ``counted``
    gets the DataFrame of what the nodes hand in, whose ``n`` add up to the local scores sent.
    """
    spark = vectors.sparkSession
    v = quantized(vectors)
    n = v.count()
    rows = rows or min(MOST_ROWS, max(ROWS, n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    nr, nq = max(1, -(-n // rows)), max(1, -(-n // (every * queries)))
    r = written(_blocks(v, nr, nodes), "vectors").withColumnRenamed("b", "rb")
    q = written(_blocks(v.filter(F.col("vec_id") % every == 0), nq, nodes), "queries").select(F.col("b").alias("qb"), "dim", F.col("ids").alias("qids"), F.col("parts").alias("qparts"))

    def handed(asked: DataFrame) -> DataFrame:
        """Each node joins its own components: blocks of queries go to each block of vectors, by the blocks' numbers."""
        more = [c for c in asked.columns if c == "cuts"]
        mine = asked.select("qb", "dim", "qids", *more, F.posexplode("qparts").alias("node", "qdata"))
        dealt = mine.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).hint("shuffle_hash")
        slices = r.select("rb", "dim", "ids", F.posexplode("parts").alias("node", "data"))
        return _entries(slices.join(dealt, ["node", "rb", "dim"]), k, nodes)

    def scores(entries: DataFrame) -> DataFrame:
        """What the nodes hand in for two blocks meets there with these: an entry list a node."""
        met = entries.groupBy("rb", "qb", "dim").agg(F.collect_list(F.struct("node", "entries")).alias("sent"))
        return _resolved(met.join(r, ["rb", "dim"]).join(q, ["qb", "dim"]), k)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = scores(handed(q)).withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("score").alias("t"))

    def with_cuts(asked: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(cuts["query_id"], cuts["t"]))
        asked["cuts"] = [np.array([have.get(i, _NONE) for i in np.frombuffer(x, "<i8").tolist()], "<i8").tobytes() for x in asked["qids"]]
        return asked

    cuts = kth.withColumn("qb", F.pmod(F.xxhash64(F.lit(9), "query_id"), F.lit(nq)).cast("int"))
    cut = q.groupBy("qb").cogroup(cuts.groupBy("qb")).applyInPandas(with_cuts, "qb int, dim int, qids binary, qparts array<binary>, cuts binary")
    enough = handed(written(cut, "cuts"))
    if counted is not None:
        counted.append(enough)
    return scores(enough).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
