"""Substring dedup by De Bruijn compaction.

Every window of k words is an edge of the De Bruijn graph, from the node of its first k - 1 words to that of its last.

1. Edges.  The edges of all documents meet by hash (:mod:`exchange`), which gives each that repeats its source: the
   smallest document that it starts in, and the place there.  A source learns which of its edges repeat.  What follows each
   other in a document and in its source goes on as one run, as a combiner's work; all further steps are Spark's.
2. Degrees.  The nodes of the repeated edges become rows, one for each distinct edge's end, from the sources' texts alone;
   an aggregation by node gives how many distinct repeated edges enter and leave it.
3. Compaction.  A join with the nodes that branch (more than one edge in or out) tells where the sources' runs are cut:
   what lies between two cuts is a maximal nonbranching path of the graph, with coordinates in its source.  A join by
   source and stretch of places cuts the runs of all documents at the same nodes, so each is a walk over such paths; what a
   document goes over many times enters it once.
4. Verification.  A join brings each distinct path (or part of one where a walk begins or ends inside) to the text of its
   source, and its exact words are compared through 128-bit digests with those of every document that walks it.

  Should a path fail, the exchange is run again on 96 bits of
the windows' own digests, so equal polynomials alone never remove a word.

A text is told by its id and the whole of its 64-bit hash, so texts without an id don't get each other's paths.  Spans
that a popular source is asked for go to its text in parts of ``ASKS``, so no row has more of them.

Defined results: null text has no words; a null doc_id counts as larger than all others; rows with the same doc_id never
remove words from each other; repeated rows each get the same result; windows are judged on the input; an empty table
gives an empty table; further columns are not looked at.  A very long text is a chunk of its own; words may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, digests, lean, released, spans_hash, written
from .exchange import NO_ID, Docs, Plan, alike, blocks, exchange, groups, pack, with_text

K = 13
#: Spans of one source that one row asks for.
ASKS = 10_000
#: Places of a source that meet the runs over them at once, as a power of two.
STRETCH = 9
_RUNS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("src", pa.list_(pa.int64())), ("src_tag", pa.list_(pa.int64())), ("src_start", pa.list_(pa.int32())), ("own_start", pa.list_(pa.int32())), ("own_n", pa.list_(pa.int32()))])


def _emit(k: int, attempt: int):
    def emit(plan: Plan, chunk: int, ids: np.ndarray, hashes: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        words = Words(texts)
        at, h = words.windows(k)
        check = None
        if attempt:
            h, check = digests(words.buf, words.start[at], words.end[at + k - 1])
        elif plan.check:
            check = words.windows(k, 1)[1]
        return blocks(plan, chunk, Docs(ids, hashes, words.first), at, h, check=check)

    return emit


def sources(plan: Plan, bucket: int, sent: list[list[np.ndarray]]) -> Iterator[bytes | None]:
    """For each chunk's entries that start in a smaller document too: (position, number of its source, place in it), the
    sources' ids and text hashes; and the positions of its entries that are sources of others."""
    sizes = [len(x[0]) for x in sent]
    order, starts = groups(*alike(plan, sent)[1:])
    pos = np.concatenate([x[0] for x in sent])[order]
    doc = np.concatenate([x[2][x[5]] for x in sent])[order]
    place = pos - np.concatenate([x[3][x[5]] for x in sent])[order]
    tag = np.concatenate([x[4][x[5]] for x in sent])[order]
    block = np.repeat(np.arange(len(sent)), sizes)[order]
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    by = np.lexsort((place, tag, doc, group))
    head = by[starts[:-1]]
    src, src_tag, src_place = doc[head][group], tag[head][group], place[head][group]
    hit = np.flatnonzero(src < doc)
    hit = hit[np.lexsort((pos[hit], block[hit]))]
    cuts = np.searchsorted(block[hit], np.arange(len(sent) + 1))
    told = head[np.unique(group[hit])]
    told = told[np.lexsort((pos[told], block[told]))]
    mine = np.searchsorted(block[told], np.arange(len(sent) + 1))
    for a, b, c, e in zip(cuts[:-1], cuts[1:], mine[:-1], mine[1:]):
        i = hit[a:b]
        # ascending by source, so a source's entries lie together
        own = np.lexsort((src_tag[i], src[i]))
        s, t = src[i][own], src_tag[i][own]
        new = np.ones(len(i), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        which = np.empty(len(i), np.int64)
        which[own] = np.cumsum(new) - 1
        yield pack(pos[i], which, src_place[i] - pos[i], s[new], t[new], pos[told[c:e]]) if len(i) or e > c else None


def _runs(docs: Docs, own: list[np.ndarray], answers: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Joins the edges of a chunk's documents that follow each other to runs: those that have an earlier source, by it, and
    those that are sources; a row for each document with any."""
    n = int(docs.first[-1])
    src, tag, place = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    known, told = np.zeros(n, bool), np.zeros(n, bool)
    for pos, which, off, s, t, sources_at in answers:
        src[pos], tag[pos], place[pos], known[pos] = s[which], t[which], off + pos, True
        told[sources_at] = True
    other, rep = own
    if len(other):  # repeats inside the chunk: their source is the first one's, or the first one itself
        d = docs.of(rep)
        src[other] = np.where(known[rep], src[rep], docs.ids[d])
        tag[other] = np.where(known[rep], tag[rep], docs.text_hash[d])
        place[other] = np.where(known[rep], place[rep], rep - docs.first[d])
        told[rep[~known[rep] & (docs.ids[docs.of(other)] > docs.ids[d])]] = True
        known[other] = True
    at = np.flatnonzero(known)
    doc = docs.of(at)
    fine = src[at] < docs.ids[doc]
    at, doc = at[fine], doc[fine]
    new = np.ones(len(at), bool)
    if len(at) > 1:
        a, b = at[:-1], at[1:]
        new[1:] = ~((b == a + 1) & (doc[1:] == doc[:-1]) & (src[b] == src[a]) & (tag[b] == tag[a]) & (place[b] == place[a] + 1))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    d = doc[head]
    own = np.flatnonzero(told)
    d_own = docs.of(own)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1] + 1) | (d_own[1:] != d_own[:-1])
    h_own = np.flatnonzero(new)
    n_own, d_own = np.diff(np.append(h_own, len(own))), d_own[h_own]
    which = np.unique(np.concatenate([d, d_own]))
    lists = [at[head] - docs.first[d], size, src[at[head]], tag[at[head]], place[at[head]], own[h_own] - docs.first[d_own], n_own]
    offsets = [pa.array(np.searchsorted(x, np.append(which, docs.first.size)).astype(np.int32)) for x in (d, d_own)]
    cols = [pa.ListArray.from_arrays(offsets[i > 4], pa.array(x, t.type.value_type)) for i, (x, t) in enumerate(zip(lists, list(_RUNS)[2:]))]
    yield pa.RecordBatch.from_arrays([pa.array(docs.ids[which]), pa.array(docs.text_hash[which]), *cols], schema=_RUNS)


def repeated_runs(docs: DataFrame, plan: Plan, k: int, attempt: int = 0) -> DataFrame:
    """``doc_id, text_hash, start, n, src, src_tag, src_start`` (arrays: n edges each) of documents that repeat earlier ones, and
    ``own_start, own_n`` (arrays) of those that are repeated."""
    kind = "doc_id long, text_hash long, start array<int>, n array<int>, src array<long>, src_tag array<long>, src_start array<int>, own_start array<int>, own_n array<int>"
    return exchange(docs, plan, _emit(k, attempt), sources, _runs, kind)


_NODES = pa.schema([("node", pa.int64()), ("enters", pa.bool_()), ("leaves", pa.bool_()), ("src", pa.int64()), ("src_tag", pa.int64()), ("at", pa.int32())])


def _nodes(k: int):
    """The nodes of the repeated edges of each source: where they stand, and whether an edge enters and leaves there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                w = Words([col["text"][i].as_buffer().to_pybytes()])
                start, n = (np.array(col[c][i].as_py(), np.int64) for c in ("own_start", "own_n"))
                ends = np.cumsum(n + 1)
                at = np.arange(ends[-1]) - np.repeat(ends - n - 1, n + 1) + np.repeat(start, n + 1)
                enters, leaves = np.ones(len(at), bool), np.ones(len(at), bool)
                enters[ends - n - 1], leaves[ends - 1] = False, False
                node = spans_hash(w.buf, w.start[at], w.end[at + k - 2]).view(np.int64)
                d, t = (np.full(len(at), col[c][i].as_py()) for c in ("_d", "_t"))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((node, enters, leaves, d, t, at), _NODES)], schema=_NODES)

    return run


def branching(nodes: DataFrame) -> DataFrame:
    """``node`` of those that more than one distinct repeated edge enters or leaves."""
    number = lambda c: F.count_if(c).alias(c)
    return nodes.groupBy("node").agg(number("enters"), number("leaves")).filter("enters > 1 OR leaves > 1").select("node")


def walks(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``_d, _t, start, n, src, src_tag, src_start, cuts``: a row for each run of a document, with the places in its source
    where one nonbranching path ends and the next begins."""
    run = ["_d", "_t", "src", "src_tag", "src_start", "n"]
    each = runs.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.explode(F.arrays_zip("start", "n", "src", "src_tag", "src_start")).alias("x")).select("_d", "_t", "x.*")
    cut = nodes.filter("enters AND leaves").join(branching(nodes), "node", "left_semi")
    cuts = cut.groupBy("src", "src_tag", F.shiftright("at", STRETCH).alias("_s")).agg(F.collect_set("at").alias("_c"))
    # nodes within a run: behind its first edge and before its last; a document that goes over one many times asks once
    inner = each.filter("n > 1").select(*run).distinct().withColumn("_s", F.explode(F.sequence(F.shiftright(F.col("src_start") + 1, STRETCH), F.shiftright(F.col("src_start") + F.col("n") - 1, STRETCH))))
    met = inner.join(cuts, ["src", "src_tag", "_s"])
    of = met.select(*run, F.filter("_c", lambda c: (c > F.col("src_start")) & (c < F.col("src_start") + F.col("n"))).alias("_c")).filter(F.size("_c") > 0)
    found = of.groupBy(*run).agg(F.array_sort(F.flatten(F.collect_list("_c"))).alias("cuts"))
    return each.join(found, run, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))


def _pieces(walk: DataFrame) -> DataFrame:
    """``src, src_tag, start, n`` of the paths, or parts of paths, that the walks go over."""
    edges = F.concat(F.array("src_start"), "cuts", F.array(F.col("src_start") + F.col("n")))
    m = F.size(edges) - 1
    parts = F.zip_with(F.slice(edges, 1, m), F.slice(edges, 2, m), lambda a, b: F.struct(a.alias("start"), (b - a).alias("n")))
    return walk.select("src", "src_tag", F.explode(parts).alias("x")).select("src", "src_tag", "x.*")


def graph(rows: DataFrame, keyed: DataFrame, plan: Plan, k: int, attempt: int = 0, size: int = 0) -> DataFrame:
    """The walks of all documents over the nonbranching paths of the graph, as :func:`walks` has them."""
    runs = written(repeated_runs(rows, plan, k, attempt), "runs")
    released(rows.sparkSession, size)
    # the texts of sources, each once whatever rows repeat it
    own = runs.filter(F.size("own_start") > 0).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "own_start", "own_n").dropDuplicates(["_d", "_t"])
    texts = keyed.join(own, ["_d", "_t"]).dropDuplicates(["_d", "_t"]).select("_d", "_t", "text", "own_start", "own_n")
    nodes = written(texts.mapInArrow(_nodes(k), "node long, enters boolean, leaves boolean, src long, src_tag long, at int"), "nodes")
    walk = written(walks(runs.filter(F.size("start") > 0).dropDuplicates(["doc_id", "text_hash"]), nodes), "walks")
    released(rows.sparkSession, size)
    return walk


_OUT = "doc_id long, text_hash long, part int, n_words long, n_removed long, kept_sha256 string, kept string, checks array<struct<src:long,tag:long,start:int,n:int,digest:binary>>, asked array<struct<start:int,n:int,digest:binary>>"
_OUT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("part", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    + [("checks", pa.list_(pa.struct([("src", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))), ("asked", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])))]
)


def _resolve(k: int, texts: bool):
    """Removes the words of the walks, and digests their paths and the spans that others ask for."""

    def digest(w: Words, start: int, n: int) -> bytes:
        last = start + n + k - 2
        return hashlib.blake2b(w.buf[w.start[start] : w.end[last]].tobytes(), digest_size=16).digest() if last < len(w) else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows: list[tuple] = []
            sent: set[tuple] = set()  # many documents of a batch may walk one path
            col = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                text = col["text"][i].as_buffer().to_pybytes()
                w = Words([text])
                gone, checks = np.zeros(len(w) + 1, np.int64), []
                for x in col["own"][i].as_py() or []:
                    a, m, p = x["start"], x["n"], x["src_start"]
                    gone[a] += 1
                    gone[a + m + k - 1] -= 1
                    for b, e in pairwise([p, *x["cuts"], p + m]):
                        one = (x["src"], x["src_tag"], b, e - b, digest(w, a + b - p, e - b))
                        if one not in sent:
                            sent.add(one)
                            checks.append(dict(zip(("src", "tag", "start", "n", "digest"), one)))
                keep = np.cumsum(gone)[:-1] == 0
                if len(w) and not keep.all():
                    marks = np.repeat(keep, w.end - w.start + 1)
                    kept = w.buf[marks].tobytes()[:-1]
                else:
                    kept = w.buf[: int(w.end[-1])].tobytes() if len(w) else b""
                asked = [{"start": x["start"], "n": x["n"], "digest": digest(w, x["start"], x["n"])} for x in col["ask"][i].as_py() or []]
                rows.append((col["doc_id"][i].as_py(), col["text_hash"][i].as_py(), col["part"][i].as_py(), len(w), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None, checks, asked))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 9, _OUT_ARROW)], schema=_OUT_ARROW)

    return run


def substring_dedup(docs: DataFrame, k: int = K, texts: bool = False, attempt: int = 0, asks: int = ASKS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs(doc_id, text)``; with ``texts``, also ``kept``.

    A word goes if a window of k words that covers it also starts in a document of a smaller id.
    """
    if k < 2:
        raise ValueError("a window has two words at least, a node one")
    rows = with_text(docs)
    count = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan.of(count // 5, docs.sparkSession)
    if attempt:
        plan.width, plan.check = 8, True
    keyed = rows.withColumns({"_d": F.coalesce("doc_id", F.lit(NO_ID)), "_t": F.col("text_hash")})
    walk = graph(rows, keyed, plan, k, attempt, count)
    # what each text is asked for: its own walks, and the paths that others walk
    asked = written(_pieces(walk).distinct().select(F.col("src").alias("_d"), F.col("src_tag").alias("_t"), "start", "n"), "asked")
    many = asked.groupBy("_d", "_t").agg(F.count("*").alias("_n")).filter(F.col("_n") > asks).withColumn("_parts", F.ceil(F.col("_n") / asks).cast("int"))
    dealt = asked.join(many, ["_d", "_t"], "left").withColumn("part", F.pmod(F.xxhash64("start", "n"), F.coalesce("_parts", F.lit(1))).cast("int"))
    ask = dealt.groupBy("_d", "_t", "part").agg(F.collect_list(F.struct("start", "n")).alias("ask"))
    own = walk.groupBy("_d", "_t").agg(F.collect_list(F.struct("start", "n", "src", "src_tag", "src_start", "cuts")).alias("own")).select("_d", "_t", F.lit(0).alias("part"), "own")
    request = own.withColumn("ask", F.lit(None).cast(ask.schema["ask"].dataType)).unionByName(ask.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)))
    # a source that is asked in parts has a part 0 for its own row, whatever falls into it
    request = request.unionByName(many.select("_d", "_t", F.lit(0).alias("part"), F.lit(None).cast(own.schema["own"].dataType).alias("own"), F.lit(None).cast(ask.schema["ask"].dataType).alias("ask")))
    request = request.groupBy("_d", "_t", "part").agg(F.first("own", True).alias("own"), F.first("ask", True).alias("ask"))
    joined = keyed.join(request, ["_d", "_t"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    out = written(joined.select("doc_id", "text_hash", "part", "text", "own", "ask").mapInArrow(_resolve(k, texts), _OUT), "resolved")
    checks = out.select(F.explode("checks").alias("c")).select("c.*").distinct()
    found = out.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("src"), F.col("text_hash").alias("tag"), F.explode("asked").alias("a")).select("src", "tag", "a.*").distinct()
    failed = checks.join(found, ["src", "tag", "start", "n", "digest"], "left_anti")
    if not failed.isEmpty():
        if attempt:
            raise RuntimeError("different windows share 96 bits of their digests")
        return substring_dedup(docs, k, texts, attempt + 1, asks)
    return out.filter("part = 0").select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else []))
