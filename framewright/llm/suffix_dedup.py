"""Suffix-array dedup of bytes by a distributed merge sort that is aware of common prefixes.

A byte goes if a string of ``size`` bytes that covers it also starts elsewhere.  Sorting every suffix would move the corpus
hundreds of times, so suffixes are sampled where their content says so, and only those that may repeat are sorted:

1. Anchors.  In each string of ``size`` bytes the place whose ``GRAM`` bytes hash lowest is an anchor.  Equal strings have
   their anchor at the same place, so every repeat of that length shows at an anchor; about one place in 170 is one.
2. Distinguishing prefixes.  Anchors meet by the hashes of their gram and of their whole context, all strings of that
   length around it (:mod:`exchange`).  One whose gram is nowhere else has no repeat.  One whose context is elsewhere too is
   repeated throughout.  Only the others, and one witness of each repeated context among them, have suffixes to be sorted.
3. Each task sorts its suffixes to runs and front-codes them: each sends its length shared with the one before and the
   rest.  The runs of a range of grams meet in one task, and a loser tree that keeps each head's common prefix with the
   last winner merges them: heads with different common prefixes are decided without a look at a byte, heads with equal
   ones are compared from there on.  The merge gives the common prefixes of neighbours, and with those of the reversed
   contexts to the left, how far each suffix's repeats reach on either side.
4. The reaches become spans of documents, and a join with the texts removes them.

The bytes themselves are compared in step 3; in step 2 a context counts as repeated if 96 bits of its cryptographic digest
are, which any two different ones among 10**12 share with a chance below one in 100,000, however they are built.

Defined results: null text is empty; repeated rows are repeats of each other; a null doc_id is kept as null; overlapping
repeats in one document count; an empty table gives an empty table; further columns are not looked at.  A very long text is a
chunk of its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digests, grams, lean, released, sliding_min, spans_hash, written
from .exchange import NO_ID, Docs, Plan, alike, blocks, dealt_to, exchange, first_of, pack, unpack, with_text

SIZE = 400
GRAM = 64
SINGLE, FULL, WITNESS = 1, 2, 3
#: Added to the status of anchors whose gram has too many suffixes for one task.
HOT = 8
#: Suffixes of one gram that meet in one task, at most.
MOST = 50_000
#: Texts of which anchors are computed at once.
_PART = 1 << 20
#: Bytes of contexts in one sorted run.
_RUN = 32 << 20


def anchors(buf: np.ndarray, first: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of texts that lie one after another, text d at ``first[d]:first[d + 1]``."""
    places, hashes = [], []
    d = 0
    while d < len(first) - 1:
        e = max(d + 1, int(np.searchsorted(first, first[d] + _PART, side="right")) - 1)
        lo, hi = int(first[d]), int(first[e])
        if hi - lo >= size:
            h = grams(buf[lo:hi], k)
            bits = np.uint64(max(1, int(hi - lo).bit_length()))
            low = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), size - k + 1)
            # only strings within one text
            end = np.repeat(first[d + 1 : e + 1], np.diff(first[d : e + 1]))[: len(low)] - lo
            low = low[np.arange(len(low)) + size <= end]
            at = np.unique((low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
            places.append(at + lo)
            hashes.append(h[at])
        d = e
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _emit(size: int, k: int):
    def emit(plan: Plan, chunk: int, ids: np.ndarray, hashes: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        at, gram = anchors(buf, first, size, k)
        docs = Docs(ids, hashes, first)
        if not len(at):
            yield from blocks(plan, chunk, docs, at, gram, places=False)
            yield from blocks(plan, chunk, docs, at, gram, places=False, kind=1)
            return
        d = docs.of(at)
        lo, hi = np.maximum(at - (size - k), first[d]), np.minimum(at + size, first[d + 1])
        context, second = digests(buf, lo, hi)
        context ^= (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # of each gram, how many contexts the chunk has
        kinds = np.bincount(first_of(gram)[1][first_of(context, second.astype(np.uint32))[0]], minlength=len(at))
        yield from blocks(plan, chunk, docs, at, context, times=True, places=False, check=second)
        yield from blocks(plan, chunk, docs, at, gram, times=kinds, places=False, kind=1)

    return emit


def _answers(plan: Plan, bucket: int, sent: list[list[np.ndarray]]) -> Iterator[bytes | None]:
    """For a chunk's contexts that are repeated: (0, place, whether it is the first, chunks that have it).  For its grams
    with more than one entry: (1, place, entries), an entry being a context in a chunk.

    Either costs an entry a chunk at most, however many documents hold it.
    """
    out: list[bytes | None] = [None] * len(sent)
    for kind in (0, 1):
        mine = [i for i, x in enumerate(sent) if x[7][0] == kind]
        if not mine:
            continue
        times = np.concatenate([sent[i][6] for i in mine])
        _, by, new = alike(plan, [sent[i] for i in mine])
        edge = np.flatnonzero(new)
        sizes = np.diff(np.append(edge, len(by)))
        total, chunks, first = np.empty(len(by), np.int64), np.empty(len(by), np.int64), np.empty(len(by), bool)
        total[by], chunks[by], first[by] = np.repeat(np.add.reduceat(times[by], edge), sizes), np.repeat(sizes, sizes), new
        at = 0
        for i in mine:
            p = sent[i][0]
            j = np.flatnonzero(total[at : at + len(p)] > 1)
            if len(j):
                out[i] = pack(np.array([kind]), p[j], *((first[at + j].astype(np.int64), chunks[at + j]) if kind == 0 else (total[at + j],)))
            at += len(p)
    yield from out


_MARKED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("marks", pa.binary()), ("hot", pa.bool_())])


def _marked(most: int):
    def gather(docs: Docs, own: list[np.ndarray], answers: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """For each document with anchors that may repeat: (place, status)."""
        context, context_rep, gram, gram_rep = own
        at = np.unique(np.concatenate([context, gram, *(a[1] for a in answers)]))
        if not len(at):
            return
        where = lambda p: np.searchsorted(at, p)
        repeated, first, chunks, entries = np.zeros(len(at), bool), np.zeros(len(at), bool), np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
        for a in answers:
            i = where(a[1])
            if a[0][0] == 0:
                repeated[i], first[i], chunks[i] = True, a[2] > 0, a[3]
            else:
                entries[i] = a[2]
        told = np.isin(gram_rep, at)
        entries[where(gram[told])] = entries[where(gram_rep[told])]
        status = np.where(repeated, np.where(first & (entries > chunks), WITNESS, FULL), np.where(entries > 1, SINGLE, 0))
        status[where(context)] = FULL
        # too many suffixes of one gram to meet in one task
        status = np.where((entries > most) & (status != FULL) & (status != 0), status + HOT, status)
        i = np.flatnonzero(status)
        pos, status = at[i].astype(np.int64), status[i].astype(np.uint8)
        d = docs.of(pos)
        which, cut = np.unique(d, return_index=True)
        cut = np.append(cut, len(d))
        spans = list(zip(which, cut[:-1], cut[1:]))
        marks = [pack(pos[a:b] - docs.first[w], status[a:b]) for w, a, b in spans]
        hot = [bool((status[a:b] > HOT).any()) for _, a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array(docs.ids[which]), pa.array(docs.text_hash[which]), pa.array(marks, pa.binary()), pa.array(hot, pa.bool_())], schema=_MARKED)

    return gather


# ---------------------------------------------------------------- grams that very many suffixes share


def _emit_strings(size: int, k: int):
    """The strings of ``size`` bytes around hot anchors; a row's bytes are the length of its marks, the marks, the text."""

    def emit(plan: Plan, chunk: int, ids: np.ndarray, hashes: np.ndarray, rows: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        parts = [(r[8 : 8 + int.from_bytes(r[:8], "little")], r[8 + int.from_bytes(r[:8], "little") :]) for r in rows]
        first = np.concatenate([[0], np.cumsum([len(t) for _, t in parts])]).astype(np.int64)
        starts = [np.zeros(0, np.int64)]
        for (marks, text), base in zip(parts, first):
            at, status = unpack(marks)
            for p in at[status > HOT].tolist():
                starts.append(np.arange(max(0, p - (size - k)), min(p, len(text) - size) + 1) + base)
        at = np.unique(np.concatenate(starts))
        buf = np.frombuffer(b"".join(t for _, t in parts), np.uint8)
        return blocks(plan, chunk, Docs(ids, hashes, first), at, spans_hash(buf, at, at + size), times=True, places=False, check=spans_hash(buf, at, at + size, 1))

    return emit


def _repeated(plan: Plan, bucket: int, sent: list[list[np.ndarray]]) -> Iterator[bytes | None]:
    """For a chunk's strings that are elsewhere too: their places."""
    for b in _answers(plan, bucket, sent):
        yield None if b is None else pack(unpack(b)[1])


def _string_spans(size: int):
    def gather(docs: Docs, own: list[np.ndarray], answers: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.concatenate([*(a[0] for a in answers), own[0]])).astype(np.int64)
        d = docs.of(at)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(at)) - 1
        w = d[head]
        cols = [docs.ids[w], docs.text_hash[w], at[head] - docs.first[w], at[last] - docs.first[w] + size] if len(at) else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _REACH)], schema=_REACH)

    return gather


# ---------------------------------------------------------------- sorted runs


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (diff.bit_length() + 7) // 8


def front_coded(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared with the one before, length of the rest, rests) of a sorted run."""
    shared = [0] + [common(a, b) for a, b in zip(run, run[1:])]
    rests = [s[n:] for s, n in zip(run, shared)]
    return np.array(shared, np.int64), np.array([len(r) for r in rests], np.int64), b"".join(rests)


def decoded(shared: list[int], lengths: list[int], rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared with the one before, string)"""
    last, at = b"", 0
    for n, m in zip(shared, lengths):
        last = last[:n] + rests[at : at + m]
        at += m
        yield n, last


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the one before, string) of sorted runs in order: a loser tree on common prefixes.

    Each head is held with its common prefix with the last winner.  Of two heads the one with the longer prefix is the
    smaller; only for equal prefixes are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    prefix = [0] * k

    def pull(r: int) -> None:
        got = next(runs[r], None) if r < len(runs) else None
        heads[r], prefix[r] = (None, 0) if got is None else (got[1], got[0])

    def beats(a: int, b: int) -> bool:
        """Whether a's head comes first; the other's prefix becomes that with it."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if prefix[a] != prefix[b]:
            return prefix[a] > prefix[b]
        n = common(x, y, prefix[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            prefix[b] = n
            return True
        prefix[a] = n
        return False

    for r in range(k):
        pull(r)
    for r in range(len(runs)):
        prefix[r] = 0
    loser = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if not beats(a, b):
                a, b = b, a
            loser[node + i // 2] = b
            up.append(a)
        level = up
    win = level[0]
    while heads[win] is not None:
        yield win, prefix[win], heads[win]
        pull(win)
        n = (win + k) // 2
        while n:
            if not beats(win, loser[n]):
                win, loser[n] = loser[n], win
            n //= 2


def reaches(right: np.ndarray, lefts: list[bytes], ask: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(member, left, right): how far the repeats of members of one group reach, for those that have any.

    ``right[i]`` is the common prefix of the sorted members i - 1 and i; ``lefts`` are their reversed left contexts.  A
    partner counts if both sides together reach ``size``; all counting ones hold the anchor, so their union is one span.
    Time is about linear in the members, so a passage that very many share is no worse than as many that few share.
    """
    m = len(lefts)
    if m == 2:
        left = common(lefts[0], lefts[1])
        if left + right[1] >= size:
            for i in np.flatnonzero(ask):
                yield int(i), left, int(right[1])
        return
    order = sorted(range(m), key=lefts.__getitem__)
    rank = [0] * m
    for r, i in enumerate(order):
        rank[i] = r
    near = [0] + [common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])]
    span = _range_min(near)
    far_left, far_right = [0] * m, [0] * m

    def meet(a: int, b: int, r: int) -> None:
        """Two neighbours by left context among suffixes that share r bytes to the right."""
        left = span(rank[a], rank[b])
        if left + r >= size:
            for i in (a, b):
                far_left[i], far_right[i] = max(far_left[i], left), max(far_right[i], r)

    # Suffixes are united from the longest common prefix down.  When two sets unite, the smaller one's members find their
    # neighbours by left context in the larger one: no other new pair can reach further on the left at this prefix.
    sets: list[list[int]] = [[rank[i]] for i in range(m)]
    home = list(range(m))

    def find(i: int) -> int:
        while home[i] != i:
            home[i] = i = home[home[i]]
        return i

    for j in sorted(range(1, m), key=lambda j: -right[j]):
        r = int(right[j])
        a, b = find(j - 1), find(j)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for x in sets[b]:
            at = bisect_left(large, x)
            if at:
                meet(order[x], order[large[at - 1]], r)
            if at < len(large):
                meet(order[x], order[large[at]], r)
        large += sets[b]
        large.sort()  # two sorted runs: linear
        sets[b] = []
        home[b] = a
    for i in np.flatnonzero(ask):
        if far_right[i]:
            yield int(i), far_left[i], far_right[i]


def _range_min(near: list[int]) -> Callable[[int, int], int]:
    """The least of ``near`` between two ranks, the lower one's own not included, by a sparse table."""
    table = [np.array(near)]
    while len(table[-1]) > 1 << (len(table) - 1):
        t, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(t[:-half], t[half:]))

    def least(a: int, b: int) -> int:
        lo, hi = (a, b) if a < b else (b, a)
        k = (hi - lo).bit_length() - 1
        t = table[k]
        return min(int(t[lo + 1]), int(t[hi + 1 - (1 << k)]))

    return least


def _runs(size: int, k: int, buckets: int):
    """Sorted, front-coded runs of the suffixes to be sorted, cut by the range of their first bytes' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for i, h, text, marks in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text", "marks"))):
                at, status = unpack(marks.as_buffer().to_pybytes())
                cold = (status == SINGLE) | (status == WITNESS)
                at, status = at[cold], status[cold]
                if not len(at):
                    continue
                t = text.as_buffer().to_pybytes()
                g = grams_at(t, at, k)
                doc, h = (NO_ID if not i.is_valid else i.as_py()), h.as_py()
                for p, s, b in zip(at.tolist(), status.tolist(), g.tolist()):
                    rows.append((b % buckets, t[p : p + size], t[max(0, p - (size - k)) : p][::-1], doc, h, p, s))
                held += len(at) * 2 * size
            if held > _RUN:
                yield from out(rows)
                rows, held = [], 0
        if rows:
            yield from out(rows)

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[:3])
        cuts = np.searchsorted(np.array([r[0] for r in rows]), np.arange(buckets + 1))
        got: tuple[list, list] = ([], [])
        for b in np.flatnonzero(np.diff(cuts)):
            part = rows[cuts[b] : cuts[b + 1]]
            shared, rest, data = front_coded([r[1] for r in part])
            lefts = [r[2] for r in part]
            cols = [np.array([r[c] for r in part], np.int64) for c in range(3, 7)]
            got[0].append(int(b))
            got[1].append(pack(shared, rest, np.frombuffer(_deflated(data), np.uint8), np.array([len(x) for x in lefts]), np.frombuffer(_deflated(b"".join(lefts)), np.uint8), *cols))
        yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int32()), pa.array(got[1], pa.binary())], names=["bucket", "block"])

    return run


def _deflated(data: bytes) -> bytes:
    import zlib

    return zlib.compress(data, 1)


def _inflated(data: np.ndarray) -> bytes:
    import zlib

    return zlib.decompress(data.tobytes())


def grams_at(text: bytes, at: np.ndarray, k: int) -> np.ndarray:
    """Scrambled hashes of k bytes at some places."""
    return spans_hash(np.frombuffer(text, np.uint8), at, at + k) >> np.uint64(1)


_REACH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _merge(size: int, k: int):
    """Merges the runs of a bucket and tells the reaches."""

    def bucket(got: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        parts = [unpack(b) for b in got]
        runs = [decoded(p[0].tolist(), p[1].tolist(), _inflated(p[2])) for p in parts]
        ends = [np.concatenate([[0], np.cumsum(p[3])]).tolist() for p in parts]
        left = [_inflated(p[4]) for p in parts]
        tags = [[c.tolist() for c in p[5:]] for p in parts]
        nth = [0] * len(parts)
        members: list[tuple] = []
        prefixes: list[int] = []

        def close() -> Iterator[tuple[int, int, int, int]]:
            if len(members) > 1:
                ask = np.array([m[4] == SINGLE for m in members])
                if ask.any():
                    for i, a, b in reaches(np.array(prefixes), [m[0] for m in members], ask, size):
                        doc, h, p = members[i][1:4]
                        yield doc, h, p - a, p + b

        for r, n, _ in merged(runs):
            if n < k:
                yield from close()
                members, prefixes = [], []
            i = nth[r]
            nth[r] += 1
            members.append((left[r][ends[r][i] : ends[r][i + 1]], *(c[i] for c in tags[r])))
            prefixes.append(n)
        yield from close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, got, rows = None, [], []
        for batch in batches:
            for b, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
                if b != now and got:
                    rows += bucket(got)
                    got = []
                now = b
                got.append(block.as_py())
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _REACH)], schema=_REACH)
                rows = []
        if got:
            rows += bucket(got)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _REACH)], schema=_REACH)

    return run


def _removed(size: int, k: int, texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows = []
            for i, text, marks, start, end in zip(*(batch.column(c) for c in ("doc_id", "text", "marks", "start", "end"))):
                t = text.as_buffer().to_pybytes()
                spans = list(zip(start.as_py() or [], end.as_py() or []))
                if marks.is_valid:
                    at, status = unpack(marks.as_py())
                    spans += [(max(0, p - (size - k)), min(len(t), p + size)) for p in at[(status & (HOT - 1)) != SINGLE].tolist()]
                runs: list[list[int]] = []
                for a, b in sorted(spans):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept, last = [], 0
                for a, b in runs:
                    kept.append(t[last:a])
                    last = b
                kept.append(t[last:])
                rest = b"".join(kept)
                rows.append((i.as_py(), len(t), len(t) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in runs] if texts else None, rest if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    return run


def suffix_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, texts: bool = False, most: int = MOST) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs(doc_id, text)``.

    With ``texts`` also ``spans``, the removed runs in bytes, and ``kept``, the bytes that remain.  Suffixes of a gram that
    may have more than ``most`` of them are not sorted in one task: their strings meet by hash, one entry a chunk.
    """
    if not 8 <= gram < size:
        raise ValueError("the gram must be shorter than the string")
    spark = docs.sparkSession
    rows = with_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan.of(4 * total // (size - gram + 2), spark)
    plan.width = 8
    marked = written(exchange(rows, plan, _emit(size, gram), _answers, _marked(most), "doc_id long, text_hash long, marks binary, hot boolean"), "marks")
    released(spark, total)
    mine = marked.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "marks", "hot")
    keyed = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_h"), "doc_id", "text")
    suffixes = keyed.join(mine, ["_id", "_h"]).select(F.col("_id").alias("doc_id"), F.col("_h").alias("text_hash"), "text", "marks")
    buckets = 2 * dealt_to(spark, plan)
    runs = suffixes.mapInArrow(_runs(size, gram, buckets), "bucket int, block binary")
    kind = "doc_id long, text_hash long, start int, end int"
    reach = runs.repartition(buckets // 2, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(size, gram), kind)
    hot = mine.filter("hot")
    if not hot.isEmpty():
        around = F.concat(F.unhex(F.rpad(F.hex(_little(F.length("marks"))), 16, "0")), "marks", F.encode("text", "utf-8"))
        # written first: the exchange wants rows that come in the same order again
        some = written(keyed.join(hot, ["_id", "_h"]).select(F.col("_id").alias("doc_id"), F.col("_h").alias("text_hash"), around.alias("text")), "hot")
        by_hash = Plan.of(some.agg(F.sum(F.octet_length("text"))).first()[0] or 0, spark)
        by_hash.chunk_bytes //= 4
        by_hash.width = 8
        reach = reach.unionByName(exchange(some, by_hash, _emit_strings(size, gram), _repeated, _string_spans(size), kind))
    spans = reach.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))
    # rows that are equal in id and text have equal marks, but for who is whose witness: either way all is repeated
    once = mine.groupBy("_id", "_h").agg(F.min("marks").alias("marks"))
    joined = keyed.join(once.join(spans, ["_id", "_h"], "left"), ["_id", "_h"], "left").select("doc_id", "text", "marks", "start", "end")
    out = joined.mapInArrow(_removed(size, gram, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
    return out if texts else out.drop("spans", "kept")


def _little(n: Column) -> Column:
    """The bytes of a number below 2 ** 32, the lowest first."""
    byte = lambda i: F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0"))
    return F.concat(*map(byte, range(4)))
