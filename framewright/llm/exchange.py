"""Finding equal items of a whole corpus: a hash exchange in byte blocks.

Billions of small items (word windows, shingles, byte anchors) are too many to be rows.  Each task packs the items of a
bounded *chunk* of documents, sorted documents first, into one block for each *bucket* of hashes; a bucket's blocks meet in
one task, which answers each chunk in one block; the answers of a chunk meet again and become rows of documents.

Within a chunk each distinct item is sent once, for its first occurrence in order of (doc_id, position); the chunk keeps
the others in a block of its own.  So an item that a third of all documents hold arrives as one entry a chunk, and no
bucket holds more of it than that.

Block sizes: a chunk has about ``CHUNK_BYTES`` of text, or one document; a bucket about ``BUCKET`` items, as the number of
buckets follows the corpus.  Both fit workers of 400 MB.  A block has chunk times bucket by corpus items, so from
``GROWS`` items on both grow with the root of the corpus, which keeps the items of a block, up to ``MOST`` times: 64 MB and
32 million items, for workers of 3 GB, at 256 times ``GROWS`` and beyond.  ``spark.framewright.chunkBytes`` and
``spark.framewright.bucketItems`` set them for other workers.  Only counts and sizes reach the driver.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean

#: Bytes of text gathered for a chunk at most, unless one document has more.
CHUNK_BYTES = 4 << 20
BUCKET = 1 << 21
#: Items from which on chunks and buckets grow, and how many times at most.
GROWS, MOST = 1 << 30, 16


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one block.  Ascending integers go as differences; each in the fewest bytes, then deflated if that pays."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = a.dtype.str
        delta = 0
        if a.dtype.kind == "V" or a.dtype == np.uint8:
            raw = a.tobytes()
        else:
            v = a.astype(np.int64)
            if len(v) > 1:
                d = np.diff(v)
                if abs(int(d.min())) + abs(int(d.max())) < abs(int(v.min())) + abs(int(v.max())) and (int(d.min()) >= 0 or len(np.unique(d[:64])) < 24):
                    v, delta = np.concatenate([v[:1], d]), 1
            for small in ("<i1", "<i2", "<i4", "<i8"):
                lim = np.iinfo(small)
                if not len(v) or (lim.min <= int(v[delta:].min(initial=0)) and int(v[delta:].max(initial=0)) <= lim.max):
                    break
            head = int(v[0]) if delta else 0
            raw = struct.pack("<3sq", small.encode(), head) + v[delta:].astype(small).tobytes()
            if (z := zlib.compress(raw, 1)) and len(z) < 0.9 * len(raw):
                raw, delta = z, delta + 2
        k = kind.encode().ljust(5)
        out.append(struct.pack("<5sBqq", k, delta, len(a), len(raw)) + raw)
    return b"".join(out)


def unpack(block: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(block[0]):
        kind, delta, n, size = struct.unpack_from("<5sBqq", block, at)
        at += struct.calcsize("<5sBqq")
        raw, dtype = block[at : at + size], np.dtype(kind.decode().strip())
        at += size
        if dtype.kind == "V" or dtype == np.uint8:
            out.append(np.frombuffer(raw, dtype))
            continue
        if delta >= 2:
            raw, delta = zlib.decompress(raw), delta - 2
        small, head = struct.unpack_from("<3sq", raw)
        v = np.frombuffer(raw, small.decode(), offset=struct.calcsize("<3sq")).astype(np.int64)
        if delta:
            v = np.concatenate([[head], v]).cumsum() if n else v
        out.append(v.astype(dtype))
    return out


@dataclass
class Plan:
    """How hashes are dealt: ``bits`` to buckets, the next ``width`` bytes as what identifies an item in its bucket.

    Where 64 bits are too few for so many items, ``check`` adds 32 of a second hash, between chunks and within one.
    """

    bits: int
    width: int
    chunk_bytes: int = CHUNK_BYTES
    check: bool = False

    @classmethod
    def of(cls, items: int, spark: SparkSession | None = None, spare: int = 7) -> Plan:
        times = min(MOST, max(1.0, (items / GROWS) ** 0.5))
        conf = lambda key, default: int(spark.conf.get(f"spark.framewright.{key}", str(int(default * times)))) if spark else int(default * times)
        bits = max(4, (max(items, 1) // conf("bucketItems", BUCKET)).bit_length())
        # with 7 bits to spare, two different items among so many share all bits with a chance below one in a hundred
        need = 2 * max(items, 2).bit_length() + spare
        return cls(bits, min(8, max(4, -(-(need - bits) // 8))), conf("chunkBytes", CHUNK_BYTES), need > 64)

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, key of ``width`` bytes as uint64)"""
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        if self.width == 8:
            return bucket, h
        rest = h << np.uint64(self.bits)
        return bucket, rest >> np.uint64(64 - 8 * self.width)

    def narrow(self, key: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]).view(f"V{self.width}").ravel()

    def wide(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), 8), np.uint8)
        out[:, : self.width] = np.frombuffer(key.tobytes(), np.uint8).reshape(-1, self.width)
        return out.view("<u8").ravel()


@dataclass
class Docs:
    """The documents of a chunk, by id; ``first`` has each one's first position among the chunk's ``first[-1]``."""

    ids: np.ndarray
    text_hash: np.ndarray
    first: np.ndarray

    def of(self, position: np.ndarray) -> np.ndarray:
        """Number of the document at a position of the chunk."""
        return np.searchsorted(self.first, position, side="right") - 1


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, text hashes, texts) by chunk, sorted by id; a null id counts as the largest, so it is nobody's original."""
    ids, hashes, texts, size = [], [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        i = np.array(ids, np.int64)
        order = np.argsort(i, kind="stable")
        return i[order], np.array(hashes, np.int64)[order], [texts[k] for k in order]

    for batch in batches:
        cols = {n: batch.column(n) for n in ("doc_id", "text_hash", "text")}
        for i, h, t in zip(cols["doc_id"], cols["text_hash"], cols["text"]):
            t = t.as_buffer()
            t = t.to_pybytes() if t is not None else b""
            ids.append(NO_ID if not i.is_valid else i.as_py())
            hashes.append(h.as_py())
            texts.append(t)
            size += len(t) + 64
            if size >= most:
                yield out()
                ids, hashes, texts, size = [], [], [], 0
    if ids:
        yield out()


NO_ID = (1 << 63) - 1


def first_of(h: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first occurrence of each distinct item, and for each position the first one's."""
    order = np.argsort(h, kind="stable") if check is None else np.lexsort((check, h))  # both are stable
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if check is not None:
        new[1:] |= check[order][1:] != check[order][:-1]
    heads = order[new]
    rep = np.empty(len(h), np.int64)
    rep[order] = np.repeat(heads, np.diff(np.append(np.flatnonzero(new), len(s))))
    return heads, rep


def blocks(plan: Plan, chunk: int, docs: Docs, position: np.ndarray, h: np.ndarray, times: np.ndarray | bool = False, places: bool = True, kind: int = 0, check: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, chunk, block) rows of one chunk: the buckets' entries, then the chunk's own block.

    ``position`` (ascending) and ``h`` are the items.  A block has the entries' positions and keys; with ``places`` the
    ids, first positions and text hashes of their documents and each entry's document among these, else four empty arrays; a
    number for each, from ``times`` or, if that is True, how often the chunk has the item; ``kind``, which tells apart
    the items that one chunk sends of two sorts; and the items' second hashes, if ``check`` has them.  The own block has the documents and, for each item that is no first
    occurrence, (position, position of the first).
    """
    check = None if check is None else check.astype(np.uint32)
    heads, rep = first_of(h, check)
    heads.sort()
    bucket, key = plan.keys(h[heads])
    if times is True:
        times = np.bincount(rep, minlength=len(h))
    order = np.argsort(bucket, kind="stable")  # within a bucket by position
    cuts = np.searchsorted(bucket[order], np.arange(plan.buckets + 1))
    none = np.zeros(0, np.int64)
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        i = heads[at]
        p = position[i]
        who = (none,) * 4
        if places:
            used, which = np.unique(docs.of(p), return_inverse=True)
            who = (docs.ids[used], docs.first[used], docs.text_hash[used], which)
        yield int(b), chunk, pack(p, plan.narrow(key[at]), *who, none if times is False else times[i], np.array([kind]), none if check is None else check[i].astype(np.int64))
    other = np.flatnonzero(rep != np.arange(len(h)))
    yield chunk % plan.buckets, chunk, OWN[kind] + pack(docs.ids, docs.text_hash, docs.first, position[other], position[rep[other]])


#: First bytes of a chunk's own blocks, by kind; other blocks begin with a small number.
OWN = (b"S", b"T")


def exchange(docs: DataFrame, plan: Plan, emit: Callable, answer: Callable, gather: Callable, schema: str) -> DataFrame:
    """Runs the exchange over ``docs(doc_id, text_hash, text)``, which should be read from a table.

    A chunk is told by its documents, so should rows come in another order when a lost task is done again, the exchange
    fails and says so; a scan's rows don't.

    ``emit(plan, chunk, ids, hashes, texts)`` yields a chunk's rows by :func:`blocks`; ``answer(plan, bucket, blocks)`` gets the entry
    blocks of a bucket as lists of arrays and yields a block for each, or None; ``gather(docs, own, answers)`` yields
    record batches of ``schema`` for a chunk from its documents, its own pairs (of each kind) and the answers' arrays.
    """
    row = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        task = TaskContext.get()
        for i, (ids, hashes, texts) in enumerate(chunks(batches, plan.chunk_bytes)):
            rows, size = ([], [], []), 0
            # the same in every attempt of the task, as a lost executor's work is done again; of another chunk, another
            who = hashlib.blake2b(ids.tobytes() + hashes.tobytes() + struct.pack("<qq", task.partitionId(), i), digest_size=8)
            for r in emit(plan, int.from_bytes(who.digest(), "little") >> 2, ids, hashes, texts):
                for col, v in zip(rows, r):
                    col.append(v)
                size += len(r[2])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, row)], schema=row)
                    rows, size = ([], [], []), 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, row)], schema=row)

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for bucket, chunk, got in grouped(batches, "bucket"):
            own = [(c, b) for c, b in zip(chunk, got) if b[:1] in OWN]
            sent = [(c, unpack(b)) for c, b in zip(chunk, got) if b[:1] not in OWN]
            out = own + [(c, b) for (c, _), b in zip(sent, answer(plan, bucket, [x for _, x in sent])) if b is not None] if sent else own
            for i in range(0, len(out), 256):
                part = out[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.int64()), pa.array([b for _, b in part], pa.binary())], names=["chunk", "block"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for _, _, got in grouped(batches, "chunk"):
            mine = sorted(b for b in got if b[:1] in OWN)
            if not mine:
                raise RuntimeError("the rows came in another order when they were read again: write the table before the exchange")
            own = unpack(mine[0][1:]) + [x for b in mine[1:] for x in unpack(b[1:])[3:]]
            yield from gather(Docs(*own[:3]), own[3:], [unpack(b) for b in got if b[:1] not in OWN])

    n = dealt_to(docs.sparkSession, plan)
    sent = docs.mapInArrow(send, "bucket int, chunk long, block binary")
    met = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(respond, "chunk long, block binary")
    return met.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(collect, schema)


def dealt_to(spark, plan: Plan) -> int:
    """Partitions of an exchange: each bucket may have its own, a few share one in small corpora."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan.buckets // 2)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(key, chunk, block) of the runs of equal keys in sorted batches; one run is held at a time."""
    now, chunk, got = None, [], []
    for batch in batches:
        keys = batch.column(key).to_pylist()
        cs = batch.column("chunk").to_pylist()
        bs = batch.column("block")
        for k, c, b in zip(keys, cs, bs):
            if k != now and got:
                yield now, chunk, got
                chunk, got = [], []
            now = k
            chunk.append(c)
            got.append(b.as_py())
    if got:
        yield now, chunk, got


def alike(plan: Plan, sent: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, order, new) of all entries of a bucket's blocks: in that order equal items stand together, and ``new`` marks
    the first of each."""
    key, check = np.concatenate([plan.wide(x[1]) for x in sent]), np.concatenate([x[8] for x in sent])
    order = np.lexsort((check, key)) if len(check) else np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    s = key[order]
    new[1:] = s[1:] != s[:-1]
    if len(check):
        new[1:] |= check[order][1:] != check[order][:-1]
    return key, order, new


def groups(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) of the groups of two or more: ``order[starts[g]:starts[g + 1]]`` are group g's indices."""
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    many = size > 1
    return order[np.repeat(many, size)], np.concatenate([[0], np.cumsum(size[many])])


def with_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``; null text is empty, rows that are equal in both come once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
