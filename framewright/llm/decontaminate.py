"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short, a document may be a thousand times longer, so their whole MinHashes say nothing of each other.
Items are partitioned by size (shingles, in powers of two); for the partition of size s a document is seen as blocks of 2s
shingles, one each s, so a passage of s shingles lies within one block and makes up half of it or more.  Of block and item,
the least shingle under each hash function is the same one with a chance p of their overlap by their union: 0.33 for an item
of s shingles, 0.18 for one of s / 2.  A class has ``HASHES`` functions, or as many more as its smallest item needs, 113 at
most, so that a contained passage misses all of them with a chance (1 - p) ** hashes of ``MISS`` at most.  Who shares one is
a candidate; it is verified by exact shingle containment in the whole document, whose words are compared, not their hashes.

The signatures of the items are small only if the items are few: they are broadcast while their bytes are below a checked
bound, and beyond it the items are taken in rounds of that size, each over all documents, so memory never grows with them.

Defined results: null or empty texts on either side match nothing; an item of fewer words than a shingle is one shingle
of all its words; a null item_id is a match as any; repeated rows match each; empty tables give an empty result; further
columns are not looked at; a very long document is searched whole, words may be of any length.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fresh, mixed, shingles
from .exchange import with_text

K = 5
CONTAINED = 0.75
HASHES = 46
#: Chance that a contained item of any size misses all hashes of a block, at most.
MISS = 3e-10
#: Texts of so many bytes are hashed at once.
_PART = 1 << 20
#: Items in a round; an item's signatures and shingles take some kilobytes at most, unless it is itself long.
ROUND = 20_000


def size_class(n: int) -> int:
    """The power of two at or above a number of shingles."""
    return 1 << max(0, int(n) - 1).bit_length()


def _salts(n: int) -> np.ndarray:
    return mixed(np.arange(1, 1 + n, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _needed(size: int, n: int, contained: float) -> int:
    """Hashes by which an item of n shingles in the class of ``size`` is missed with a chance of ``MISS`` at most."""
    overlap = min(n, max(1, math.ceil(contained * n)))
    p = overlap / (2 * size + n - overlap)
    return math.ceil(math.log(MISS) / math.log1p(-p))


def _min_hashes(h: np.ndarray, at: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The least hash of ``h`` under one function in each segment that begins at ``at``."""
    return np.minimum.reduceat((h ^ salt) * np.uint64(0x9FB21C651E98DF25), at)


def _texts(words: Words, doc: int, k: int) -> set[bytes]:
    """The distinct shingles of a text as bytes: k words with blanks between, or all words if they are fewer."""
    a, b = int(words.first[doc]), int(words.first[doc + 1])
    k = min(k, b - a)
    buf, start, end = words.buf.tobytes() if b - a == len(words) else None, words.start, words.end
    if buf is not None:
        return {buf[start[i] : end[i + k - 1]] for i in range(a, b - k + 1)} if k else set()
    return {words.buf[start[i] : end[i + k - 1]].tobytes() for i in range(a, b - k + 1)} if k else set()


class Items:
    """Test items: their exact shingle sets by number, as hashes and as bytes, and their signatures by size class."""

    def __init__(self, ids: list, texts: list[bytes], k: int, hashes: int, contained: float = CONTAINED):
        self.ids, self.k, self.hashes = ids, k, hashes
        words = Words(texts, lower=True)
        doc, h = shingles(words, k)
        n_words = np.diff(words.first)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.sets = {i: np.unique(h[cuts[i] : cuts[i + 1]]) for i in np.flatnonzero(np.diff(cuts)).tolist()}
        self.texts = {i: _texts(words, i, k) for i in self.sets}
        # items shorter than a shingle are looked for as that many words: by their number, the hashes in order and the items
        few = np.flatnonzero((n_words > 0) & (n_words < k))
        self.short = {int(i): int(n_words[i]) for i in few}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(n_words[few]).tolist():
            of = few[n_words[few] == n]
            one = np.array([self.sets[i][0] for i in of.tolist()], np.uint64)
            order = np.argsort(one)
            self.by_length[n] = (one[order], of[order])
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by = defaultdict(list)
        for i, s in self.sets.items():
            if i not in self.short:
                by[size_class(len(s))].append(i)
        for size, members in sorted(by.items()):
            tables = []
            least = min(len(self.sets[i]) for i in members)
            for salt in _salts(max(hashes, _needed(size, least, contained))):
                low = np.array([((self.sets[i] ^ salt) * np.uint64(0x9FB21C651E98DF25)).min() for i in members])
                order = np.argsort(low)
                tables.append((low[order], np.array(members)[order]))
            self.classes[size] = tables


def _candidates(items: Items, first: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int]]:
    """(text, item) that share a least hash in a block; ``h[first[d]:first[d + 1]]`` are text d's shingles in order."""
    n = np.diff(first)
    for size, tables in items.classes.items():
        # half blocks of each text; a block is two neighbours, so its least hash is the less of theirs
        count = -(-n // size)
        d = np.repeat(np.arange(len(n)), count)
        if not len(d):
            continue
        half = np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)
        at = first[d] + half * size
        pair = np.flatnonzero(d[1:] == d[:-1])
        alone = np.flatnonzero(count[d] == 1)
        for salt, (low, member) in zip(_salts(len(tables)), tables):
            halves = _min_hashes(h, at, salt)
            least = np.concatenate([np.minimum(halves[pair], halves[pair + 1]), halves[alone]])
            text = np.concatenate([d[pair], d[alone]])
            a, b = np.searchsorted(low, least, "left"), np.searchsorted(low, least, "right")
            for i in np.flatnonzero(b > a):
                for m in member[a[i] : b[i]]:
                    yield int(text[i]), int(m)


def _find(shared, contained: float):
    """Searches documents for the items that ``shared``, a broadcast, holds."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("shingles", pa.int64())])

    def part(items: Items, ids: list, hashes: list, texts: list[bytes]) -> Iterator[tuple]:
        words = Words(texts, lower=True)
        at, h = words.windows(items.k)
        doc = np.searchsorted(words.first, at, side="right") - 1
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        by: dict[int, set[int]] = defaultdict(set)
        for d, i in _candidates(items, first, h):
            by[d].add(i)
        for d, some in by.items():
            # hashes first; who has enough of them is compared by words
            mine = h[first[d] : first[d + 1]]
            some = [i for i in some if np.isin(items.sets[i], mine).sum() >= contained * len(items.texts[i])]
            have = _texts(Words([texts[d]], lower=True), 0, items.k) if some else set()
            for i in some:
                if (o := len(items.texts[i] & have)) >= contained * len(items.texts[i]):
                    yield ids[d], hashes[d], items.ids[i], o, len(items.texts[i])
        for n, (sought, of) in items.by_length.items():
            w, g = words.windows(n)
            a, b = np.searchsorted(sought, g, "left"), np.searchsorted(sought, g, "right")
            hit = np.flatnonzero(b > a)
            doc = np.searchsorted(words.first, w[hit], side="right") - 1
            pairs = set()
            for p, d in zip(hit.tolist(), doc.tolist()):
                said = words.buf[words.start[w[p]] : words.end[w[p] + n - 1]].tobytes()
                pairs |= {(d, i) for i in of[a[p] : b[p]].tolist() if said in items.texts[i]}
            for d, i in pairs:
                yield ids[d], hashes[d], items.ids[i], 1, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            out: list[tuple] = []
            ids, hashes, texts, held = [], [], [], 0
            for i, x, t in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text")):
                t = t.as_buffer().to_pybytes()
                ids.append(i)
                hashes.append(x)
                texts.append(t)
                held += len(t)
                if held > _PART:
                    out += part(items, ids, hashes, texts)
                    ids, hashes, texts, held = [], [], [], 0
            if ids:
                out += part(items, ids, hashes, texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    return run


def leaks(docs: DataFrame, bench: DataFrame, k: int = K, contained: float = CONTAINED, hashes: int = HASHES, per_round: int = ROUND) -> DataFrame:
    """``doc_id, text_hash, item_id, shared, shingles``: the items of ``bench(item_id, text)`` contained in documents.

    An item is contained if the share of its distinct lower-cased k-word shingles that the document has is ``contained``.
    """
    rows = with_text(docs)
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, text_hash long, item_id long, shared long, shingles long")
    # rounds of items: the size of what is broadcast is checked, not assumed
    tests = bench.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = tests.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    rounds = max(1, -(-n["n"] // per_round), -(-(n["b"] or 0) // (per_round * 512)))
    for r in range(rounds if n["n"] else 0):
        some = tests.filter(F.pmod(F.xxhash64(F.lit(6), "item_id", "text"), F.lit(rounds)) == r).collect()
        if some:
            items = Items([x["item_id"] for x in some], [x["text"].encode() for x in some], k, hashes, contained)
            shared = spark.sparkContext.broadcast(items)
            found = rows.mapInArrow(_find(shared, contained), out.schema)
            out = found if r == 0 else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any leak of ``found``."""
    i, h = fresh(docs, "_id", "_h")
    # a list of whole documents is not bounded: Spark decides how to join by its size
    bad = found.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[i]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad[h]), "left_anti")
