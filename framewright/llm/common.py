"""Shared pieces of the training-data operators.

Word rules, shared tables and the array kernels that several operators use.  Everything that leaves a
partition is either a DataFrame row or a byte block of bounded size; see ``exchange.py`` for the blocks.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import random
import re
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; where it is unset, an own one if there is one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="framewright-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, outlives lost executors, is computed once.

    After a large exchange, call :func:`released` once nothing refers to it.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if not _made:
        atexit.register(clean_up, spark)
    _made.append(at)
    return spark.read.schema(df.schema).parquet(at)


def released(spark: SparkSession, size: int) -> None:
    """Lets Spark delete the shuffle files of what is no longer used, which it does once the driver collects its garbage.

    Twice, as the first collection frees what Python held, the second what that had held.  Not after exchanges of less than
    ``WORTH`` bytes of text, whose files may stay until the driver collects anyway.
    """
    if size < WORTH:
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


WORTH = 1 << 26


def lean() -> None:
    """Makes this worker return large arrays to the system when they are freed, so that one task's don't add to the next's.

    The C library otherwise keeps what is freed for later, in pieces that later arrays don't fit.
    """
    import pyarrow as pa

    global _lean
    if not _lean:
        _lean = True
        with contextlib.suppress(OSError, AttributeError):  # another C library
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 1 << 20)  # arrays of 1 MB and more have pages of their own
            libc.mallopt(-1, 1 << 20)
    pa.default_memory_pool().release_unused()


_lean = False


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables that :func:`written` made; for the end of a session."""
    while _made:
        at = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, whatever it has."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def text_of(col: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, without building them."""
    # a word begins at a non-space that follows a space: squeeze words to one mark each, drop the spaces
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), SPACE, "")).cast("long")


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a column, summed by Spark."""
    return df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


# ---------------------------------------------------------------- kernels over the UTF-8 bytes of many texts

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Primes below 2**31: a product of a residue and a byte's number is below 2**40, so 2**24 of them add up exactly in 64 bits.
PRIMES = (2147483647, 2147483629)
#: Bases of the polynomials modulo each prime, by seed; drawn at random, once.
SEEDS = 8
_rng = random.Random("bases of polynomials modulo two primes")
_BASES = [tuple(_rng.randrange(1 << 20, p - 1) for p in PRIMES) for _ in range(SEEDS)]
#: Base of the rolling hash that only chooses places and tells nothing equal: odd, so it has an inverse modulo 2**64.
_ROLL = 0x9E3779B97F4A7C15
_powers: dict[tuple[int, int], np.ndarray] = {}
_powers_of_none = np.zeros(0, np.uint64)


def _modulo(x: np.ndarray, p: int) -> np.ndarray:
    """``x % p``; numpy divides by a number faster than it takes remainders."""
    return x - x // np.uint64(p) * np.uint64(p)


def _power(base: int, n: int, prime: int = 0) -> np.ndarray:
    """The powers 0 to n - 1 of a base, modulo a prime or else modulo 2**64; they are kept for the next time."""
    have = _powers.get((base, prime), _powers_of_none)
    if len(have) < n:
        have = np.ones(max(n, 1 << 16), np.uint64)
        done = 1
        while done < len(have):
            step = pow(base, done, prime or 1 << 64)
            new = have[: len(have) - done][:done] * np.uint64(step)
            have[done : done + len(new)] = _modulo(new, prime) if prime else new
            done *= 2
        if n <= _KEPT:
            _powers[base, prime] = have
    return have[:n]


#: Longer tables of powers are made anew each time: only a word of so many bytes needs them.
_KEPT = 1 << 23


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed as a row of 64-bit sums at once; bounds the memory of the sums.
BLOCK = 1 << 20


class Words:
    """The words of some texts: ``buf`` holds them all, one blank after each; word i is ``buf[start[i]:end[i]]``.

    ``first`` has, for each text and one more, the number of its first word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _IS_SPACE[joined]
        if lower:
            up = (joined >= 65) & (joined <= 90)
            joined = np.where(up, joined + 32, joined).astype(np.uint8)
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        keep = ~(space & before)
        at = np.cumsum(keep, dtype=np.int64 if len(keep) > 1 << 31 else np.int32)  # kept bytes up to and with this one
        buf = np.where(space, np.uint8(32), joined)[keep]
        self.end = np.flatnonzero(buf == 32)
        self.start = np.empty_like(self.end)
        if len(self.end):
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        self.buf = buf
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        # words that end up to the end of each text
        self.first = np.zeros(len(texts) + 1, np.int64)
        if len(texts):
            self.first[1:] = np.searchsorted(self.end, at[ends - 1] - 1, side="right")

    def __len__(self) -> int:
        return len(self.end)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return spans_hash(self.buf, self.start, self.end)

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of k words within one text, and the windows' hashes."""
        n = np.diff(self.first) - (k - 1)
        at = np.flatnonzero(np.repeat(n > 0, np.diff(self.first))) if len(n) else np.zeros(0, np.int64)
        if len(at):
            last = np.repeat(self.first[1:], np.diff(self.first))[at]
            at = at[at + k <= last]
        return at, spans_hash(self.buf, self.start[at], self.end[at + k - 1], seed)


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` for many ascending, possibly overlapping spans.

    Polynomials modulo two primes at random bases, scrambled with the length.  Two different spans of n bytes share one
    with a chance of (n / 2**31)**2 at most over the choice of the bases, whatever the bytes are; polynomials modulo 2**64
    would give texts of a certain build one hash at every base.  Another ``seed`` (0 to 7) has other bases, independent of these.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, lo + BLOCK)))
        hi = int(end[j - 1]) if j - i == 1 else int(end[i:j].max())
        x = buf[lo:hi].astype(np.uint64) + np.uint64(1)
        a, b = start[i:j] - lo, end[i:j] - lo
        both = np.zeros(j - i, np.uint64)
        for prime, base in zip(PRIMES, _BASES[seed]):
            sums = _sums(x * _power(base, hi - lo, prime), prime)
            # the span's own powers begin at 0: by the inverse of the power at its start
            part = _modulo(_modulo(sums[b] - sums[a], prime) * _power(pow(base, -1, prime), hi - lo + 1, prime)[a], prime)
            both = (both << np.uint64(31)) | part
        out[i:j] = both
        i = j
    # the length goes in too: texts of one repeated byte differ in it alone
    return mixed(out + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _sums(x: np.ndarray, prime: int) -> np.ndarray:
    """Running sums from 0 on; a difference of two is right modulo the prime."""
    sums = np.zeros(len(x) + 1, np.uint64)
    if len(x) <= 1 << 24:
        np.cumsum(x, out=sums[1:])
        return sums
    for lo in range(0, len(x), 1 << 24):  # one very long span: exact in pieces; later sums stay the larger ones
        hi = min(len(x), lo + (1 << 24))
        sums[lo + 1 : hi + 1] = _modulo(np.cumsum(x[lo:hi]) + sums[lo], prime)
    return np.where(np.arange(len(sums)) > 0, sums + np.uint64(prime) * np.arange(len(sums), dtype=np.uint64), sums)


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of ``buf[start:end]`` as two arrays of 64 bits: for what counts as equal with no look at its bytes."""
    data = memoryview(np.ascontiguousarray(buf))
    got = b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    both = np.frombuffer(got, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each shingle of k words; a text with fewer words has the whole as its one shingle."""
    at, h = words.windows(k)
    doc = np.searchsorted(words.first, at, side="right") - 1
    n = np.diff(words.first)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        doc = np.concatenate([doc, few])
        h = np.concatenate([h, spans_hash(words.buf, words.start[words.first[few]], words.end[words.first[few + 1] - 1])])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Scrambled hashes of the k bytes from each place on that has so many; to choose places by, not to tell bytes equal."""
    n = max(0, len(buf) - k + 1)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):
        m = min(BLOCK, n - lo)
        sums = np.zeros(m + k, np.uint64)
        np.cumsum((buf[lo : lo + m + k - 1].astype(np.uint64) + np.uint64(1)) * _power(_ROLL, m + k - 1), out=sums[1:])
        out[lo : lo + m] = mixed((sums[k:] - sums[:-k]) * _power(pow(_ROLL, -1, 1 << 64), m))
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x)
    if n < w:
        return x[:0]
    m = -(-n // w) * w
    p = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    p[:n] = x
    p = p.reshape(-1, w)
    front = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], front[w - 1 : n])
