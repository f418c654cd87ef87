"""Language ID by hierarchical discrimination.

First a linear model picks the language family, then linear support vector machines, one for each pair of languages of
the family, vote.  Features: hashed runs of one to three bytes of the lower-cased whole text, counted, square-rooted and
scaled to length 1.  Letters of non-Latin scripts need no rules of their own, as their bytes differ.

Training: a bounded sample of the labelled rows, ``PER_LANG`` rows a language and ``MAX_ROWS`` in all (documented bounds),
but ``MIN_ROWS`` of each language, however many languages there are; chosen by a hash of the row; prediction covers every row and reads nothing but the text.

Defined results: null text, or text without a letter, is ``und`` with score 0; if nothing can be learned from, every text
is ``und``; repeated rows each get their result; an empty table gives an empty table; further columns are ignored; all
bytes of a very long text count, a megabyte of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, text_of

DIM = 1 << 11
PER_LANG, MAX_ROWS = 500, 4000
#: Rows of each language that has them; with more than MAX_ROWS / MIN_ROWS languages, the total follows their number.
MIN_ROWS = 8
#: Families of languages by code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
UND = "und"
#: A document of which its language is less sure than not is rejected.
LEAST = 0.5


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), f"lang:{lang}")


def features(text: str, dim: int = DIM) -> np.ndarray:
    """The text's feature vector: all of its bytes count."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    counts = np.zeros(dim)
    for i in range(0, len(b), 1 << 20):  # bounds the memory of very long texts
        c = b[i : i + (1 << 20) + 2].astype(np.uint32)
        one, two, three = c[: 1 << 20], c[:-1] * np.uint32(256) + c[1:], (c[:-2] * np.uint32(65536) + c[1:-1] * np.uint32(256) + c[2:])
        for x, salt in ((one, 2654435761), (two[: 1 << 20], 2246822519), (three, 3266489917)):
            counts += np.bincount(((x + np.uint32(salt & 0xFF)) * np.uint32(salt)) >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
    out = np.sqrt(counts)
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """A linear support vector machine (averaged Pegasos in small batches); y is +1 or -1, classes weigh the same."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, mean, step, n = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
            step += 1
            off = at[y[at] * (x[at] @ w) < 1]
            rate = 1 / (lam * (step + 1 / lam))
            w = (1 - rate * lam) * w + rate * ((y[off] * weight[off]) @ x[off]) / max(len(at), 1)
            if epoch >= epochs // 2:
                mean, n = mean + w, n + 1
    return (mean / max(n, 1)).astype(np.float32)


class Model:
    """Family models and, within each family, a machine for each pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs, object)
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        of = np.array([family(x) for x in langs], object)
        self.members = {f: [g for g in self.langs if family(g) == f] for f in self.families}
        self.top = np.stack([svm(x, np.where(of == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {f: [(a, b, svm(x[m], np.where(names[m] == a, 1.0, -1.0))) for a, b in combinations(g, 2) if len(m := np.flatnonzero((names == a) | (names == b)))] for f, g in self.members.items()}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and the score of each row of features: one product with the family models, one with a family's machines."""
        lang, score = np.empty(len(x), object), np.ones(len(x))
        of = np.zeros(len(x), np.int64)
        if self.top is not None:
            margin = x @ self.top[:, :-1].T + self.top[:, -1]
            of = margin.argmax(axis=1)
            best = np.sort(margin, axis=1)
            score = _sigmoid(best[:, -1] - best[:, -2])
        for i in np.unique(of).tolist():
            names, pairs = self.members[self.families[i]], self.pairs[self.families[i]]
            rows = np.flatnonzero(of == i)
            if not pairs:
                lang[rows] = names[0]
                continue
            w = np.stack([w for _, _, w in pairs])
            m = (x[rows] @ w[:, :-1].T + w[:, -1]).astype(np.float64)
            at = np.array([(names.index(a), names.index(b)) for a, b, _ in pairs])
            first, second = (np.eye(len(names))[at[:, c]] for c in (0, 1))
            votes, sums = (m >= 0) @ first + (m < 0) @ second, m @ (first - second)
            won = np.where(votes == votes.max(axis=1, keepdims=True), sums, -np.inf).argmax(axis=1)
            # the margin by which the winner beats the language that comes closest
            against = np.where(first.T[won] > 0, m, np.where(second.T[won] > 0, -m, np.inf)).min(axis=1)
            lang[rows] = np.array(names, object)[won]
            score[rows] *= _sigmoid(2 * against)
        return lang.tolist(), score


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, dim: int = DIM) -> Model | None:
    """A model from the labelled rows that are not held out; None if there are none."""
    fit = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return None
    each = min(per_lang, max(MIN_ROWS, max_rows // len(counts)))
    # rows whose hash is below a language's share: as many as wanted, give or take chance, without sorting anything
    share = F.element_at(F.create_map(*(F.lit(v) for g, n in counts.items() for v in (g, min(1.0, each / n)))), F.col("lang"))
    u = F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "x": [features(t, dim).astype(np.float16).tobytes() for t in b["text"]]})

    rows = fit.filter(u < share).select("doc_id", "lang", "text").mapInPandas(run, "doc_id long, lang string, x binary").orderBy("lang", "doc_id", "x").collect()
    if not rows:
        return None
    return Model(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["lang"] for r in rows])


def predicted(docs: DataFrame, model: Model | None, columns: list[str], dim: int = DIM) -> DataFrame:
    """``columns`` of ``docs`` and ``lang_pred, score``; only the text is read for these.  The model has a fixed size a language."""
    result = "lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(result)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lean()
        m = shared.value
        for texts in batches:
            lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
            some = np.flatnonzero(texts.notna().to_numpy()) if m is not None else []
            for i in range(0, len(some), 256):
                at = some[i : i + 256]
                lang[at], score[at] = m.predict(np.stack([features(texts.iloc[k], dim) for k in at]))
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    letters = F.when(text_of().rlike(r"\p{L}"), F.col("text"))
    (p,) = fresh(docs, "_p")
    return docs.withColumn(p, predict(letters)).select(*columns, f"{p}.lang_pred", f"{p}.score")


def accepted(docs: DataFrame, model: Model | None, wanted: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language is told, with a score of ``least`` or more, and wanted (None: any that was learned).

    Without a model, nothing can be told of a language: the texts that have a letter stay.
    """
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # columns that might clash are out of the way meanwhile
    away = {c: f"_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    told = predicted(docs.withColumnsRenamed(away), model, ["text", *away.values()])
    fine = (F.col("lang_pred") != UND) & (F.col("score") >= least)
    if wanted is not None:
        fine &= F.col("lang_pred").isin(wanted)
    return told.filter(fine).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in away.items()}).select(*docs.columns)


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row of ``docs(doc_id, text, lang)``."""
    model = train(docs.select("doc_id", "text", "lang"))
    return predicted(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, ["doc_id", "held_out"])
