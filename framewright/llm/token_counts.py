"""Token counts by the whole-token shortcut.

A text is cut into pre-tokens where no merge can reach: before a blank that follows a non-blank, and around line feeds.
That is safe only if no vocabulary string holds such a place, which :class:`Counter` proves from the vocabulary before
anything is counted (it refuses a model for which the proof fails).  The vocabulary strings that encode alone as one
token are proved offline too, by encoding each of them once; a pre-token that is one of them counts 1 without any
merging.  Only the rest goes through the merges, each distinct pre-token once as long as it stays in a bounded memo.

Defined results: null text counts as empty, empty text has 0 tokens; strings of control tokens inside a text are ordinary
text, which is the library's default; repeated rows each get their count; an empty table gives an empty table; further
columns are not looked at; a very long text is counted whole, pre-token by pre-token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Distinct pre-tokens that one worker remembers besides the vocabulary; bounds its memory, not the result.
MEMO = 400_000
#: A pre-token of more characters is merged but not remembered, so the memo's bytes are bounded as well.
MEMO_CHARS = 64
_BLANK = "▁"
_CUT = re.compile(rf"\n|[ {_BLANK}]*[^ {_BLANK}\n]+|[ {_BLANK}]+")


class Counter:
    """Counts the tokens of texts for a sentencepiece BPE model with dummy prefix, byte fallback and no normalizing."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = spm.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        pieces = [p.piece for p in model.pieces if p.type in (1, 4, 5)]
        norm = model.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if not plain or any("\n" in p or re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces) or any(p.type == 4 for p in model.pieces):
            raise ValueError("pre-tokens of this model may merge with each other: no shortcut is proved for it")
        self.feed = len(self.sp.encode("\n"))
        blank = [p for p in pieces if p[0] == _BLANK]
        inner = [p for p in pieces if p[0] != _BLANK]
        # proved by encoding: with the blank that the library puts in front, or after a line feed, which nothing merges with
        self.whole = {" " + p[1:].replace(_BLANK, " "): 1 for p, n in zip(blank, self.sp.encode([p[1:] for p in blank], num_threads=1)) if len(n) == 1}
        self.whole |= {p: 1 for p, n in zip(inner, self.sp.encode(["\n" + p for p in inner], num_threads=1)) if len(n) == self.feed + 1}
        self.whole["\n"] = len(self.sp.encode("\n\n")) - self.feed
        # a single blank alone is what stands before a first line feed: the library makes nothing of an empty text
        self.whole[" "] = self.whole[_BLANK] = self.feed - self.whole["\n"]
        self.memo = dict(self.whole)

    def merged(self, new: list[str]) -> list[int]:
        """Tokens of pre-tokens that are no whole token."""
        plain = [x[1:] if x[0] in f" {_BLANK}" else "\n" + x for x in new]
        return [len(n) - (0 if x[0] in f" {_BLANK}" else self.feed) for x, n in zip(new, self.sp.encode(plain, num_threads=1))]

    def count(self, text: str) -> int:
        if not text:
            return 0
        cut = _CUT.findall(" " + text)  # the library's dummy prefix
        new = [x for x in set(cut) if x not in self.memo]
        if len(self.memo) + len(new) > MEMO + len(self.whole):
            self.memo = dict(self.whole)
            new = [x for x in set(cut) if x not in self.memo]
        if new:
            got = dict(zip(new, self.merged(new)))
            fit = {x: n for x, n in got.items() if len(x) <= MEMO_CHARS} if len(got) <= MEMO else {}
            self.memo |= fit
            if len(fit) < len(got):
                return sum(n if (n := self.memo.get(x)) is not None else got[x] for x in cut)
        return sum(map(self.memo.__getitem__, cut))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of each whole text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        have = counter(path)
        for texts in batches:
            yield pd.Series([have.count(t) for t in texts], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs(doc_id, text)``.

    Repeated rows stay repeated; a null doc_id stays null; an empty table gives an empty table; further columns are not
    looked at.
    """
    text = text_of()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
