"""Finding moments in transcripts: tiered phrases, and one moment a window."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stripped

#: Phrases by tier, from explicit references to hints; earlier phrases win at the same place.
TIERS: dict[int, tuple[str, ...]] = {
    1: (
        "as you can see", "look at this", "this slide", "this diagram", "this chart", "on screen", "let me show", "here's the",
        "here is the", "take a look", "this image", "this screenshot", "this example", "watch this", "right here", "this is what",
        "you'll see", "you can see", "shown here", "displayed here", "see this", "see here", "notice this", "notice how",
        "look here", "check this out", "here we have", "here you can see", "on the screen", "what you see", "what we see",
    ),
    2: (
        "let me pull up", "if i open", "switching to", "let me share", "i'll demonstrate", "here's my", "in this file",
        "this folder", "this window", "the ui shows", "this interface", "this is my", "let me go to", "open this up",
        "let me navigate", "let me click", "the screen shows", "i'm going to show", "what it looks like", "looks like this",
    ),
    3: (
        "the numbers show", "these results", "this benchmark", "the data", "this framework", "this architecture",
        "this workflow", "this structure", "step one", "step two", "step three", "the process", "this table", "this graph",
        "this model", "these metrics", "the comparison", "this layout", "this design", "this pattern",
    ),
}


def tier_pattern(phrases: Sequence[str]) -> str:
    """Any of the phrases, as they are, from a word's beginning on, in any case.  No boundary at the end: "the database" has
    "the data"."""
    return r"(?iu)\b(?:" + "|".join(re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", p) for p in phrases) + ")"


def cue_of(text: Column, tiers: Sequence[int] = (1, 2, 3)) -> Column:
    """struct(tier, phrase) of the first tier, among those asked for, that has a phrase in the text; null if none has."""
    found = []
    for tier in sorted(t for t in TIERS if t in tiers):
        hit = F.regexp_extract(text, tier_pattern(TIERS[tier]), 0)
        found.append(F.when(hit != "", F.struct(F.lit(tier).alias("tier"), F.lower(hit).alias("phrase"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<tier:int,phrase:string>")


def find_cues(segments: DataFrame, tiers: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``video_id, seg_idx, timestamp, tier, phrase, context``: at most one cue a segment.

    A missing text is empty, a missing start 0.
    """
    text = F.coalesce("text", F.lit(""))
    cue = segments.select("video_id", "seg_idx", F.coalesce("start", F.lit(0.0)).alias("timestamp"), cue_of(text, tiers).alias("_cue"), stripped(text).alias("context"))
    return cue.filter(F.col("_cue").isNotNull()).select("video_id", "seg_idx", "timestamp", "_cue.tier", "_cue.phrase", "context")


def deduplicate_cues(cues: DataFrame, window: float = 15.0) -> DataFrame:
    """One cue a group.  A group opens at a cue and takes in all up to ``window`` seconds after that first one.

    This is no session window, whose gap counts from the last cue, and no tumbling window, whose origin is fixed: the fold
    carries the opening time of the group.  The cue of the lowest tier stays, then the earliest, then the first segment.
    One video's cues are folded at a time; a shuffle by video brings them together.  A fold copies its result at each step,
    so it goes by parts, as many as a part has cues: n cues take about n ** 1.5 copies and not n ** 2.
    """
    one = F.struct("timestamp", "seg_idx", "tier", "phrase", "context")
    rank = lambda c: F.struct(c["tier"], c["timestamp"], c["seg_idx"])
    lists = cues.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("cues"))
    kind = dict(lists.dtypes)["cues"][6:-1]
    zero = F.struct(F.lit(None).cast("double").alias("opened"), F.lit(None).cast(kind).alias("best"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        inside = acc["opened"].isNotNull() & (c["timestamp"] - acc["opened"] <= window)
        return F.struct(
            F.when(inside, acc["opened"]).otherwise(c["timestamp"]).alias("opened"),
            F.when(inside & (rank(acc["best"]) <= rank(c)), acc["best"]).otherwise(c).alias("best"),
            F.when(inside | acc["opened"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["best"]))).alias("out"),
        )

    size = F.ceil(F.sqrt(F.size("cues"))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.slice("cues", i * size + 1, size))
    start = F.struct(zero["opened"].alias("opened"), zero["best"].alias("best"), F.array().cast(f"array<array<{kind}>>").alias("out"))

    def fold(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["opened"].alias("opened"), acc["best"].alias("best"), zero["out"].alias("out")), step)
        return F.element_at(F.transform(F.array(inner), lambda x: F.struct(x["opened"].alias("opened"), x["best"].alias("best"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), 1)

    kept = F.aggregate(parts, start, fold, lambda acc: F.concat(F.flatten(acc["out"]), F.array(acc["best"])))
    return lists.select("video_id", F.explode(kept).alias("c")).select("video_id", "c.seg_idx", "c.timestamp", "c.tier", "c.phrase", "c.context")


def cue_timestamps(segments: DataFrame, tiers: Sequence[int] = (1, 2, 3), window: float = 15.0) -> DataFrame:
    """``video_id, timestamp`` of the cues that stay."""
    return deduplicate_cues(find_cues(segments, tiers), window).select("video_id", "timestamp")
