"""Timed captions: WebVTT texts to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import seconds, stripped

_TIMES = r"(?m)^\s*((?:[0-9]+:)?[0-9]{2}:[0-9]{2}[.,][0-9]{3})\s+-->\s+((?:[0-9]+:)?[0-9]{2}:[0-9]{2}[.,][0-9]{3})[^\n]*"


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: the whole text of each caption file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def parse_captions(texts: DataFrame, key: str = "video_id", value: str = "value") -> DataFrame:
    """``key, caption_idx, start, end, text`` of each cue with text, in file order.

    Cues are blocks between blank lines with a time line; what follows that line is the text, lines kept, ends stripped.
    """
    plain = F.regexp_replace(F.col(value), r"\r\n?", "\n")
    block = texts.select(key, F.posexplode(F.split(plain, r"\n[ \t]*\n")).alias("_i", "_b")).filter(F.col("_b").rlike(_TIMES))
    when = lambda g: seconds(F.replace(F.regexp_extract("_b", _TIMES, g), F.lit(","), F.lit(".")))
    body = F.regexp_replace(F.regexp_replace("_b", rf"(?ms)\A.*?{_TIMES[4:]}", ""), r"<[^>\n]*>", "")
    cue = block.select(key, "_i", when(1).alias("start"), when(2).alias("end"), stripped(body).alias("text")).filter(F.length("text") > 0)
    order = F.array_sort(F.collect_list(F.struct("_i", "start", "end", "text")))
    return cue.groupBy(key).agg(order.alias("c")).select(key, F.posexplode("c").alias("caption_idx", "c")).select(key, "caption_idx", "c.start", "c.end", "c.text")


def ocr_result(items: DataFrame, column: str = "items") -> DataFrame:
    """``items`` rows with ``text, text_length``: the texts of recognised items, joined by blanks; confidence is not looked at."""
    said = F.filter(F.transform(column, lambda x: x["text"]), lambda t: t.isNotNull() & (t != ""))
    text = stripped(F.array_join(said, " "))
    return items.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("text_length", F.length("text"))
