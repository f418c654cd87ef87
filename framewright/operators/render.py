"""Manifests: Markdown documents of a video or a chapter, rendered as columns.

Each frame becomes a text, each chunk of frames joins its texts, each document its chunks.  No document is built on the
driver; a chapter's frames meet in one row, which is as large as the document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import slug, yes_no
from ..profiles import PROFILES
from .align import align_captions

PER_CHUNK = 12

#: The texts of a manifest, in order of appearance.
LOOK = "View each frame below. Describe what you see. Note any diagrams, code, or text on screen."
TO_FILL = "_Agent fills this after viewing all frames in this chunk._"
CONTEXT = "## Video Context (verbatim from YouTube)"
NO_DESCRIPTION = "_No description available._"
SUMMARY = ["## Running Summary", "", "_Not yet processed._", "", "---", ""]
NOTE_TYPE = "type: yt-research-note"
STEPS = [
    "1. Review each chunk analysis above and synthesize into a coherent research note.",
    "2. Update the Running Summary with the final synthesis.",
    "3. Preserve all code blocks and Mermaid diagrams verbatim — do not paraphrase or summarize code.",
    "4. Preserve any diagrams exactly as they appear.",
    "5. Write the final research note to the target output path.",
]


def _lines(*parts: Column | str) -> Column:
    """Parts joined by line feeds; null parts are left out, with their line."""
    return F.array_join(F.array_compact(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))), "\n")


def frame_text() -> Column:
    """A frame's section, with an empty line at its end."""
    ocr = F.when(F.coalesce(F.col("ocr_text"), F.lit("")) != "", F.concat(F.lit("**OCR:** "), F.col("ocr_text")))
    head = F.format_string("### Frame %d @ %.1fs", F.col("frame_number"), F.col("timestamp"))
    return _lines(head, "", F.format_string("![frame](%s)", F.col("path")), "", F.concat(F.lit("**Caption:** "), F.col("caption_text")), ocr, "")


def chunked(frames: DataFrame, per_chunk: int = PER_CHUNK, by: tuple[str, ...] = ("video_id", "chapter_number")) -> DataFrame:
    """``frames`` with ``chunk`` from 1 and ``chunks``, their number, by document."""
    order = Window.partitionBy(*by).orderBy("timestamp", "frame_number")
    n = F.count("*").over(Window.partitionBy(*by))
    return frames.withColumn("chunk", (F.floor((F.row_number().over(order) - 1) / per_chunk) + 1).cast("int")).withColumn("chunks", F.ceil(n / per_chunk).cast("int"))


def frames_section(frames: DataFrame, by: tuple[str, ...] = ("video_id", "chapter_number")) -> DataFrame:
    """``by``, ``section``: the frames' texts without chunks."""
    item = F.struct("timestamp", "frame_number", frame_text().alias("t"))
    return frames.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("x")).select(*by, F.array_join(F.col("x.t"), "\n").alias("section"))


def chunk_sections(frames: DataFrame, per_chunk: int = PER_CHUNK, by: tuple[str, ...] = ("video_id", "chapter_number")) -> DataFrame:
    """``by``, ``frame_count``, ``section``: the frames of each document in chunks."""
    item = F.struct("timestamp", "frame_number", frame_text().alias("t"))
    each = chunked(frames, per_chunk, by).groupBy(*by, "chunk", "chunks").agg(F.array_sort(F.collect_list(item)).alias("x"), F.count("*").alias("n"))
    text = _lines(F.format_string("## Chunk %d of %d", F.col("chunk"), F.col("chunks")), "", "### Instructions", "", LOOK, "", F.array_join(F.col("x.t"), "\n"), "### Analysis", "", TO_FILL, "", "---", "")
    chunks = each.select(*by, "n", F.struct("chunk", text.alias("t")).alias("c"))
    return chunks.groupBy(*by).agg(F.sum("n").alias("frame_count"), F.array_sort(F.collect_list("c")).alias("c")).select(*by, "frame_count", F.array_join(F.col("c.t"), "\n").alias("section"))


def _quoted(text: Column) -> Column:
    """A title between quotes, its own quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def _plain(x: float | int) -> str:
    return str(float(x)) if isinstance(x, float) else str(x)


def manifests(
    videos: DataFrame, chapters: DataFrame, frames: DataFrame, captions: DataFrame, *, detector: str = "content", sensitivity: float = 30.0, intervals: dict[str, float] | None = None,
    density: str = "normal", slide_aware: bool = True, ocr_applied: bool = False, source: str = "youtube", per_chunk: int = PER_CHUNK, window: float = 3.0,
) -> DataFrame:
    """``video_id, chapter_number, path, content``: a document for each chapter, those without frames too.

    A video of one chapter gets ``manifest.md`` without the chapter's lines; others ``manifest-NN-slug.md`` each.
    Titles are escaped inside quotes.  ``videos`` may have ``caption_source``, else ``source`` holds for all.
    """
    keys = ["video_id", "chapter_number"]
    texts = frames.join(align_captions(frames, captions, window).select("video_id", "frame_number", "caption_text"), ["video_id", "frame_number"])
    sections = chunk_sections(texts, per_chunk)
    v = videos.select("video_id", F.col("title").alias("video_title"), "duration", "description", *([F.col("caption_source")] if "caption_source" in videos.columns else [F.lit(source).alias("caption_source")]))
    n = F.count("*").over(Window.partitionBy("video_id"))
    rows = chapters.withColumn("_n", n).join(v, "video_id").join(sections, keys, "left").withColumn("frame_count", F.coalesce("frame_count", F.lit(0)))
    many, number = F.col("_n") > 1, F.format_string("%02d", F.col("chapter_number"))
    name = slug(F.col("title"))
    only = lambda c: F.when(many, c)  # noqa: E731  lines of chapter documents
    say = lambda key, c: F.concat(F.lit(f"{key}: "), c.cast("string"))
    row_density = F.coalesce(F.col("density"), F.lit(density)) if "density" in chapters.columns else F.lit(density)
    known = intervals or {p.name: p.scene_sample_interval for p in PROFILES.values()}
    interval = F.create_map(*(F.lit(x) for k, x in known.items() for x in (k, float(x))))[row_density]
    target = F.when(many, F.concat(F.col("video_id").cast("string"), F.lit("-ch"), number, F.lit("-"), name, F.lit(".md"))).otherwise(F.concat(F.col("video_id").cast("string"), F.lit("-research-note.md")))
    full_title = F.when(many, F.concat(F.col("video_title"), F.lit(" — "), F.col("title"))).otherwise(F.col("video_title"))
    content = _lines(
        "---", say("video_id", F.col("video_id")), F.concat(F.lit("video_title: "), _quoted(F.col("video_title"))), say("duration", F.col("duration")),
        only(say("chapter_number", F.col("chapter_number"))), only(F.concat(F.lit("chapter_title: "), _quoted(F.col("title")))), only(F.concat(F.lit("chapter_timerange: "), F.col("start_time").cast("string"), F.lit("-"), F.col("end_time").cast("string"))),
        say("frame_count", F.col("frame_count")), say("density", row_density), f"detector: {detector}", f"sensitivity: {_plain(sensitivity)}", say("scene_sample_interval", interval),
        say("slide_aware_dedup", yes_no(F.lit(slide_aware))), say("ocr_applied", yes_no(F.lit(ocr_applied))), say("caption_source", F.col("caption_source")), "manifest_version: 3", "---", "",
        F.when(many, F.concat(F.format_string("# Manifest: Chapter %d — ", F.col("chapter_number")), F.col("title"))).otherwise(F.concat(F.lit("# Manifest: "), F.col("video_title"))), "",
        CONTEXT, "", F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.col("description")).otherwise(NO_DESCRIPTION), "", *SUMMARY,
        F.col("section"),
        "---", "", "## Final Synthesis", "", F.concat(F.lit("**Target output path:** `output/"), target, F.lit("`")), "",
        "### Output Frontmatter Template", "", "```yaml", "---", say("video_id", F.col("video_id")), F.concat(F.lit("title: "), _quoted(full_title)), NOTE_TYPE, only(say("chapter", F.col("chapter_number"))), "created: YYYY-MM-DD", "tags: []", "---", "```", "",
        "### Instructions", "", *STEPS, "",
    )
    path = F.when(many, F.concat(F.lit("manifest-"), number, F.lit("-"), name, F.lit(".md"))).otherwise("manifest.md")
    return rows.select(*keys, path.alias("path"), content.alias("content"))
