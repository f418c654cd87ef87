"""Command line: ``python -m framewright process LANDING``.

LANDING is a folder of any file system that Spark reads, where downloading has left its files: ``fetch`` does that by a
program, or another system.  It holds ``info/*.json``, ``captions/<video_id>*.vtt``, and where they exist the tables
``scores`` (video_id, t, score), ``measures`` (path and image measures), ``ocr`` (video_id, frame_number, items) and
``speech`` (video_id, start, end, text).  All its videos are processed in one run.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import cues, frames, render
from .plans import timeline
from .plans.stages import STAGES, Marks, fingerprint, stage_name
from .profiles import build_profiles, chapter_numbers, density_name, detector_name, interval_seconds, profile_rows
from .sinks.files import write_files
from .sources import adapters, captions, videos
from .sources.programs import Programs


def _seconds(text: str) -> float | None:
    """``SS``, ``MM:SS`` or ``HH:MM:SS``; nothing for a blank."""
    if not text.strip():
        return None
    *whole, last = text.strip().split(":")
    if len(whole) > 2:
        raise ValueError(f"no time: {text!r}")
    value = 0
    for part in whole:
        value = (value + int(part)) * 60
    return value + float(last)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framewright", description=__doc__.split("\n")[0])
    commands = p.add_subparsers(dest="command", required=True)
    get = commands.add_parser("fetch", help="land info, captions and videos of addresses by a program on the machines")
    get.add_argument("landing", help="a folder that is the same on all machines")
    get.add_argument("urls", nargs="+")
    run = commands.add_parser("process", help="plan frames and write manifests for all videos of a landing folder")
    run.add_argument("landing")
    run.add_argument("--cache-dir", default="cache", help="where tables, marks and manifests go")
    run.add_argument("--force", action="store_true", help="do every stage again")
    run.add_argument("--from-stage", type=stage_name, help=f"do this stage and the later ones again: {', '.join(STAGES)}")
    run.add_argument("--thorough", action="store_true", help="scenes and dense samples instead of transcript and chapters")
    run.add_argument("--max-frames", type=int, default=200, help="budget a video, without --thorough")
    run.add_argument("--no-ocr", action="store_true")
    run.add_argument("--no-filter", action="store_true", help="no quality check and no near-duplicate removal")
    run.add_argument("--max-frames-per-chunk", type=int, default=render.PER_CHUNK)
    run.add_argument("--detector", type=detector_name, default="content")
    run.add_argument("--sensitivity", type=float, default=30.0)
    run.add_argument("--scene-sample-interval", type=lambda x: interval_seconds(float(x)), default=5.0)
    run.add_argument("--density", type=density_name, default="normal")
    run.add_argument("--dense-chapters", type=chapter_numbers, default=set())
    run.add_argument("--dense-until", type=_seconds, default=None)
    return p


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def process(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Runs the stages that are not done for these parameters; returns the manifests."""
    if "://" not in a.cache_dir and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"--cache-dir {a.cache_dir}: the machines of a cluster need a URI that all of them reach")
    marks = Marks(spark, f"{a.cache_dir}/.stages")
    if a.force:
        marks.clear()
    elif a.from_stage:
        marks.clear(a.from_stage)
    at = lambda name: f"{a.cache_dir}/{name}"
    profiles = build_profiles(a.density, a.scene_sample_interval)

    info = marks.run("fetch", fingerprint(landing=a.landing), at("info"), lambda: videos.read_info(spark, f"{a.landing}/info"))
    store = videos.videos(info)
    chapters = timeline.prepared_chapters(store, videos.chapters(info), a.density, sorted(a.dense_chapters), a.dense_until)

    files = spark.read.text(f"{a.landing}/captions", wholetext=True).select(F.input_file_name().alias("path"), "value")
    files = files.withColumn("video_id", F.regexp_extract("path", r"([^/.]+)\.[^/]*vtt$", 1))
    texts = files.join(videos.caption_file(files.select("video_id", "path")), ["video_id", "path"])
    said = captions.parse_captions(texts)
    speech = _optional(spark, f"{a.landing}/speech")
    if speech is not None:
        bare = speech.join(said.select("video_id").distinct(), "video_id", "left_anti")
        order = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "end")) - 1
        said = said.unionByName(bare.select("video_id", order.alias("caption_idx"), "start", "end", "text"))

    planned = {"thorough": a.thorough, "max": a.max_frames, "detector": a.detector, "sensitivity": a.sensitivity, "density": a.density, "interval": a.scene_sample_interval, "dense": sorted(a.dense_chapters), "until": a.dense_until, "landing": a.landing}

    def extract() -> DataFrame:
        if a.thorough:
            scores = _optional(spark, f"{a.landing}/scores")
            if scores is None:
                raise FileNotFoundError(f"{a.landing}/scores: --thorough needs the frames' scores")
            scenes = adapters.scenes_from_scores(scores, a.detector, a.sensitivity)
            points = timeline.thorough_plan(scenes, chapters, profile_rows(spark, profiles)).withColumn("origin", F.lit("scene"))
        else:
            segments = said.select("video_id", F.col("caption_idx").alias("seg_idx"), "start", "text")
            points = timeline.light_plan(segments, chapters, tuple(cues.TIERS), budget=a.max_frames)
        return adapters.Tables(info, texts).frames(points.select("video_id", "chapter_number", "density", "frame_number", "timestamp", "origin"))

    taken = marks.run("extract", fingerprint(**planned), at("frames"), extract)

    def recognised() -> DataFrame:
        items = None if a.no_ocr else _optional(spark, f"{a.landing}/ocr")
        blank = taken.withColumn("ocr_text", F.lit(""))
        return blank if items is None else frames.set_ocr(blank, captions.ocr_result(items).select("video_id", "frame_number", F.col("text").alias("ocr_text")))

    read = marks.run("ocr", fingerprint(no_ocr=a.no_ocr, **planned), at("ocr"), recognised)

    def deduplicated() -> DataFrame:
        if not a.thorough or a.no_filter:
            return read.withColumn("is_kept", F.lit(True))
        measures = _optional(spark, f"{a.landing}/measures")
        if measures is None:
            raise FileNotFoundError(f"{a.landing}/measures: --thorough needs the frames' measures, or --no-filter")
        return timeline.keep_frames(read.join(measures, "path", "left"), profile_rows(spark, profiles)).select(*read.columns, "is_kept")

    judged = {"no_ocr": a.no_ocr, "no_filter": a.no_filter, **planned}
    kept = marks.run("dedup-with-ocr-context", fingerprint(**judged), at("kept"), deduplicated).filter("is_kept")
    lines = marks.run("align", fingerprint(landing=a.landing), at("captions"), lambda: said)

    def manifests() -> DataFrame:
        source = texts.select("video_id", F.when(F.element_at(F.split("path", "/"), -1).contains("whisper"), "whisper").otherwise("youtube").alias("s"))
        spoken = lines.select("video_id").distinct().withColumn("_w", F.lit("whisper"))
        known = store.join(source, "video_id", "left").join(spoken, "video_id", "left").withColumn("caption_source", F.coalesce("s", "_w", F.lit("none")))
        return render.manifests(known, chapters, kept, lines, detector=a.detector, sensitivity=a.sensitivity, intervals={n: p.scene_sample_interval for n, p in profiles.items()}, density=a.density, slide_aware=not a.no_filter, ocr_applied=not a.no_ocr, per_chunk=a.max_frames_per_chunk)

    docs = marks.run("manifest", fingerprint(chunk=a.max_frames_per_chunk, **judged), at("manifests"), manifests)
    write_files(docs, a.cache_dir + "/documents" if "://" in a.cache_dir else "file://" + os.path.abspath(a.cache_dir) + "/documents", "manifest*.md")
    return docs


def fetch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lands the addresses' files, as ``process`` reads them."""
    urls = spark.createDataFrame([(u,) for u in a.urls], "url string").repartition(len(a.urls))
    return Programs(os.path.abspath(a.landing)).fetch(urls)


def counts(spark: SparkSession, cache_dir: str) -> DataFrame:
    """``stage, rows, videos``: what each stage's table holds."""
    out = None
    for stage, name in (("fetch", "info"), ("extract", "frames"), ("ocr", "ocr"), ("dedup-with-ocr-context", "kept"), ("align", "captions"), ("manifest", "manifests")):
        t = spark.read.parquet(f"{cache_dir}/{name}")
        if name == "kept":
            t = t.filter("is_kept")
        elif name == "ocr":
            t = t.filter("ocr_text != ''")
        one = t.agg(F.count("*").alias("rows"), F.countDistinct(t["id" if name == "info" else "video_id"]).alias("videos")).select(F.lit(stage).alias("stage"), "rows", "videos")
        out = one if out is None else out.unionByName(one)
    return out


def main(args: Sequence[str] | None = None) -> int:
    from .session import session

    a = parser().parse_args(args)
    spark = session()
    if a.command == "fetch":
        for r in fetch(spark, a).collect():  # a row an address asked for
            print(f"{r['url']}: {r['video_id']}")
        return 0
    process(spark, a)
    for r in counts(spark, a.cache_dir).collect():  # a row a stage
        print(f"{r['stage']}: {r['rows']} rows of {r['videos']} videos")
    return 0
