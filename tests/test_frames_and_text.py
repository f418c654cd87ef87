"""Worked cases of captions, near duplicates, images, the store, scalars and documents."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import images, scalars
from framewright.operators import align, dedup, frames, render
from framewright.profiles import Profile, build_profiles, chapter_numbers, density_name, detector_name, interval_seconds, profile_rows
from framewright.schemas import CAPTION, CHAPTER, FRAME, HASHED_FRAME, STORED_CHAPTER, STORED_FRAME
from framewright.sinks.files import vtt_documents, write_documents, write_files
from framewright.sources import adapters, captions, videos
from framewright.sources.images import read_images


def one(spark, f, *values, types=("string",)):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {t}" for i, t in enumerate(types)))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


# ------------------------------------------------------------------ scalars


@pytest.mark.parametrize("text,want", [("Load Balancing & CDNs", "load-balancing-cdns"), ("Intro: What's New?", "intro-whats-new"), ("  A -- B  ", "a----b"), ("é!", ""), ("--x--", "x")])
def test_slug(spark, text, want):
    assert one(spark, scalars.slug, text) == want


@pytest.mark.parametrize("text,want", [("01:00:00", 3600.0), ("02:30", 150.0), ("90", 90.0), ("1:2.5", 62.5), (" \n", None), (None, None)])
def test_seconds(spark, text, want):
    assert one(spark, scalars.seconds, text) == want


@pytest.mark.parametrize("text", ["x", "1:2:3:4", "1.5:2", ":", "1:"])
def test_seconds_refused(spark, text):
    with pytest.raises(Exception, match="no time"):
        one(spark, scalars.seconds, text)


def test_other_scalars(spark):
    assert one(spark, scalars.vtt_time, 3661.5, types=("double",)) == "01:01:01.500"
    assert one(spark, scalars.vtt_time, 59.9996, types=("double",)) == "00:01:00.000"
    assert [one(spark, scalars.caption_source, p) for p in (None, "a/whisper.vtt", "whisper/x.en.vtt")] == ["none", "whisper", "youtube"]
    assert one(spark, scalars.hamming, -1, 0, types=("bigint", "bigint")) == 64
    assert one(spark, scalars.frame_name, 12.5, types=("double",)) == "frame_00012.50.jpg"
    assert one(spark, scalars.stripped, "\n\t a b  \n") == "a b"


def test_options():
    assert chapter_numbers("0, 2,4,") == {0, 2, 4} and density_name(" High ") == "high" and detector_name("ADAPTIVE") == "adaptive" and interval_seconds(0) == 0
    for f, bad in ((chapter_numbers, "a"), (chapter_numbers, "-1"), (density_name, "x"), (detector_name, "x"), (interval_seconds, -1)):
        with pytest.raises(ValueError):
            f(bad)
    p = build_profiles("high", 5.0)
    assert (p["high"].scene_sample_interval, p["normal"].scene_sample_interval, p["low"].scene_sample_interval) == (5.0, 5.0, 15.0)
    assert build_profiles("low", -3.0)["low"].scene_sample_interval == 0.0


# ------------------------------------------------------------------ captions


def test_align(spark):
    f = spark.createDataFrame([("v", 0, n, float(t), "p", "", True) for n, t in enumerate((5, 50, -2))], FRAME)
    c = spark.createDataFrame([("v", i, a, b, t) for i, (a, b, t) in enumerate([(4.0, 6.0, "Hello"), (8.0, 9.0, "Edge"), (10.0, 12.0, "World"), (0.0, 100.0, "Long"), (7.0, 3.0, "odd")])], CAPTION)
    got = {r["frame_number"]: r["caption_text"] for r in align.align_captions(f, c).collect()}
    assert got == {0: "Hello Edge Long odd", 1: "Long", 2: "Long"}
    narrow = {r["frame_number"]: r["captions"] for r in align.align_captions(f, c.filter("text = 'World'"), 1.0).collect()}
    assert narrow == {0: [], 1: [], 2: []}
    assert {r["caption_text"] for r in align.align_captions(f, c.limit(0)).collect()} == {"_none_"}


def test_align_wrong_end(spark):
    """A caption that never ends has bins within its video's frames only."""
    f = spark.createDataFrame([("v", 0, n, float(t), "p", "", True) for n, t in enumerate((5, 500))], FRAME)
    c = spark.createDataFrame([("v", 0, 4.0, 1e12, "endless"), ("v", 1, 1e12, 2e12, "never"), ("w", 2, 0.0, 9.0, "no frames")], CAPTION)
    got = {r["frame_number"]: r["captions"] for r in align.align_captions(f, c).collect()}
    assert got == {0: ["endless"], 1: ["endless"]}


def test_align_random(spark):
    rng = random.Random(3)
    fs = [(str(n % 3), 0, n, rng.randrange(600) / 4, "p", "", True) for n in range(80)]
    cs = [(str(i % 3), i, (a := rng.randrange(600) / 4), a + rng.randrange(60) / 4, str(i)) for i in range(90)]
    want = {f[2]: [c[4] for c in cs if c[0] == f[0] and c[2] <= f[3] + 3 and c[3] >= f[3] - 3] for f in fs}
    got = {r["frame_number"]: r["captions"] for r in align.align_captions(spark.createDataFrame(fs, FRAME), spark.createDataFrame(cs, CAPTION)).collect()}
    assert got == want


def test_parse_captions(spark):
    vtt = "WEBVTT\r\nKind: captions\r\n\r\nNOTE nothing\r\n\r\n1\r\n00:00:01.000 --> 00:00:02.500 align:start\r\n<c>Two</c>\r\nlines \r\n\r\n00:03.000 --> 00:04.000\r\n \r\n\r\n01:00:05.250 --> 01:00:06.000\r\nlast"
    got = [tuple(r) for r in captions.parse_captions(spark.createDataFrame([("v", vtt)], "video_id string, value string")).orderBy("caption_idx").collect()]
    assert got == [("v", 0, 1.0, 2.5, "Two\nlines"), ("v", 1, 3605.25, 3606.0, "last")]
    assert captions.parse_captions(spark.createDataFrame([("v", "WEBVTT\n")], "video_id string, value string")).count() == 0


def test_captions_out_and_in(spark):
    rows = [("v", 0.0, 1.5, " a "), ("v", 61.25, 62.0, "b\nc"), ("v", 70.0, 71.0, " ")]
    docs = vtt_documents(spark.createDataFrame(rows, "video_id string, start double, end double, text string"))
    back = captions.parse_captions(docs.withColumnRenamed("content", "value")).orderBy("caption_idx").collect()
    assert [(r["start"], r["end"], r["text"]) for r in back] == [(0.0, 1.5, "a"), (61.25, 62.0, "b\nc")]


def test_ocr(spark):
    kind = "id int, items array<struct<box:string,text:string,score:double>>"
    got = captions.ocr_result(spark.createDataFrame([(1, [("b", "Hello World", 0.9), ("b", "", 0.1), ("b", "More text", 0.5)]), (2, []), (3, None)], kind)).orderBy("id").collect()
    assert [(r["text"], r["text_length"]) for r in got] == [("Hello World More text", 21), ("", 0), ("", 0)]


# ------------------------------------------------------------------ near duplicates and images


def kept(spark, rows, profile=Profile("normal", 5.0, 5, 3)):
    df = spark.createDataFrame([("v", 0, float(i), h, s) for i, (h, s) in enumerate(rows)], HASHED_FRAME).withColumn("frame_number", F.col("timestamp").cast("int")).withColumn("density", F.lit("normal"))
    got = dedup.deduplicate_frames(df, profile_rows(spark, {"normal": profile}))
    return [r["frame_number"] for r in got.orderBy("frame_number").collect() if r["is_kept"]]


def test_near_duplicates(spark):
    assert kept(spark, [(7, False)] * 3) == [0]
    assert kept(spark, [(0, False), (3, True)], Profile("normal", 5.0, 5, 1)) == [0, 1]
    assert kept(spark, [(0, False), (31, False)]) == [0, 1]  # five bits: not below the threshold
    assert kept(spark, [(0, False), (15, False), (255, False)]) == [0, 2]  # likeness is not transitive
    assert kept(spark, [(-1, False)]) == [0]
    assert dedup.slide_threshold(5) == 3 and dedup.slide_threshold(2) == 1 and dedup.slide_threshold(5, 2) == 2


def test_unknown_density_raises(spark):
    df = spark.createDataFrame([("v", 0, 1.0, 5, False, 1, "dense")], HASHED_FRAME + ", frame_number int, density string")
    with pytest.raises(Exception, match="unknown density: dense"):
        dedup.deduplicate_frames(df, profile_rows(spark, build_profiles("normal", 5.0))).collect()


def test_near_duplicates_random(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(10), rng.random() < 0.3) for _ in range(60)]
    want = []
    for i, (h, s) in enumerate(rows):
        if not any(bin(h ^ rows[k][0]).count("1") < (2 if s or rows[k][1] else 4) for k in want):
            want.append(i)
    assert kept(spark, rows, Profile("normal", 5.0, 4, 2)) == want


def png(path, m):
    rows = b"".join(b"\0" + bytes(r) for r in m.astype(np.uint8))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", m.shape[1], m.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    bars = np.tile(np.repeat([0, 255], 5), 20)[None, :].repeat(200, 0)
    for name, m in {"dark": np.full((50, 50), 5), "dim": np.full((50, 50), 20), "grey": np.full((200, 200), 128), "bars": bars}.items():
        png(tmp_path / f"{name}.png", m)
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = read_images(spark, str(tmp_path)).select("path", images.is_black(F.col("mean_luma")).alias("black"), images.is_blurry(F.col("lap_var")).alias("blurry"), "edge_density", "phash", images.is_slide_like(F.lit(""), F.col("edge_density")).alias("slide")).collect()
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in rows}
    assert [got[n]["black"] for n in ("dark", "dim", "grey", "bars", "bad")] == [True, False, False, False, True]
    assert [got[n]["blurry"] for n in ("grey", "bars", "bad")] == [True, False, True]
    assert got["bars"]["edge_density"] > 0.08 and got["bars"]["slide"] and got["grey"]["edge_density"] == 0 and got["bad"]["phash"] is None
    assert one(spark, lambda t: images.is_slide_like(t, F.lit(0.0)), "x" * 81) and not one(spark, lambda t: images.is_slide_like(t, F.lit(0.0)), " " * 90 + "x")


def test_perceptual_hash_is_stable_to_small_changes():
    rng = np.random.default_rng(5)
    a = np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16)))
    h = [images.perceptual_hash(x) for x in (a, a + rng.normal(0, 3, a.shape), np.kron(rng.integers(0, 255, (8, 8)), np.ones((16, 16))))]
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(h[0], h[1]) <= 4 < 12 < bits(h[0], h[2])


def test_scenes_from_scores(spark):
    s = [("v", float(t), 50.0 if t in (10, 20) else 1.0) for t in range(30)] + [("w", float(t), 1.0) for t in range(5)] + [("x", 0.0, 99.0), ("x", 0.5, 99.0), ("x", 2.0, 99.0), ("x", 3.0, 0.0)]
    df = spark.createDataFrame(s, "video_id string, t double, score double")
    got = sorted((r["video_id"], r["start"], r["end"]) for r in adapters.scenes_from_scores(df).collect())
    assert got == [("v", 0, 10), ("v", 10, 20), ("v", 20, 29), ("x", 0, 2), ("x", 2, 3)]
    assert {r["video_id"] for r in adapters.scenes_from_scores(df, "adaptive").collect()} == {"v"}


# ------------------------------------------------------------------ the store


def test_video_info(spark):
    rows = ['{"id":"a","title":"T","duration":300,"webpage_url":"u","chapters":[{"title":"x","start_time":0,"end_time":1.5},{"title":"y","start_time":1.5,"end_time":3}]}', '{"id":"b","title":"T","duration":1.5,"webpage_url":"u","description":"d","chapters":null}']
    info = videos.parse_info(spark.createDataFrame([(r,) for r in rows], "json string"))
    assert sorted(tuple(r) for r in videos.videos(info).collect()) == [("a", "T", 300.0, "u", ""), ("b", "T", 1.5, "u", "d")]
    assert [(r["video_id"], r["chapter_number"], r["title"]) for r in videos.chapters(info).orderBy("chapter_number").collect()] == [("a", 0, "x"), ("a", 1, "y")]
    with pytest.raises(Exception, match="lacks title"):
        videos.videos(videos.parse_info(spark.createDataFrame([('{"id":"a","duration":1,"webpage_url":"u"}',)], "json string"))).collect()


def test_store(spark):
    v = spark.createDataFrame([("a", "old", 1.0), ("b", "same", 2.0)], "video_id string, title string, duration double")
    new = spark.createDataFrame([("a", "mid", 9.0, 1), ("a", "new", 8.0, 2), ("c", "first", 3.0, 3), ("c", "second", 4.0, 4)], "video_id string, title string, duration double, seq int")
    assert sorted(tuple(r) for r in frames.upsert_videos(v, new).collect()) == [("a", "new", 1.0), ("b", "same", 2.0), ("c", "second", 3.0)]
    f = spark.createDataFrame([("a", 0, 1, 2.0, "p", None, True), ("a", 1, 2, 1.0, "q", "x", False), ("b", None, 3, 1.0, "r", "y", True)], FRAME)
    assert [r["frame_number"] for r in frames.frames_of(f, True).collect()] == [1, 3] and [r["frame_number"] for r in frames.frames_of(f).collect()] == [2, 1, 3]
    c = spark.createDataFrame([("a", i, "t", 0.0, 1.0, False, None) for i in range(3)], CHAPTER)
    rec = frames.frame_records(c, f).orderBy("chapter_number").collect()
    assert [(r["frame_number"], r["ocr_text"], r["density"]) for r in rec] == [(1, "", "normal"), (2, "x", "normal"), (None, None, "normal")]
    assert [len(r["frames"]) for r in frames.grouped_frames(c, f).orderBy("chapter_number").collect()] == [1, 1, 0]
    marked = frames.set_kept(f, f.filter("frame_number = 2"), True)
    assert all(r["is_kept"] for r in marked.collect()) and not frames.set_kept(f, f.limit(0), True).exceptAll(f).count()
    assert [r["is_kept"] for r in frames.reset_kept(f, "a", False).orderBy("frame_number").collect()] == [False, False, True]
    assert frames.without_videos(f, v.filter("video_id = 'a'")).count() == 1
    assert frames.with_column(v, "is_kept", True).columns[-1] == "is_kept" and frames.with_column(v, "title", "").columns == v.columns
    assert frames.set_ocr(f, spark.createDataFrame([("a", 1, "seen")], "video_id string, frame_number int, ocr_text string")).filter("frame_number = 1").first()["ocr_text"] == "seen"
    assert frames.videos(v, "a").count() == 1


def test_store_inserts(spark):
    """New rows get the next ids in order of arrival, block by block; what they don't say has its default."""
    store = spark.createDataFrame([(7, "a", 0, 1, 2.0, "p", "x", False)], STORED_FRAME)
    new = spark.createDataFrame([(s, "b", s, float(s), f"q{s}") for s in (5, 3, 40, 4, 41)], "seq int, video_id string, frame_number int, timestamp double, path string")
    got = frames.insert_frames(store, new, block=4).orderBy("id").collect()
    assert [(r["id"], r["path"]) for r in got] == [(7, "p"), (8, "q3"), (9, "q4"), (10, "q5"), (11, "q40"), (12, "q41")]
    assert [(r["ocr_text"], r["is_kept"], r["chapter_number"]) for r in got[:2]] == [("x", False, 0), ("", True, None)]
    none = spark.createDataFrame([], STORED_CHAPTER)
    first = spark.createDataFrame([(1, "a", 0, "t", 0.0, 9.0), (2, "a", 1, "u", 9.0, 12.0)], "seq int, video_id string, chapter_number int, title string, start_time double, end_time double")
    assert [(r["id"], r["title"], r["is_synthetic"]) for r in frames.insert_chapters(none, first).orderBy("id").collect()] == [(1, "t", False), (2, "u", False)]
    assert frames.insert_chapters(none, first.limit(0)).count() == 0
    assert frames.copies(store, "vault").first()["copy"] == "vault/a/a_p"


def test_references(spark):
    notes = spark.createDataFrame([("see ![[v_frame_1.jpg]] and ![[v_frame_2.jpg]] ![[v_frame_1.jpg]]",)], "text string")
    used = frames.embedded(notes, r"!\[\[(v_frame_[^\]]+)\]\]")
    files = spark.createDataFrame([(f"v_frame_{i}.jpg",) for i in range(4)], "name string")
    assert sorted(r["name"] for r in frames.unused(files, used).collect()) == ["v_frame_0.jpg", "v_frame_3.jpg"]


# ------------------------------------------------------------------ documents


def documents(spark, n_chapters, n_frames):
    v = spark.createDataFrame([("vid", 'A "title"', 300.0, "")], "video_id string, title string, duration double, description string")
    c = spark.createDataFrame([("vid", i, "Load Balancing", 60.0 * i, 60.0 * (i + 1), False, "high") for i in range(n_chapters)], CHAPTER)
    f = spark.createDataFrame([("vid", 0, i, float(i), f"f{i}.jpg", "code" if i == 0 else "", True) for i in range(n_frames)], FRAME)
    k = spark.createDataFrame([("vid", 0, 0.0, 1.0, "Hello"), ("vid", 1, 1.0, 2.0, "there")], CAPTION)
    return render.manifests(v, c, f, k)


def test_manifest_text(spark):
    r = documents(spark, 1, 1).first()
    assert r["path"] == "manifest.md"
    assert r["content"] == "\n".join(
        ["---", "video_id: vid", 'video_title: "A \\"title\\""', "duration: 300.0", "frame_count: 1", "density: high", "detector: content", "sensitivity: 30.0", "scene_sample_interval: 3.0", "slide_aware_dedup: true", "ocr_applied: false", "caption_source: youtube", "manifest_version: 3", "---", ""]
        + ['# Manifest: A "title"', "", "## Video Context (verbatim from YouTube)", "", "_No description available._", "", "## Running Summary", "", "_Not yet processed._", "", "---", ""]
        + ["## Chunk 1 of 1", "", "### Instructions", "", render.LOOK, "", "### Frame 0 @ 0.0s", "", "![frame](f0.jpg)", "", "**Caption:** Hello there", "**OCR:** code", "", "### Analysis", "", render.TO_FILL, "", "---", ""]
        + ["---", "", "## Final Synthesis", "", "**Target output path:** `output/vid-research-note.md`", "", "### Output Frontmatter Template", "", "```yaml", "---", "video_id: vid", 'title: "A \\"title\\""', "type: yt-research-note", "created: YYYY-MM-DD", "tags: []", "---", "```", "", "### Instructions", "", *render.STEPS, ""]
    )


def test_chapter_manifests(spark, tmp_path):
    docs = documents(spark, 3, 25).orderBy("chapter_number").cache()
    rows = docs.collect()
    assert [r["path"] for r in rows] == [f"manifest-0{i}-load-balancing.md" for i in range(3)]
    first, empty = rows[0]["content"], rows[2]["content"]
    assert first.count("## Chunk") == 3 and "## Chunk 3 of 3" in first and first.count("### Frame") == 25 and "frame_count: 25" in first
    assert "chapter_timerange: 120.0-180.0" in empty and "## Chunk" not in empty and "---\n\n---\n\n## Final Synthesis" in empty
    assert write_files(docs, f"file://{tmp_path}/out") == 3
    assert (tmp_path / "out/vid" / rows[0]["path"]).read_text() == first and len(list((tmp_path / "out/vid").iterdir())) == 3
    (tmp_path / "out/vid/manifest-09-gone.md").write_text("old")
    (tmp_path / "out/vid/notes.md").write_text("mine")
    assert write_files(docs.filter("chapter_number < 2"), f"file://{tmp_path}/out", "manifest*.md") == 2
    assert sorted(p.name for p in (tmp_path / "out/vid").iterdir()) == sorted([r["path"] for r in rows[:2]] + ["notes.md"])
    assert write_files(docs.limit(0), f"file://{tmp_path}/out") == 0
    write_documents(docs, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 3


def test_caption_files(spark):
    f = spark.createDataFrame([("a", "x/b.vtt"), ("a", "x/a.vtt"), ("a", "x/a.mp4"), ("b", "y/z.vtt"), ("b", "y/whisper.vtt")], "video_id string, path string")
    assert {r["video_id"]: r["path"] for r in videos.caption_file(f).collect()} == {"a": "x/a.vtt", "b": "y/whisper.vtt"}
    assert videos.chosen_file(f, r"\.mp4$").first()["path"] == "x/a.mp4"
