"""The command line over a landed folder of two videos."""

import json

import pytest

from framewright.cli import counts, parser, process
from framewright.plans.stages import STAGES


@pytest.fixture
def landing(spark, tmp_path):
    at = tmp_path / "in"
    for d in ("info", "captions"):
        (at / d).mkdir(parents=True)
    (at / "info/a.json").write_text(json.dumps({"id": "a", "title": "First", "duration": 120, "webpage_url": "u", "description": "About", "chapters": [{"title": "One", "start_time": 0, "end_time": 60}, {"title": "Two", "start_time": 60, "end_time": 120}]}))
    (at / "info/b.json").write_text(json.dumps({"id": "b", "title": "Second", "duration": 90, "webpage_url": "u"}))
    (at / "captions/a.en.vtt").write_text("WEBVTT\n\n00:00:10.000 --> 00:00:12.000\nas you can see\n")
    (at / "captions/a.whisper.vtt").write_text("WEBVTT\n\n00:01:10.000 --> 00:01:12.000\nlook at this\n")
    spark.createDataFrame([("b", 5.0, 6.0, "this slide")], "video_id string, start double, end double, text string").write.parquet(str(at / "speech"))
    spark.createDataFrame([(v, float(t), 50.0 if t == 30 else 0.0) for v in "ab" for t in range(90)], "video_id string, t double, score double").write.parquet(str(at / "scores"))
    spark.createDataFrame([("a", 0, [("b", "code", 0.9)])], "video_id string, frame_number int, items array<struct<box:string,text:string,score:double>>").write.parquet(str(at / "ocr"))
    spark.createDataFrame([(f"a/frame_{t:08.2f}.jpg", 50.0, 500.0, 0.0, h) for t, h in ((0.0, 0), (5.0, 1), (10.0, 1023))], "path string, mean_luma double, lap_var double, edge_density double, phash bigint").write.parquet(str(at / "measures"))
    return at


def run(spark, landing, *more):
    return {(r["video_id"], r["path"]): r["content"] for r in process(spark, parser().parse_args(["process", str(landing), "--cache-dir", str(landing.parent / "cache"), *more])).collect()}


def test_light(spark, landing):
    docs = run(spark, landing)
    assert set(docs) == {("a", "manifest-00-one.md"), ("a", "manifest-01-two.md"), ("b", "manifest.md")}
    assert "**Caption:** look at this" in docs["a", "manifest-01-two.md"] and "caption_source: whisper" in docs["a", "manifest-01-two.md"]
    assert "**OCR:** code" in docs["a", "manifest-00-one.md"] and "About" in docs["a", "manifest-00-one.md"]
    assert "### Frame 0 @ 5.0s" in docs["b", "manifest.md"] and "**Caption:** this slide" in docs["b", "manifest.md"]
    assert (landing.parent / "cache/documents/b/manifest.md").read_text() == docs["b", "manifest.md"]
    again = run(spark, landing, "--no-ocr", "--max-frames-per-chunk", "1")
    assert "OCR" not in again["a", "manifest-00-one.md"] and "## Chunk 2 of" in again["a", "manifest-00-one.md"] and "ocr_applied: false" in again["b", "manifest.md"]


def test_thorough(spark, landing):
    docs = run(spark, landing, "--thorough", "--dense-chapters", "1", "--force")
    first = docs["a", "manifest-00-one.md"]
    assert "### Frame 0 @ 0.0s" in first and "### Frame 1 @ 5.0s" not in first and "### Frame 2 @ 10.0s" in first
    assert "density: high" in docs["a", "manifest-01-two.md"]
    every = run(spark, landing, "--thorough", "--dense-chapters", "1", "--no-filter", "--from-stage", "ocr")
    assert "### Frame 1 @ 5.0s" in every["a", "manifest-00-one.md"]


def test_thorough_without_measures(spark, landing):
    """Nothing is kept in silence: without measures there is no filter to run, and it says so."""
    import shutil

    shutil.rmtree(landing / "measures")
    with pytest.raises(FileNotFoundError, match="measures"):
        run(spark, landing, "--thorough")
    assert run(spark, landing, "--thorough", "--no-filter")
    got = {r["stage"]: (r["rows"], r["videos"]) for r in counts(spark, str(landing.parent / "cache")).collect()}
    assert got["fetch"] == (2, 2) and got["manifest"] == (3, 2) and got["extract"] == got["dedup-with-ocr-context"] and set(got) == set(STAGES)


def test_local_cache_on_a_cluster():
    from types import SimpleNamespace

    a = parser().parse_args(["process", "in"])
    with pytest.raises(ValueError, match="cache-dir"):
        process(SimpleNamespace(sparkContext=SimpleNamespace(master="yarn")), a)


def test_bad_options():
    for bad in (["--density", "x"], ["--detector", "x"], ["--scene-sample-interval", "-1"], ["--from-stage", "x"], ["--dense-chapters", "a"], ["--dense-until", "1:2:3:4"]):
        with pytest.raises(SystemExit):
            parser().parse_args(["process", "in", *bad])
