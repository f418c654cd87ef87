"""Programs behind the adapters: small scripts stand in for them, or nothing does."""

import os
import stat

import pytest

from framewright.cli import fetch, parser
from framewright.sources import captions, programs

FETCHER = """#!/bin/sh
while [ "$1" != "--output" ]; do shift; done
at=$(dirname "$2"); for url; do :; done
echo "{\\"id\\": \\"${url##*/}\\", \\"title\\": \\"T\\"}" > $at/source.info.json
echo film > $at/source.mp4
echo WEBVTT > $at/source.en.vtt
"""
DECODER = """#!/bin/sh
case "$*" in
  *scene*) printf 'frame:0 pts:0 pts_time:0\\nlavfi.scene_score=0.01\\nframe:1 pts:9 pts_time:1.5\\nlavfi.scene_score=0.42\\n';;
  *wav*) for a; do case $a in *.wav) echo sound > $a;; esac; done;;
  *) for a; do last=$a; done; echo "$2 $4" > $last;;
esac
"""
READER = "#!/bin/sh\nprintf 'left\\ttop\\twidth\\theight\\tconf\\ttext\\n1\\t2\\t3\\t4\\t90\\tHello\\n0\\t0\\t9\\t9\\t-1\\t \\n5\\t2\\t3\\t4\\t80\\tWorld\\n'\n"


@pytest.fixture
def tools(tmp_path):
    for name, text in (("fetcher", FETCHER), ("decoder", DECODER), ("reader", READER)):
        f = tmp_path / name
        f.write_text(text)
        f.chmod(f.stat().st_mode | stat.S_IEXEC)
    return programs.Programs(str(tmp_path / "shared"), *(str(tmp_path / n) for n in ("fetcher", "decoder", "reader")), listener=lambda sound: [(0.0, 1.5, open(sound).read().strip())])


def test_fetch_decode_read_listen(spark, tools):
    films = spark.createDataFrame([tuple(r) for r in tools.fetch(spark.createDataFrame([("http://x/a",), ("http://x/b",)], "url string")).collect()], "url string, video_id string, path string")
    assert sorted(os.listdir(f"{tools.folder}/info")) == ["a.json", "b.json"] and sorted(os.listdir(f"{tools.folder}/captions")) == ["a.en.vtt", "b.en.vtt"]
    points = spark.createDataFrame([("a", 0, 2.5), ("a", 1, 2.5), ("b", 0, 61.25)], "video_id string, frame_number int, timestamp double")
    taken = tools.frames(points, films).collect()
    assert sorted((r["video_id"], r["frame_number"], os.path.basename(r["path"])) for r in taken) == [("a", 0, "frame_00002.50.jpg"), ("a", 1, "frame_00002.50.jpg"), ("b", 0, "frame_00061.25.jpg")]
    assert open(taken[0]["path"]).read().split()[1].startswith(f"{tools.folder}/videos/") and not [f for f in os.listdir(f"{tools.folder}/frames/a") if "part" in f]
    assert sorted(map(tuple, tools.scores(films).collect())) == [(v, t, s) for v in "ab" for t, s in ((0.0, 1.0), (1.5, 42.0))]
    read = captions.ocr_result(tools.recognised(tools.frames(points, films))).collect()
    assert {r["text"] for r in read} == {"Hello World"}
    assert sorted(map(tuple, tools.transcribed(films).collect())) == [(v, 0.0, 1.5, "sound") for v in "ab"]


def test_missing_and_failing_programs_are_named(spark, tools, tmp_path):
    urls, films = spark.createDataFrame([("u",)], "url string"), spark.createDataFrame([("a", "x")], "video_id string, path string")
    for made in (programs.Programs(str(tmp_path), fetcher="no-such-program").fetch(urls), programs.Programs(str(tmp_path), decoder="no-such-program").scores(films)):
        with pytest.raises(Exception, match="no-such-program is not installed"):
            made.collect()
    with pytest.raises(Exception, match="false failed with 1"):
        programs.Programs(str(tmp_path), decoder="false").scores(films).collect()
    if not programs.speech_available():
        with pytest.raises(Exception, match="faster-whisper is not installed"):
            programs.Programs(str(tmp_path), decoder=tools.decoder).transcribed(films).collect()


def test_fetch_command(spark, tools, monkeypatch):
    monkeypatch.setattr(programs.Programs, "__init__", lambda self, folder: self.__dict__.update(tools.__dict__, folder=folder))
    a = parser().parse_args(["fetch", f"{tools.folder}/landing", "http://x/a", "http://x/c"])
    assert sorted(r["video_id"] for r in fetch(spark, a).collect()) == ["a", "c"] and sorted(os.listdir(f"{a.landing}/videos")) == ["a.mp4", "c.mp4"]
