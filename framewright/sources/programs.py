"""Outside programs behind the adapters: every task calls them for its own rows, on files that all machines reach.

A program is looked for where it is to run.  If it isn't there, the task fails and names it; nothing is skipped in silence.
A file that is there already is not made again, and each is written under another name and renamed, so a task that is done
again after a lost executor leaves whole files.
"""

from __future__ import annotations

import contextlib
import functools
import glob
import json
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import frame_name
from .adapters import speech_available

#: Formats asked for with and without a program that joins sound and picture; subtitles; quality of pictures;
#: sound for speech.
FORMATS = ("bestvideo[height<=720][ext=mp4]+bestaudio[ext=m4a]/best[height<=720][ext=mp4]/best", "best[height<=720][ext=mp4]/best[ext=mp4]/best")
SUBTITLES = ("--write-subs", "--write-auto-subs", "--sub-lang", "en", "--sub-format", "vtt")
PICTURE = ("-frames:v", "1", "-q:v", "2")
SOUND = ("-vn", "-acodec", "pcm_s16le", "-ar", "16000", "-ac", "1")
SPEECH_MODEL = ("base", "int8")


def call(program: str, *args: str) -> str:
    """What the program prints."""
    if shutil.which(program) is None:
        raise FileNotFoundError(f"{program} is not installed on this machine")
    done = subprocess.run([program, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{program} failed with {done.returncode}: {done.stderr[-500:]}")
    return done.stdout


@contextlib.contextmanager
def whole(path: str) -> Iterator[str]:
    """A name to write to; it becomes ``path`` once all went well."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    stem, kind = os.path.splitext(path)
    part = f"{stem}.{os.getpid()}.part{kind}"
    try:
        yield part
        os.replace(part, path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)


def _by_row(rows: DataFrame, columns: list[str], make: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """The rows that ``make`` gives for each row's columns; one row is worked on at a time."""
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = make(*(r[c] for c in columns))
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in got], schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    return rows.select(*columns).mapInArrow(run, schema)


@functools.cache
def _speech_model(name: str, kind: str):
    from faster_whisper import WhisperModel

    return WhisperModel(name, compute_type=kind)


def heard(sound: str) -> list[tuple[float, float, str]]:
    """(start, end, text) of what is said in a sound file, by the speech package if it is installed."""
    if not speech_available():
        raise RuntimeError("faster-whisper is not installed on this machine")
    return [(s.start, s.end, s.text.strip()) for s in _speech_model(*SPEECH_MODEL).transcribe(sound, word_timestamps=True)[0] if s.text.strip()]


@dataclass
class Programs:
    """Fetches, decodes, reads and listens by programs; ``folder`` is a path that is the same on all machines."""

    folder: str
    fetcher: str = "yt-dlp"
    decoder: str = "ffmpeg"
    reader: str = "tesseract"
    listener: Callable[[str], list[tuple[float, float, str]]] = heard

    def fetch(self, urls: DataFrame) -> DataFrame:
        """``url, video_id, path`` of ``urls(url)``; lands ``info/<id>.json``, ``captions/<id>.*.vtt`` and ``videos/<id>.*``."""
        folder, fetcher, decoder = self.folder, self.fetcher, self.decoder

        def one(url: str) -> list[tuple]:
            with tempfile.TemporaryDirectory(dir=_made(folder)) as at:
                formats = FORMATS[0] if shutil.which(decoder) else FORMATS[1]
                call(fetcher, "--format", formats, "--write-info-json", *SUBTITLES, "--output", f"{at}/source.%(ext)s", "--no-playlist", url)
                if not os.path.exists(f"{at}/source.info.json"):
                    raise FileNotFoundError(f"{fetcher} has written no info of {url}")
                with open(f"{at}/source.info.json") as f:
                    video = json.load(f)["id"]
                found = sorted(x for x in glob.glob(f"{glob.escape(at)}/source.*") if x.endswith((".mp4", ".webm", ".mkv")))
                path = f"{folder}/videos/{video}{os.path.splitext(found[0])[1]}" if found else None
                captions = [(x, f"{folder}/captions/{video}{os.path.basename(x).removeprefix('source')}") for x in glob.glob(f"{glob.escape(at)}/*.vtt")]
                for a, b in [(f"{at}/source.info.json", f"{folder}/info/{video}.json"), *captions, *([(found[0], path)] if found else [])]:
                    os.makedirs(os.path.dirname(b), exist_ok=True)
                    os.replace(a, b)
            return [(url, video, path)]

        return _by_row(urls, ["url"], one, "url string, video_id string, path string")

    def frames(self, points: DataFrame, videos: DataFrame) -> DataFrame:
        """``points`` with ``path``, the picture taken from ``videos(video_id, path)`` at each one's time."""
        folder, decoder = self.folder, self.decoder

        def one(video: str, at: float, source: str, name: str) -> list[tuple]:
            path = f"{folder}/frames/{video}/{name}"
            if not os.path.exists(path):
                with whole(path) as part:
                    call(decoder, "-ss", str(at), "-i", source, *PICTURE, "-y", part)
            return [(video, at, path)]

        asked = points.select("video_id", "timestamp").distinct().join(videos.select("video_id", F.col("path").alias("source")), "video_id").withColumn("name", frame_name(F.col("timestamp")))
        # pictures of one video are taken by many tasks
        made = _by_row(asked.repartition("video_id", "timestamp"), ["video_id", "timestamp", "source", "name"], one, "video_id string, timestamp double, path string")
        return points.join(made, ["video_id", "timestamp"])

    def scores(self, videos: DataFrame) -> DataFrame:
        """``video_id, t, score`` of each decoded frame of ``videos(video_id, path)``: how much it differs, from 0 to 100."""
        decoder = self.decoder

        def one(video: str, source: str) -> list[tuple]:
            said = call(decoder, "-i", source, "-vf", "select='gte(scene,0)',metadata=print:file=-", "-an", "-f", "null", "-")
            found = re.findall(r"pts_time:([\d.]+)[^\n]*\n(?:[^\n]*\n)*?[^\n]*scene_score=([\d.]+)", said)
            return [(video, float(t), 100 * float(s)) for t, s in found]

        return _by_row(videos, ["video_id", "path"], one, "video_id string, t double, score double")

    def recognised(self, frames: DataFrame) -> DataFrame:
        """``video_id, frame_number, items`` of ``frames(video_id, frame_number, path)``: an item a word."""
        reader = self.reader

        def one(video: str, number: int, path: str) -> list[tuple]:
            head, *lines = [x.split("\t") for x in call(reader, path, "stdout", "tsv").splitlines()] or [[]]
            words = [dict(zip(head, x)) for x in lines]
            return [(video, number, [{"box": f"{w['left']},{w['top']},{w['width']},{w['height']}", "text": w["text"], "score": float(w["conf"]) / 100} for w in words if w.get("text", "").strip()])]

        kind = dict(frames.dtypes)["frame_number"]
        return _by_row(frames, ["video_id", "frame_number", "path"], one, f"video_id string, frame_number {kind}, items array<struct<box:string,text:string,score:double>>")

    def transcribed(self, videos: DataFrame) -> DataFrame:
        """``video_id, start, end, text`` of what is said in ``videos(video_id, path)``."""
        decoder, listener = self.decoder, self.listener

        def one(video: str, source: str) -> list[tuple]:
            with tempfile.TemporaryDirectory() as at:  # read by this task alone
                call(decoder, "-i", source, *SOUND, f"{at}/sound.wav", "-y")
                return [(video, *x) for x in listener(f"{at}/sound.wav")]

        return _by_row(videos, ["video_id", "path"], one, "video_id string, start double, end double, text string")


def _made(folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return folder
