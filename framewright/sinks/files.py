"""Documents to files, each executor its own; nothing goes through the driver."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stripped, vtt_time


def write_documents(docs: DataFrame, to: str, mode: str = "overwrite") -> None:
    """``docs(video_id, path, content)`` as Parquet by video, rewriting only the videos at hand."""
    docs.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(to)


def write_files(docs: DataFrame, to: str, stale: str | None = None) -> int:
    """Each document as ``to/video_id/path`` through Arrow's file systems, from the executors; the number written.

    Writes under a name of its own attempt and renames, so a task that runs twice leaves whole files only.  A video's
    documents are written by one task, which then deletes those files of the video whose names match the pattern ``stale``
    and that are none of them: what an earlier run has left.  The tasks count, so the plan runs once.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(to)
        attempt = TaskContext.get().taskAttemptId()
        video, written, n = None, set(), 0

        def close() -> None:
            if video is not None and stale:
                for f in store.get_file_info(fs.FileSelector(f"{root}/{video}")):
                    if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, stale) and f.base_name not in written:
                        store.delete_file(f.path)

        for batch in batches:
            for r in batch.to_pylist():
                folder = f"{root}/{r['video_id']}"
                if r["video_id"] != video:
                    close()
                    video, written = r["video_id"], set()
                    store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/.{r['path']}.{attempt}") as f:
                    f.write(r["content"].encode())
                store.move(f"{folder}/.{r['path']}.{attempt}", f"{folder}/{r['path']}")
                written.add(r["path"])
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = docs.select(F.col("video_id").cast("string").alias("video_id"), "path", "content")
    return rows.repartition("video_id").sortWithinPartitions("video_id").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def vtt_documents(segments: DataFrame) -> DataFrame:
    """``video_id, path, content``: a caption file for each video of ``segments(video_id, start, end, text)``."""
    said = segments.filter(F.length(stripped(F.coalesce("text", F.lit("")))) > 0)
    cue = F.concat(vtt_time(F.col("start")), F.lit(" --> "), vtt_time(F.col("end")), F.lit("\n"), stripped(F.col("text")), F.lit("\n"))
    lists = said.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", cue.alias("t")))).alias("c"))
    return lists.select("video_id", F.lit("whisper.vtt").alias("path"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.col("c.t"), "\n")).alias("content"))
