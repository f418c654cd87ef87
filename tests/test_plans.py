"""Plans, stage marks, streaming, and every query against its SQL."""

import datetime
import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import framewright.queries as q
from framewright.operators import cues
from framewright.plans import timeline
from framewright.plans.stages import STAGES, Marks, fingerprint
from framewright.profiles import build_profiles, profile_rows
from framewright.streaming.cues import stream_cues

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    return sorted(tuple("null" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_against_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want) and len(got)


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_marks(spark, tmp_path):
    m = Marks(spark, str(tmp_path))
    for s in STAGES:
        m.mark(s, "k")
    m.clear("ocr")
    assert [m.done(s) for s in STAGES] == [True, True, False, False, False, False]
    assert m.done("fetch", "k") and not m.done("fetch", "other")
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for key in ("a", "a", "b"):
        assert m.run("align", fingerprint(x=key), f"{tmp_path}/t", make).count() == 3
    assert len(calls) == 2
    m.clear()
    assert not any(map(m.done, STAGES))
    with pytest.raises(ValueError):
        m.done("none")


def test_thorough_keeps_and_counts(spark):
    rows = [("v", 0, i, float(i), f"p{i}", "", m, l, e, h) for i, (m, l, e, h) in enumerate([(50.0, 500.0, 0.0, 0), (50.0, 500.0, 0.0, 1), (5.0, 500.0, 0.0, 255), (50.0, 5.0, 0.0, 255), (50.0, 500.0, 0.0, 255), (None, None, 0.0, None)])]
    df = spark.createDataFrame(rows, "video_id string, chapter_number int, frame_number int, timestamp double, path string, ocr_text string, mean_luma double, lap_var double, edge_density double, phash bigint").withColumn("density", F.lit("normal"))
    got = timeline.keep_frames(df, profile_rows(spark, build_profiles("normal", 5.0))).orderBy("frame_number").collect()
    assert [r["is_kept"] for r in got] == [True, False, False, False, True, False]
    assert [r["good"] for r in got] == [True, True, False, False, True, False]


def test_chapters_or_synthetic(spark):
    v = spark.createDataFrame([("a", 1200.0), ("b", 1200.0)], "video_id string, duration double")
    own = spark.createDataFrame([("a", 0, "x", 0.0, 1200.0, False)], "video_id string, chapter_number int, title string, start_time double, end_time double, is_synthetic boolean")
    assert sorted((r["video_id"], r["title"], r["density"]) for r in timeline.prepared_chapters(v, own, dense=[1]).collect()) == [("a", "x", "normal"), ("b", "Part 1", "normal"), ("b", "Part 2", "high")]


def test_stream_equals_batch(spark, tmp_path):
    """Segments in files, one a batch, with groups that span batches; a last far one closes all."""
    base = datetime.datetime(2024, 1, 1)
    rows = [(v, float(t), "as you can see" if t % 3 else "the data") for t in range(0, 120, 4) for v in ("a", "b")]
    kind = "video_id string, start double, text string, event_time timestamp"
    for i in range(0, len(rows), 10):
        spark.createDataFrame([(*r, base + datetime.timedelta(seconds=r[1])) for r in rows[i : i + 10]], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(v, 9000.0, "this slide", base + datetime.timedelta(seconds=9000)) for v in ("a", "b")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_cues(stream).writeStream.format("memory").queryName("cues").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    got = sorted((r["video_id"], r["timestamp"], r["tier"]) for r in spark.table("cues").collect())
    seg = spark.createDataFrame([(r[0], i, r[1], r[2]) for i, r in enumerate(rows)], "video_id string, seg_idx int, start double, text string")
    want = sorted((r["video_id"], r["timestamp"], r["tier"]) for r in cues.deduplicate_cues(cues.find_cues(seg)).collect())
    assert [x for x in got if x[1] < 9000] == want


def test_image_hash_of_equal_frequencies(spark, tmp_path):
    """Mirrored, striped and flat pictures, half of whose frequencies are equal in theory: the last digits are SQL's too."""
    rng = random.Random(21)
    rows = []
    for i in range(240):
        m = [[rng.randrange(-120, 120) / 100 for _ in range(8)] for _ in range(8)]
        if i % 4 == 0:
            m = [r[:4] + r[3::-1] for r in m]
        elif i % 4 == 1:
            m = m[:4] + m[3::-1]
        elif i % 4 == 2:
            m = [m[0]] * 8
        elif i % 8 == 3:
            m = [[m[0][0]] * 8] * 8
        rows.append((i, [x for r in m for x in r]))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "p2_p3_image_measures"
    assert plain(q.QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.sql(q.ORACLE[name]).df())
