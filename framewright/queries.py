"""Queries of the timeline operators over the driver's tables, each with the SQL that gives the same rows.

The tables have no videos, so ``events`` stand in: a user is a video, the hours since 2024 are its seconds, and the event
type says which sentence is spoken; ``embeddings`` give frames' hashes by their components' signs.  See :func:`segments`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .functions.images import is_slide_like
from .operators import align, chapters, cues, dedup, frames, render, sampling
from .plans import timeline
from .profiles import Profile, build_profiles, profile_rows
from .sinks.files import vtt_documents
from .sources import adapters, captions, videos

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- the stand-ins, in Spark and in SQL

SAID = {
    "view": "As you can see in this chart, the data grows",
    "click": "Let me pull up the file manager",
    "purchase": "First open the database",
    "signup": "These RESULTS are good, step one",
    "error": "Nothing of note here",
}
DURATION, LENGTH = 720.0, 100.0


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    return e.select("event_id", F.col("user_id").alias("video_id"), "event_type", "value", "props", hours.alias("t"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    said = F.lit(None).cast("string")
    for kind, text in SAID.items():
        said = F.when(F.col("event_type") == kind, text).otherwise(said)
    return events(spark, sf).select("video_id", F.col("event_id").alias("seg_idx"), F.col("t").alias("start"), said.alias("text"))


def all_videos(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("video_id").distinct().withColumn("duration", F.lit(DURATION))


def all_chapters(spark: SparkSession, sf: str) -> DataFrame:
    made = chapters.synthetic_chapters(all_videos(spark, sf), LENGTH)
    d = F.col("video_id") % 3
    return made.withColumn("density", F.when(d == 0, "high").when(d == 1, "normal").otherwise("low"))


def all_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as frames of the chapter they fall in; odd ones are kept."""
    e = events(spark, sf).filter("event_type = 'click'").select("video_id", F.col("event_id").alias("frame_number"), F.col("t").alias("timestamp"), "value")
    at = chapters.assign_chapter(e, all_chapters(spark, sf))
    return at.select("video_id", "chapter_number", "frame_number", "timestamp", F.concat_ws("/", F.col("video_id").cast("string"), F.concat(F.lit("f"), F.col("frame_number").cast("string"))).alias("path"), F.when(F.col("value") > 50, F.concat(F.lit("v"), F.floor("value").cast("string"))).alias("ocr_text"), (F.col("frame_number") % 2 == 1).alias("is_kept"), "density")


def all_captions(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter("event_type = 'view'").select("video_id", F.col("event_id").alias("caption_idx"), F.col("t").alias("start"), (F.col("t") + F.col("value") / 100).alias("end"), F.col("event_id").cast("string").alias("text"))


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(0), F.size("embedding") - 1), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return table(spark, sf, "embeddings").select(F.lit(0).alias("video_id"), F.col("label").alias("chapter_number"), F.col("vec_id").alias("frame_number"), F.col("vec_id").cast("double").alias("timestamp"), bits.alias("phash"), (F.col("vec_id") % 5 == 0).alias("is_slide"), F.lit("normal").alias("density"))


def _str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EV = "ev AS (SELECT event_id, user_id AS video_id, event_type, value, props, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / CAST(3.6e9 AS DOUBLE) AS t FROM events)"
SEG = EV + ", seg AS (SELECT video_id, event_id AS seg_idx, t AS start, CASE event_type " + " ".join(f"WHEN '{k}' THEN {_str(v)}" for k, v in SAID.items()) + " END AS text FROM ev)"
_TIER = {n: _str(r"(?i)\b(?:" + "|".join(p) + ")") for n, p in cues.TIERS.items()}


def _cues_sql(tiers: tuple[int, ...]) -> str:
    hit = {n: f"nullif(regexp_extract(text, {_TIER[n]}), '')" for n in tiers}
    return f"cue AS (SELECT video_id, seg_idx, start AS timestamp, CASE {' '.join(f'WHEN {h} IS NOT NULL THEN {n}' for n, h in hit.items())} END AS tier, lower(coalesce({', '.join(hit.values())})) AS phrase, trim(text) AS context FROM seg)"


CUE = f"{SEG}, {_cues_sql((1, 2, 3))}, c AS (SELECT * FROM cue WHERE tier IS NOT NULL)"
#: The jump form of the anchored window: each anchor leads to the first cue beyond its reach.
DED = f"""{CUE}, RECURSIVE_anchor AS (SELECT 1), a(video_id, opened) AS (
  SELECT video_id, min(timestamp) FROM c GROUP BY video_id
  UNION ALL
  SELECT a.video_id, (SELECT min(c.timestamp) FROM c WHERE c.video_id = a.video_id AND c.timestamp - a.opened > 15.0) FROM a
  WHERE EXISTS (SELECT 1 FROM c WHERE c.video_id = a.video_id AND c.timestamp - a.opened > 15.0)),
 g AS (SELECT c.*, (SELECT max(opened) FROM a WHERE a.video_id = c.video_id AND a.opened <= c.timestamp) AS opened FROM c),
 d AS (SELECT * EXCLUDE (rn, opened) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, opened ORDER BY tier, timestamp, seg_idx) AS rn FROM g) WHERE rn = 1)""".replace(", RECURSIVE_anchor AS (SELECT 1)", "")
VID = "vid AS (SELECT DISTINCT user_id AS video_id, CAST(720 AS DOUBLE) AS duration FROM events)"
CH = f"""{VID}, n7 AS (SELECT unnest(range(7)) AS n), ch AS (SELECT video_id, CAST(n AS INT) AS chapter_number, 'Part ' || (n + 1) AS title, n * (duration / 7) AS start_time,
 CASE WHEN n = 6 THEN duration ELSE (n + 1) * (duration / 7) END AS end_time, true AS is_synthetic, CASE video_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS density FROM vid, n7)"""
_AT = "coalesce((SELECT min(chapter_number) FROM ch WHERE ch.video_id = x.video_id AND ch.start_time <= x.{t} AND x.{t} < ch.end_time), 6)"
FR = f"""{EV}, {CH}, fr AS (SELECT x.video_id, {_AT.format(t="t")} AS chapter_number, event_id AS frame_number, t AS timestamp, x.video_id || '/f' || event_id AS path,
 CASE WHEN value > 50 THEN 'v' || CAST(floor(value) AS BIGINT) END AS ocr_text, event_id % 2 = 1 AS is_kept, CASE x.video_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS density FROM ev x WHERE event_type = 'click')"""
CAP = "cap AS (SELECT video_id, event_id AS caption_idx, t AS start, t + value / 100 AS \"end\", CAST(event_id AS VARCHAR) AS text FROM ev WHERE event_type = 'view')"
OVER = "cap.video_id = fr.video_id AND cap.start <= fr.timestamp + 3.0 AND cap.\"end\" >= fr.timestamp - 3.0"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


# ---------------------------------------------------------------- cues and sampling


@query(with_(CUE) + "SELECT video_id, seg_idx, timestamp, tier, phrase, context FROM c")
def f1_find_cues(spark, sf):
    return cues.find_cues(segments(spark, sf))


@query(with_(SEG, _cues_sql((2, 3))) + "SELECT video_id, seg_idx, timestamp, tier, phrase, context FROM cue WHERE tier IS NOT NULL")
def p7_tier_filter(spark, sf):
    """Where tier 1 isn't asked for, its sentences may match a lower tier."""
    return cues.find_cues(segments(spark, sf), (2, 3))


@query(with_(DED) + "SELECT video_id, seg_idx, timestamp, tier, phrase, context FROM d")
def f2_dedup_cues(spark, sf):
    return cues.deduplicate_cues(cues.find_cues(segments(spark, sf)))


@query(with_(DED) + "SELECT video_id, timestamp FROM d")
def f2a_cue_timestamps(spark, sf):
    return cues.cue_timestamps(segments(spark, sf))


@query(with_(CUE) + "SELECT video_id, min(tier) AS tier, arg_min(timestamp, (tier, timestamp, seg_idx)) AS timestamp, arg_min(seg_idx, (tier, timestamp, seg_idx)) AS seg_idx FROM c GROUP BY video_id")
def a2_best_in_group(spark, sf):
    return frames.best_first(cues.find_cues(segments(spark, sf)), "video_id")


def _fill_sql(budget: int, per: int) -> str:
    return f"""used AS (SELECT video_id, count(*) AS n FROM d GROUP BY video_id),
 have AS (SELECT ch.*, (SELECT count(*) FROM d WHERE d.video_id = ch.video_id AND ch.start_time <= d.timestamp AND d.timestamp < ch.end_time) AS have, {budget} - coalesce(used.n, 0) AS budget FROM ch LEFT JOIN used USING (video_id)),
 cand AS (SELECT *, greatest(1, budget // count(*) OVER (PARTITION BY video_id)) AS share FROM have WHERE have < {per} AND budget > 0),
 w AS (SELECT *, least({per} - have, share) AS need FROM cand WHERE end_time > start_time),
 s AS (SELECT *, unnest(range(1, need + 1)) AS j FROM w),
 s2 AS (SELECT *, round(start_time + j * ((end_time - start_time) / (need + 1)), 3) AS timestamp FROM s),
 s3 AS (SELECT *, round(timestamp, 1) AS slot FROM s2 WHERE timestamp < end_time),
 s4 AS (SELECT * FROM s3 WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.video_id = s3.video_id AND round(d.timestamp, 1) = s3.slot)),
 s5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, slot ORDER BY chapter_number, j) AS r FROM s4) WHERE r = 1),
 s6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chapter_number, j) AS r2 FROM s5) WHERE r2 <= budget),
 filled AS (SELECT video_id, timestamp, 'cue' AS origin FROM d UNION ALL SELECT video_id, timestamp, 'fill' FROM s6)"""


FILL = f"{DED}, {CH}, {_fill_sql(40, 5)}"
LIGHT = f"""{FILL}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, round(timestamp, 3) ORDER BY timestamp, origin) AS r FROM filled) WHERE r = 1),
 pts AS (SELECT x.video_id, {_AT.format(t="timestamp")} AS chapter_number, CASE x.video_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS density, CAST(row_number() OVER (PARTITION BY x.video_id ORDER BY timestamp) - 1 AS INT) AS frame_number, timestamp, origin FROM once x)"""


@query(with_(FILL) + "SELECT video_id, timestamp, origin FROM filled")
def f4_fill(spark, sf):
    return sampling.fill(all_chapters(spark, sf), cues.cue_timestamps(segments(spark, sf)), 40, 5)


@query(with_(f"{DED}, {CH}, {_fill_sql(30, 5)}") + "SELECT video_id, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, origin) AS r FROM filled) WHERE r <= 30")
def o3_limit_per_video(spark, sf):
    return frames.earliest(sampling.fill(all_chapters(spark, sf), cues.cue_timestamps(segments(spark, sf)), 30, 5), 30).select("video_id", "timestamp")


@query(with_(FILL) + "SELECT video_id, count(*) AS total, count(*) FILTER (origin = 'cue') AS from_cues, count(*) FILTER (origin = 'fill') AS from_fill FROM filled GROUP BY video_id")
def a8_cue_fill_breakdown(spark, sf):
    return f4_fill(spark, sf).groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(F.col("origin") == "cue").alias("from_cues"), F.count_if(F.col("origin") == "fill").alias("from_fill"))


@query(with_(FILL) + "SELECT video_id, slot, min(timestamp) AS timestamp FROM (SELECT video_id, timestamp, round(timestamp, 1) AS slot FROM filled) GROUP BY video_id, slot")
def e2_first_of_slot(spark, sf):
    return f4_fill(spark, sf).groupBy("video_id", scalars.slot(F.col("timestamp")).alias("slot")).agg(F.min("timestamp").alias("timestamp"))


@query(with_(f"{DED}, {CH}, {_fill_sql(40, 5)}") + "SELECT video_id, chapter_number, j, timestamp FROM s4")
def j8_free_slots(spark, sf):
    """Candidates whose tenth of a second no cue has: an anti join."""
    ch = chapters.coverage(all_chapters(spark, sf), cues.cue_timestamps(segments(spark, sf)))
    return _candidates(ch, cues.cue_timestamps(segments(spark, sf)), 40, 5)


def _candidates(covered: DataFrame, taken: DataFrame, budget: int, per: int) -> DataFrame:
    from pyspark.sql import Window

    used = taken.groupBy("video_id").agg(F.count("*").alias("u"))
    c = covered.join(used, "video_id", "left").withColumn("b", budget - F.coalesce("u", F.lit(0))).filter((F.col("have") < per) & (F.col("b") > 0))
    c = c.withColumn("n", F.least(per - F.col("have"), F.greatest(F.lit(1), F.floor(F.col("b") / F.count("*").over(Window.partitionBy("video_id"))))))
    c = c.withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))))
    c = c.withColumn("timestamp", F.round(F.col("start_time") + F.col("j") * ((F.col("end_time") - F.col("start_time")) / (F.col("n") + 1)), 3)).filter("timestamp < end_time")
    c = c.withColumn("slot", scalars.slot(F.col("timestamp")))
    return c.join(taken.select("video_id", scalars.slot(F.col("timestamp")).alias("slot")), ["video_id", "slot"], "left_anti").select("video_id", "chapter_number", "j", "timestamp")


@query(with_(LIGHT) + "SELECT video_id, chapter_number, density, frame_number, timestamp, origin FROM pts")
def light_plan(spark, sf):
    return timeline.light_plan(segments(spark, sf), all_chapters(spark, sf), budget=40, per_chapter=5)


@query(with_(LIGHT) + "SELECT video_id, timestamp, chapter_number, density, 0 AS scene_id FROM pts")
def f5_light_points(spark, sf):
    return sampling.light_points(f4_fill(spark, sf), all_chapters(spark, sf)).select("video_id", "timestamp", "chapter_number", "density", "scene_id")


@query(with_(f"{LIGHT}, fr AS (SELECT * FROM pts), {CAP}") + f"SELECT fr.video_id, fr.chapter_number, fr.frame_number, fr.timestamp, fr.origin, coalesce((SELECT string_agg(text, ' ' ORDER BY caption_idx) FROM cap WHERE {OVER}), '_none_') AS caption_text FROM fr")
def light_plan_with_captions(spark, sf):
    """The flagship: which moments of every video to look at, and what is said there."""
    plan = light_plan(spark, sf)
    return timeline.aligned(plan, all_captions(spark, sf)).select("video_id", "chapter_number", "frame_number", "timestamp", "origin", "caption_text")


def _scenes(spark, sf) -> DataFrame:
    """Errors cut a video into scenes."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("start", "event_id")
    e = events(spark, sf).filter("event_type = 'error'").select("video_id", "event_id", F.round("t", 1).alias("start"))
    return e.withColumn("end", F.coalesce(F.lead("start").over(w), F.lit(DURATION))).withColumn("scene_id", F.row_number().over(w) - 1).select("video_id", "scene_id", "start", "end")


_SCENES = f"""{EV}, {CH}, e0 AS (SELECT video_id, event_id, round(t, 1) AS start FROM ev WHERE event_type = 'error'),
 sc AS (SELECT video_id, CAST(row_number() OVER w - 1 AS INT) AS scene_id, start, coalesce(lead(start) OVER w, 720.0) AS "end" FROM e0 WINDOW w AS (PARTITION BY video_id ORDER BY start, event_id)),
 st(video_id, scene_id, i, timestamp, "end", every) AS (
  SELECT video_id, scene_id, 0, start, "end", CAST(CASE video_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 15 END AS DOUBLE) FROM sc
  UNION ALL SELECT video_id, scene_id, i + 1, timestamp + every, "end", every FROM st WHERE timestamp + every < "end"),
 bare AS (SELECT video_id, CAST(n AS INT) AS scene_id, 0 AS i, n * 30.0 AS timestamp FROM vid, (SELECT unnest(range(24)) AS n) WHERE video_id NOT IN (SELECT video_id FROM sc)),
 every AS (SELECT video_id, scene_id, i, timestamp FROM st UNION ALL SELECT * FROM bare),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, round(timestamp, 3) ORDER BY scene_id, i) AS r FROM every) WHERE r = 1)"""


@query(with_(_SCENES) + f"SELECT x.video_id, round(timestamp, 3) AS timestamp, {_AT.format(t='timestamp')} AS chapter_number, CASE x.video_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS density, scene_id FROM one x")
def f6_scene_points(spark, sf):
    pts = sampling.scene_points(_scenes(spark, sf), all_chapters(spark, sf), profile_rows(spark, build_profiles("normal", 5.0)))
    return pts.withColumn("timestamp", F.round("timestamp", 3))


@query(with_(_SCENES) + f"SELECT x.video_id, {_AT.format(t='timestamp')} AS chapter_number, CASE x.video_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS density, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp, scene_id) - 1 AS INT) AS frame_number, round(timestamp, 3) AS timestamp, scene_id FROM one x")
def thorough_plan(spark, sf):
    plan = timeline.thorough_plan(_scenes(spark, sf), all_chapters(spark, sf), profile_rows(spark, build_profiles("normal", 5.0)))
    return plan.select("video_id", "chapter_number", "density", "frame_number", F.round("timestamp", 3).alias("timestamp"), "scene_id")


@query(with_(EV) + """, e AS (SELECT user_id AS video_id, event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / CAST(3.6e9 AS DOUBLE) AS t, value FROM events),
 b AS (SELECT video_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY video_id),
 k(video_id, t) AS (SELECT e.video_id, min(e.t) FROM e JOIN b USING (video_id) WHERE e.value >= 90 AND e.t - b.lo >= 0.6 GROUP BY e.video_id
  UNION ALL SELECT k.video_id, (SELECT min(e.t) FROM e WHERE e.video_id = k.video_id AND e.value >= 90 AND e.t - k.t >= 0.6) FROM k WHERE EXISTS (SELECT 1 FROM e WHERE e.video_id = k.video_id AND e.value >= 90 AND e.t - k.t >= 0.6)),
 edge AS (SELECT video_id, t FROM k UNION ALL SELECT video_id, lo FROM b WHERE video_id IN (SELECT video_id FROM k)),
 sc AS (SELECT video_id, t AS start, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), (SELECT hi FROM b WHERE b.video_id = edge.video_id)) AS "end", CAST(row_number() OVER (PARTITION BY video_id ORDER BY t) - 1 AS INT) AS scene_id FROM edge)
 SELECT video_id, scene_id, start, "end" FROM sc""")
def f8_scenes_from_scores(spark, sf):
    return adapters.scenes_from_scores(events(spark, sf).select("video_id", "t", F.col("value").alias("score")), sensitivity=90.0)


# ---------------------------------------------------------------- chapters


@query(with_(CH) + "SELECT video_id, chapter_number, title, start_time, end_time, is_synthetic FROM ch")
def f7_synthetic_chapters(spark, sf):
    return chapters.synthetic_chapters(all_videos(spark, sf), LENGTH)


@query("""WITH v AS (SELECT p_partkey AS video_id, CAST(p_size * 45 - 90 AS DOUBLE) AS duration FROM part), n AS (SELECT *, greatest(1, CAST(floor(duration / 600.0) AS INT)) AS n FROM v)
 SELECT video_id, CAST(i AS INT) AS chapter_number, 'Part ' || (i + 1) AS title, i * (duration / n) AS start_time, CASE WHEN i = n - 1 THEN duration ELSE (i + 1) * (duration / n) END AS end_time, true AS is_synthetic FROM (SELECT *, unnest(range(n)) AS i FROM n WHERE duration > 0)
 UNION ALL SELECT video_id, 0, 'Full Video', 0.0::DOUBLE, 0.0::DOUBLE, true FROM v WHERE duration <= 0""")
def f7_synthetic_by_duration(spark, sf):
    return chapters.synthetic_chapters(table(spark, sf, "part").select(F.col("p_partkey").alias("video_id"), (F.col("p_size") * 45 - 90).cast("double").alias("duration")))


@query(with_(CH) + "SELECT video_id, chapter_number, CASE WHEN chapter_number IN (5, 6) OR start_time < 150.0 THEN 'high' ELSE 'low' END AS density FROM ch")
def p13_chapter_densities(spark, sf):
    return chapters.with_density(all_chapters(spark, sf), "low", (5, 6), 150.0).select("video_id", "chapter_number", "density")


@query("SELECT * FROM (VALUES ('high', 6.0::DOUBLE, 3, 1), ('normal', 5.0::DOUBLE, 5, 3), ('low', 15.0::DOUBLE, 8, 6)) t(name, scene_sample_interval, dedup_hamming_threshold, slide_dedup_hamming_threshold)")
def p14_density_profiles(spark, sf):
    return profile_rows(spark, build_profiles(" HIGH ", 6.0))


@query(with_(EV, CH) + f"SELECT event_id, x.video_id, {_AT.format(t='t')} AS chapter_number FROM ev x")
def j1_chapter_of_time(spark, sf):
    return chapters.assign_chapter(events(spark, sf), all_chapters(spark, sf), "t").select("event_id", "video_id", "chapter_number")


@query(with_(EV) + "SELECT event_id, CASE WHEN t >= 200 AND t < 300 THEN 1 ELSE 2 END AS chapter_number FROM ev")
def j1_last_chapter_fallback(spark, sf):
    """Before the first chapter and in gaps, the last one."""
    ch = all_videos(spark, sf).select("video_id", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(a + 100).alias("b")) for n, a in ((1, 200.0), (2, 400.0))))).alias("c")).select("video_id", F.col("c.n").alias("chapter_number"), F.col("c.a").alias("start_time"), F.col("c.b").alias("end_time"), F.lit("normal").alias("density"))
    return chapters.assign_chapter(events(spark, sf), ch, "t").select("event_id", "chapter_number")


@query(with_(EV, CH) + "SELECT video_id, chapter_number, (SELECT count(*) FROM ev WHERE ev.video_id = ch.video_id AND event_type = 'error' AND ch.start_time <= t AND t < ch.end_time) AS have FROM ch")
def j3_chapter_coverage(spark, sf):
    return chapters.coverage(all_chapters(spark, sf), events(spark, sf).filter("event_type = 'error'"), "t").select("video_id", "chapter_number", "have")


@query(with_(FR) + "SELECT frame_number, fr.density, scene_sample_interval FROM fr JOIN (VALUES ('high', 3.0::DOUBLE), ('normal', 7.0::DOUBLE), ('low', 15.0::DOUBLE)) p(name, scene_sample_interval) ON name = density")
def j6_profile_of_frame(spark, sf):
    p = profile_rows(spark, build_profiles("normal", 7.0)).withColumnRenamed("name", "density")
    return all_frames(spark, sf).join(F.broadcast(p), "density").select("frame_number", "density", "scene_sample_interval")


@query(with_(FR) + "SELECT fr.video_id, frame_number, ch.title FROM fr LEFT JOIN ch ON ch.video_id = fr.video_id AND ch.chapter_number = fr.chapter_number")
def j4_chapter_of_frame(spark, sf):
    ch = all_chapters(spark, sf).select("video_id", "chapter_number", "title")
    return all_frames(spark, sf).join(ch, ["video_id", "chapter_number"], "left").select("video_id", "frame_number", "title")


# ---------------------------------------------------------------- captions


@query(with_(FR, CAP) + f"SELECT fr.video_id, frame_number, coalesce((SELECT string_agg(text, ' ' ORDER BY caption_idx) FROM cap WHERE {OVER}), '_none_') AS caption_text FROM fr")
def j2_align_captions(spark, sf):
    return align.align_captions(all_frames(spark, sf), all_captions(spark, sf)).select("video_id", "frame_number", "caption_text")


@query(with_(FR, CAP) + f"SELECT fr.video_id, frame_number, caption_idx FROM fr JOIN cap ON {OVER}")
def p11_interval_overlap(spark, sf):
    return align.overlaps(all_frames(spark, sf).select("video_id", "frame_number", "timestamp"), all_captions(spark, sf)).select("video_id", "frame_number", "caption_idx")


@query("SELECT event_id AS video_id, CAST(i AS INT) AS caption_idx, CAST(i * 60 + event_id % 60 AS DOUBLE) AS start, CAST(i * 60 + event_id % 60 AS DOUBLE) + 1.5 AS \"end\", event_type || chr(10) || i AS text FROM events, (SELECT unnest(range(2)) AS i)")
def s4_parse_captions(spark, sf):
    stamp = lambda i, ms: F.format_string(f"00:%02d:%02d.{ms:03d}", F.lit(i), F.col("event_id") % 60)
    end = lambda i: scalars.vtt_time(i * 60 + F.col("event_id") % 60 + F.lit(1.5))
    cue = lambda i: F.concat(stamp(i, 0), F.lit(" --> "), end(i), F.lit(" align:start\n"), F.lit("<c>"), F.col("event_type"), F.lit(f"</c>\n{i}\n\n"))
    vtt = F.concat(F.lit("WEBVTT\n\nNOTE a note\n\n1\n"), cue(0), F.lit("00:00:59.000 --> 00:01:00.000\n \n\n"), cue(1))
    return captions.parse_captions(table(spark, sf, "events").select(F.col("event_id").alias("video_id"), vtt.alias("value"), "event_type"))


@query("SELECT p_partkey, printf('%02d:%02d:%02d.%03d', p_partkey // 3600, (p_partkey // 60) % 60, p_partkey % 60, p_size) AS vtt FROM part")
def x4_vtt_time(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.vtt_time(F.col("p_partkey") + F.col("p_size") / 1000).alias("vtt"))


@query(with_(EV) + "SELECT video_id, 'whisper.vtt' AS path, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.000 --> %02d:%02d:%02d.500', s // 3600, (s // 60) % 60, s % 60, s // 3600, (s // 60) % 60, s % 60) || chr(10) || event_type || chr(10), chr(10) ORDER BY s, event_type) AS content FROM (SELECT video_id, event_type, event_id AS s FROM ev) GROUP BY video_id")
def k13_vtt_documents(spark, sf):
    return vtt_documents(events(spark, sf).select("video_id", F.col("event_id").cast("double").alias("start"), (F.col("event_id") + 0.5).alias("end"), F.concat(F.lit(" "), F.col("event_type")).alias("text")))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'whisper' ELSE 'youtube' END AS source FROM pages")
def x7_caption_source(spark, sf):
    n = F.col("page_id") % 3
    path = F.when(n == 1, F.concat(F.lit("whisper-dir/a/"), F.col("page_id").cast("string"), F.lit("whisper.vtt"))).when(n == 2, "whisper/source.en.vtt")
    return table(spark, sf, "pages").select("page_id", scalars.caption_source(path).alias("source"))


# ---------------------------------------------------------------- keeping and removing frames

_BITS = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << (i % 32)} ELSE 0 END)::BIGINT" for i in range(32))
_BITS_HI = " + ".join(f"(CASE WHEN embedding[{i + 33}] > 0 THEN {1 << i} ELSE 0 END)::BIGINT" for i in range(32))
HASH = f"h AS (SELECT label, vec_id, {_BITS} AS lo, {_BITS_HI} AS hi, vec_id % 5 = 0 AS s FROM embeddings)"


@query(with_(HASH, """o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM h),
 f(label, rn, kept) AS (SELECT label, rn, [{'i': vec_id, 'lo': lo, 'hi': hi, 's': s}] FROM o WHERE rn = 1
  UNION ALL SELECT o.label, o.rn, CASE WHEN len(list_filter(f.kept, lambda k: bit_count(xor(k.lo, o.lo)) + bit_count(xor(k.hi, o.hi)) < CASE WHEN k.s OR o.s THEN 20 ELSE 24 END)) > 0 THEN f.kept ELSE list_append(f.kept, {'i': o.vec_id, 'lo': o.lo, 'hi': o.hi, 's': o.s}) END FROM f JOIN o ON o.label = f.label AND o.rn = f.rn + 1),
 last AS (SELECT label, unnest(list_transform(arg_max(kept, rn), lambda k: k.i)) AS vec_id FROM f GROUP BY label)""") + "SELECT label AS chapter_number, vec_id AS frame_number, vec_id IN (SELECT vec_id FROM last) AS is_kept FROM h")
def f3_dedup_frames(spark, sf):
    p = profile_rows(spark, {"normal": Profile("normal", 5.0, 24, 20)})
    return dedup.deduplicate_frames(hashed(spark, sf), p).select("chapter_number", "frame_number", "is_kept")


@query(with_(HASH) + "SELECT b.label, a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS INT) AS bits FROM h b JOIN h a ON a.label = b.label AND a.vec_id = (SELECT min(vec_id) FROM h WHERE h.label = b.label)")
def x14_hamming(spark, sf):
    """Each hash against the first one of its label."""
    h = hashed(spark, sf).select(F.col("chapter_number").alias("label"), F.col("frame_number").alias("b"), F.col("phash").alias("y"))
    first = h.groupBy("label").agg(F.min(F.struct("b", "y")).alias("f")).select("label", F.col("f.b").alias("a"), F.col("f.y").alias("x"))
    return h.join(first, "label").select("label", "a", "b", scalars.hamming(F.col("x"), F.col("y")).alias("bits"))


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 80 OR n_chars % 100 / 1000.0 >= 0.08 AS slide FROM documents")
def p4_slide_like(spark, sf):
    return table(spark, sf, "documents").select("doc_id", is_slide_like(F.col("text"), (F.col("n_chars") % 100) / 1000.0).alias("slide"))


@query("SELECT vec_id, avg_luma < 126.0 AS black, avg_luma FROM (SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(0.0, least(255.0, floor(128 + 100 * x::DOUBLE))))) / len(embedding), 6) AS avg_luma FROM embeddings)")
def p1_black_frames(spark, sf):
    """The components as grey pixels."""
    from .functions.images import is_black

    px = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + 100 * x.cast("double")).cast("double"))))
    mean = F.round(F.aggregate(px, F.lit(0.0), lambda a, b: a + b) / F.size("embedding"), 6)
    return table(spark, sf, "embeddings").select("vec_id", is_black(mean, 126.0).alias("black"), mean.alias("avg_luma"))


def _measured(spark, sf) -> DataFrame:
    from .functions.images import image_measures

    px = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 100 * x.cast("double")).cast("int"))))
    data = F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    img = table(spark, sf, "embeddings").select("vec_id", F.struct(data.alias("data"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels")).alias("image"))
    return img.select("vec_id", image_measures().alias("m"))


def _pixels_sql() -> str:
    """Pictures of 8 by 8: each pixel stands for 4 by 4 of the 32 by 32 that the hash is made of."""
    import math

    every = [(y, x) for y in range(8) for x in range(8)]
    listed = lambda f: "[" + ", ".join(f(y, x) for y, x in every) + "]"
    # beside the picture: its mirror for blur, its border for gradients, nothing for what is thinned and grown
    mirror = lambda i: 1 if i < 0 else 6 if i > 7 else i
    border = lambda i: min(max(i, 0), 7)
    at = lambda y, x: f"[{8 * y + x + 1}]"
    inside = lambda name, y, x, none: f"{name}{at(y, x)}" if 0 <= y < 8 and 0 <= x < 8 else none
    basis = [[sum(math.cos(math.pi * (2 * i + 1) * u / 64) for i in range(4 * a, 4 * a + 4)) for a in range(8)] for u in range(8)]
    rows = ", ".join("[" + ", ".join(repr(v) for v in row) + "]" for row in basis)
    laplace = listed(lambda y, x: " + ".join("p" + at(mirror(y + dy), mirror(x + dx)) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))) + f" - 4 * p{at(y, x)}")

    def side(y: int, x: int, across: bool, by: int) -> str:
        """Three neighbours on one side, the middle one twice."""
        near = [(y + d, x + by) if across else (y + by, x + d) for d in (-1, 0, 1)]
        return "(" + " + ".join(f"{w} * p{at(border(i), border(j))}" for w, (i, j) in zip((1, 2, 1), near)) + ")"

    gx, gy = (listed(lambda y, x, c=c: f"{side(y, x, c, 1)} - {side(y, x, c, -1)}") for c in (True, False))

    def top(y: int, x: int) -> str:
        c, g = f"s{at(y, x)}", at(y, x)
        higher = lambda a, b, last=">=": f"({c} > {inside('s', *a, '0')} AND {c} {last} {inside('s', *b, '0')})"
        return (
            f"CASE WHEN abs(gy{g}) < 0.41421356::DOUBLE * abs(gx{g}) THEN {higher((y, x - 1), (y, x + 1))} WHEN abs(gy{g}) > 2.41421356::DOUBLE * abs(gx{g}) THEN {higher((y - 1, x), (y + 1, x))}"
            f" WHEN gx{g} * gy{g} >= 0 THEN {higher((y - 1, x - 1), (y + 1, x + 1))} ELSE {higher((y - 1, x + 1), (y + 1, x - 1), '>')} END"
        )

    grown = listed(lambda y, x: f"strong{at(y, x)} OR (weak{at(y, x)} AND (" + " OR ".join(inside("strong", y + i, x + j, "false") for i in (-1, 0, 1) for j in (-1, 0, 1)) + "))")
    return f"""d AS (SELECT [{rows}] AS d), px AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(128 + 100 * x::DOUBLE) AS INT)))::DOUBLE) AS p FROM embeddings),
 f AS (SELECT vec_id, p, {laplace} AS l, list_transform(range(64), lambda k: list_sum(list_transform(range(64), lambda i: p[i + 1] * d[k // 8 + 1][i // 8 + 1] * d[k % 8 + 1][i % 8 + 1]))) AS low FROM px, d),
 m AS (SELECT *, list_median(low) AS mid, list_avg(l) AS mean_l FROM f),
 h AS (SELECT *, list_sum(list_transform(range(64), lambda k: CASE WHEN low[k + 1] > mid THEN CAST(1 AS HUGEINT) << CAST(63 - k AS INT) ELSE 0 END)) AS bits FROM m),
 g AS (SELECT vec_id, {gx} AS gx, {gy} AS gy FROM px), sz AS (SELECT *, list_transform(range(1, 65), lambda i: abs(gx[i]) + abs(gy[i])) AS s FROM g),
 tp AS (SELECT vec_id, s, {listed(top)} AS t FROM sz),
 e(vec_id, weak, strong, n) AS (SELECT vec_id, list_transform(range(1, 65), lambda i: t[i] AND s[i] > 100), list_transform(range(1, 65), lambda i: t[i] AND s[i] > 200), 0 FROM tp
  UNION ALL SELECT vec_id, weak, grown, n + 1 FROM (SELECT *, {grown} AS grown FROM e) WHERE grown <> strong),
 ed AS (SELECT vec_id, len(list_filter(arg_max(strong, n), lambda x: x)) / 64 AS edge_density FROM e GROUP BY vec_id)"""


@query(with_(_pixels_sql()) + "SELECT vec_id, round(list_avg(p), 6) AS mean_luma, round(list_avg(list_transform(l, lambda x: (x - mean_l) * (x - mean_l))), 4) AS lap_var, edge_density, CAST(CASE WHEN bits >= CAST(9223372036854775808 AS HUGEINT) THEN bits - CAST(18446744073709551616 AS HUGEINT) ELSE bits END AS BIGINT) AS phash FROM h JOIN ed USING (vec_id)")
def p2_p3_image_measures(spark, sf):
    """Brightness, blur, edges and perceptual hash of small pictures made of the embeddings."""
    return _measured(spark, sf).select("vec_id", F.round("m.mean_luma", 6).alias("mean_luma"), F.round("m.lap_var", 4).alias("lap_var"), "m.edge_density", "m.phash")


@query("SELECT vec_id, vec_id % 3 = 0 OR vec_id % 4 = 0 AS removed FROM embeddings")
def p5_quality_filter(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, 14.9).otherwise(15.0).alias("mean_luma"), F.when(F.col("vec_id") % 4 != 0, 100.0).alias("lap_var"))
    good = dedup.quality(e).select("vec_id", F.lit(False).alias("g"))
    return e.join(good, "vec_id", "left").select("vec_id", F.coalesce("g", F.lit(True)).alias("removed"))


@query("SELECT count(*) FILTER (good AND kept) AS kept, count(*) FILTER (NOT good) AS low_quality, count(*) FILTER (good AND NOT kept) AS duplicates FROM (SELECT vec_id % 7 <> 0 AS good, vec_id % 7 <> 0 AND vec_id % 2 = 0 AS kept FROM embeddings)")
def a6_removal_counts(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 7 != 0).alias("good"), ((F.col("vec_id") % 7 != 0) & (F.col("vec_id") % 2 == 0)).alias("is_kept"))
    return dedup.removal_counts(e)


# ---------------------------------------------------------------- the store


@query(with_(FR) + "SELECT video_id, frame_number, timestamp FROM fr WHERE is_kept")
def s13_kept_frames(spark, sf):
    return frames.frames_of(all_frames(spark, sf), True).select("video_id", "frame_number", "timestamp")


@query(with_(FR) + "SELECT video_id, frame_number, timestamp FROM fr WHERE NOT is_kept")
def p8_removed_frames(spark, sf):
    return frames.frames_of(all_frames(spark, sf), False).select("video_id", "frame_number", "timestamp")


@query(with_(FR) + "SELECT ch.video_id, ch.chapter_number, ch.title, ch.density, CAST(fr.frame_number AS VARCHAR) AS frame_number, fr.timestamp, fr.path, CASE WHEN fr.frame_number IS NOT NULL THEN coalesce(fr.ocr_text, '') END AS ocr_text, CAST(fr.is_kept AS VARCHAR) AS is_kept FROM ch LEFT JOIN fr ON fr.video_id = ch.video_id AND fr.chapter_number = ch.chapter_number")
def s17_frame_records(spark, sf):
    r = frames.frame_records(all_chapters(spark, sf), all_frames(spark, sf))
    return r.withColumns({c: F.col(c).cast("string") for c in ("frame_number", "is_kept")})


@query(with_(FR) + "SELECT ch.video_id, ch.chapter_number, count(fr.frame_number) AS n, coalesce(string_agg(CAST(fr.frame_number AS VARCHAR), ',' ORDER BY fr.timestamp, fr.frame_number), '') AS numbers FROM ch LEFT JOIN fr ON fr.video_id = ch.video_id AND fr.chapter_number = ch.chapter_number GROUP BY ch.video_id, ch.chapter_number")
def a1_group_by_chapter(spark, sf):
    g = frames.grouped_frames(all_chapters(spark, sf), all_frames(spark, sf))
    return g.select("video_id", "chapter_number", F.size("frames").cast("bigint").alias("n"), F.array_join(F.transform("frames", lambda f: f["frame_number"].cast("string")), ",").alias("numbers"))


@query("SELECT c_custkey AS video_id, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name ELSE c_name END AS title, c_acctbal AS duration FROM customer UNION ALL SELECT -c_custkey - 1, 'new ' || c_name, -1.0::DOUBLE FROM customer WHERE c_custkey % 5 = 0")
def k4_upsert_videos(spark, sf):
    """Known videos keep all but the title; unknown ones are added."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("duration"))
    title = F.concat(F.lit("new "), F.col("title"))
    again = c.filter("video_id % 2 = 0").select("video_id", title.alias("title"), F.lit(-1.0).alias("duration"), F.lit(1).alias("seq"))
    more = c.filter("video_id % 5 = 0").select((-F.col("video_id") - 1).alias("video_id"), title.alias("title"), F.lit(-1.0).alias("duration"), F.lit(2).alias("seq"))
    return frames.upsert_videos(c, again.unionByName(more))


@query(with_(FR) + """SELECT frame_number AS id, video_id, chapter_number, frame_number, timestamp, path, ocr_text, is_kept FROM fr UNION ALL
 SELECT (SELECT max(frame_number) FROM fr) + row_number() OVER (ORDER BY event_id), video_id, 0, CAST(event_id AS INT), t, 'new/' || event_id, '', true FROM ev WHERE event_type = 'view'""")
def k5_insert_frames(spark, sf):
    """Appended frames get the next ids in order of arrival, no text, and are kept."""
    store = all_frames(spark, sf).select(F.col("frame_number").alias("id"), "video_id", "chapter_number", "frame_number", "timestamp", "path", "ocr_text", "is_kept")
    n = F.col("event_id")
    new = events(spark, sf).filter("event_type = 'view'").select(n.alias("seq"), "video_id", F.lit(0).alias("chapter_number"), n.cast("int").alias("frame_number"), F.col("t").alias("timestamp"), F.concat(F.lit("new/"), n.cast("string")).alias("path"))
    return frames.insert_frames(store, new, block=700)


@query(with_(CH) + """, o AS (SELECT video_id * 7 + chapter_number + 1 AS id, video_id, chapter_number, title, start_time, end_time, is_synthetic FROM ch WHERE video_id % 2 = 0)
 SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY video_id * 7 + chapter_number), video_id, chapter_number, title, start_time, end_time, false FROM ch WHERE video_id % 2 = 1""")
def k6_insert_chapters(spark, sf):
    seq = F.col("video_id") * 7 + F.col("chapter_number")
    c = all_chapters(spark, sf).select((seq + 1).alias("id"), "video_id", "chapter_number", "title", "start_time", "end_time", "is_synthetic")
    return frames.insert_chapters(c.filter("video_id % 2 = 0"), c.filter("video_id % 2 = 1").withColumn("seq", seq).drop("is_synthetic"))


@query(with_(FR) + "SELECT path, 'vault/' || video_id || '/' || video_id || '_f' || frame_number AS copy FROM fr")
def e5_copies(spark, sf):
    """Names with the video's id before them, so pictures of many videos lie in one vault."""
    return frames.copies(all_frames(spark, sf), "vault/")


@query(with_(EV) + "SELECT video_id, event_id AS frame_number, video_id || '/' || printf('frame_%08.2f.jpg', t) AS path FROM ev")
def j10_frame_paths(spark, sf):
    """The path of each point's picture."""
    e = events(spark, sf).select("video_id", F.col("event_id").alias("frame_number"), F.col("t").alias("timestamp"))
    return adapters.Tables(e, e).frames(e).select("video_id", "frame_number", "path")


@query(with_(FR) + "SELECT video_id, frame_number, CASE WHEN frame_number % 3 = 0 THEN 'seen' ELSE coalesce(ocr_text, '') END AS ocr_text FROM fr")
def k7_set_ocr(spark, sf):
    f = all_frames(spark, sf)
    return frames.set_ocr(f, f.filter("frame_number % 3 = 0").withColumn("ocr_text", F.lit("seen"))).select("video_id", "frame_number", "ocr_text")


@query(with_(FR) + "SELECT video_id, frame_number, CASE WHEN frame_number % 3 = 0 THEN true WHEN video_id % 2 = 0 THEN false ELSE is_kept END AS is_kept FROM fr")
def k8_k9_set_kept(spark, sf):
    f = all_frames(spark, sf)
    reset = f.withColumn("is_kept", F.when(F.col("video_id") % 2 == 0, False).otherwise(F.col("is_kept")))
    return frames.set_kept(reset, f.filter("frame_number % 3 = 0"), True).select("video_id", "frame_number", "is_kept")


@query(with_(FR) + "SELECT video_id, frame_number FROM fr WHERE video_id % 4 <> 0")
def k10_delete_videos(spark, sf):
    f = all_frames(spark, sf)
    return frames.without_videos(f, all_videos(spark, sf).filter("video_id % 4 = 0")).select("video_id", "frame_number")


@query(with_(FR) + "SELECT video_id, frame_number FROM fr WHERE frame_number IN (SELECT frame_number FROM fr WHERE timestamp < 360)")
def j7_kept_ids(spark, sf):
    f = all_frames(spark, sf)
    return f.join(f.filter("timestamp < 360").select("video_id", "frame_number"), ["video_id", "frame_number"], "left_semi").select("video_id", "frame_number")


@query(with_(FR) + "SELECT f.frame_number, coalesce(d.text, '') AS ocr_text FROM fr f LEFT JOIN documents d ON d.doc_id = f.frame_number")
def j11_ocr_lookup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("frame_number"), "text")
    return all_frames(spark, sf).join(d, "frame_number", "left").select("frame_number", F.coalesce("text", F.lit("")).alias("ocr_text"))


# ---------------------------------------------------------------- parsing and scalars


@query("SELECT CAST(p_partkey AS VARCHAR) AS video_id, p_name AS title, p_retailprice AS duration, 'https://v/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS description FROM part")
def s2_video_info(spark, sf):
    return videos.videos(_info(spark, sf))


def _info(spark, sf) -> DataFrame:
    own = F.when(F.col("p_size") % 3 == 0, F.array(*(F.struct(F.concat(F.lit(f"{n} "), F.col("p_brand")).alias("title"), F.lit(n * 10.0).alias("start_time"), (F.lit(n * 10.0) + F.col("p_size")).alias("end_time")) for n in range(3))))
    obj = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("duration"), F.concat(F.lit("https://v/"), F.col("p_partkey").cast("string")).alias("webpage_url"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"), own.alias("chapters"), F.lit(1).alias("other"))
    return videos.parse_info(table(spark, sf, "part").select(F.to_json(obj).alias("json")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS video_id, CAST(n AS INT) AS chapter_number, n || ' ' || p_brand AS title, (n * 10.0)::DOUBLE AS start_time, (n * 10.0 + p_size)::DOUBLE AS end_time, false AS is_synthetic FROM part, (SELECT unnest(range(3)) AS n) WHERE p_size % 3 = 0")
def s3_chapters(spark, sf):
    return videos.chapters(_info(spark, sf))


@query("SELECT CAST(o_custkey AS VARCHAR) AS video_id, CASE WHEN bool_or(o_orderkey % 4 = 0) THEN min(CASE WHEN o_orderkey % 4 = 0 THEN 'c/' || o_orderkey || '/whisper.vtt' END) ELSE min(CASE WHEN o_orderkey % 4 <> 0 THEN 'c/' || o_orderkey || '/source.vtt' END) END AS path FROM orders GROUP BY o_custkey")
def s5_caption_file(spark, sf):
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("c/"), key, F.lit("/whisper.vtt"))).otherwise(F.concat(F.lit("c/"), key, F.lit("/source.vtt")))
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("video_id"), F.explode(F.array(name, F.concat(F.lit("c/"), key, F.lit("/source.mp4")))).alias("path"))
    return videos.caption_file(o)


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN '' ELSE source || ' ' || lang END AS text, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE length(source || ' ' || lang) END::INT AS text_length FROM documents")
def s8_ocr_result(spark, sf):
    item = lambda t: F.struct(F.lit("box").alias("box"), t.alias("text"), F.lit(0.5).alias("score"))
    d = table(spark, sf, "documents").withColumn("items", F.when(F.col("n_chars") % 3 != 0, F.array(item(F.col("source")), item(F.lit("")), item(F.lit(None).cast("string")), item(F.col("lang")))).otherwise(F.array().cast("array<struct<box:string,text:string,score:double>>")))
    return captions.ocr_result(d.select("doc_id", "items")).select("doc_id", "text", "text_length")


_SLUG = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-')"


@query(f"SELECT p_partkey, {_SLUG.format(x='x')} AS slug FROM (SELECT p_partkey, ' Part & ' || p_name || ': ' || p_type || '! - What''s  new?' AS x FROM part)")
def x1_slug(spark, sf):
    text = F.concat(F.lit(" Part & "), F.col("p_name"), F.lit(": "), F.col("p_type"), F.lit("! - What's  new?"))
    return table(spark, sf, "part").select("p_partkey", scalars.slug(text).alias("slug"))


@query(f"SELECT page_id, {_SLUG.format(x='x')} AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS x FROM pages)")
def x1_slug_of_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN l_quantity WHEN 2 THEN l_linenumber * 60 + l_quantity ELSE 3600.0 * 2 + l_linenumber * 60 + l_quantity END::DOUBLE AS sec FROM lineitem")
def x2_parse_timestamp(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    text = F.when(n % 4 == 0, "  ").when(n % 4 == 1, q).when(n % 4 == 2, F.concat(F.lit(" "), n.cast("string"), F.lit(":"), q)).otherwise(F.concat(F.lit("02:"), n.cast("string"), F.lit(":"), q))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.seconds(text).alias("sec"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS flag, printf('frame_%08.2f.jpg', p_partkey / 4.0 + 0.0625) AS name, length('x' || p_name) AS chars FROM part")
def x9_x11_x12_formats(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalars.yes_no(F.col("p_size") % 2 == 0).alias("flag"), scalars.frame_name(F.col("p_partkey") / 4 + 0.0625).alias("name"), F.length(scalars.stripped(F.concat(F.lit(" \n\tx"), F.col("p_name"), F.lit(" \n")))).cast("bigint").alias("chars"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, coalesce(json_extract_string(props, '$.none'), 'normal') AS density FROM events")
def x15_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("normal")).alias("density"))


# ---------------------------------------------------------------- documents

_LINE = "chr(10)"


def _sql_lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_FRAME = _sql_lines("'### Frame ' || frame_number || printf(' @ %.1fs', timestamp)", "''", "'![frame](' || path || ')'", "''", "'**Caption:** ' || caption_text", "CASE WHEN coalesce(ocr_text, '') <> '' THEN '**OCR:** ' || ocr_text END", "''")


def _manifest_sql(per_video: bool) -> str:
    by = "video_id" if per_video else "video_id, chapter_number"
    chunk = _sql_lines("'## Chunk ' || chunk || ' of ' || chunks", "''", "'### Instructions'", "''", _str(render.LOOK), "''", "string_agg(f, chr(10) ORDER BY timestamp, frame_number)", "'### Analysis'", "''", _str(render.TO_FILL), "''", "'---'", "''")
    return f"""{FR}, {CAP}, t AS (SELECT fr.*, coalesce((SELECT string_agg(text, ' ' ORDER BY caption_idx) FROM cap WHERE {OVER}), '_none_') AS caption_text FROM fr),
 k AS (SELECT *, {_FRAME} AS f, CAST(floor((row_number() OVER (PARTITION BY {by} ORDER BY timestamp, frame_number) - 1) / 12) AS INT) + 1 AS chunk, CAST(ceil(count(*) OVER (PARTITION BY {by}) / 12) AS INT) AS chunks FROM t),
 kc AS (SELECT {by}, chunk, count(*) AS n, {chunk} AS c FROM k GROUP BY {by}, chunk, chunks),
 sec AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS frame_count, string_agg(c, chr(10) ORDER BY chunk) AS section FROM kc GROUP BY {by})"""


_TAIL = ["'### Instructions'", "''", *map(_str, render.STEPS), "''"]
_CONTEXT = [_str(render.CONTEXT), "''", _str(render.NO_DESCRIPTION), "''", *map(_str, render.SUMMARY)]


def _head(*chapter: str, interval: str = "CASE density WHEN 'high' THEN '3.0' WHEN 'normal' THEN '5.0' ELSE '15.0' END") -> list[str]:
    return ["'---'", "'video_id: ' || video_id", "'video_title: \"Video ' || video_id || '\"'", "'duration: 720.0'", *chapter, "'frame_count: ' || coalesce(frame_count, 0)", "'density: ' || density", "'detector: content'", "'sensitivity: 30.0'", f"'scene_sample_interval: ' || {interval}", "'slide_aware_dedup: true'", "'ocr_applied: false'", "'caption_source: youtube'", "'manifest_version: 3'", "'---'", "''"]


def _yaml(title: str, *more: str) -> list[str]:
    return ["'### Output Frontmatter Template'", "''", "'```yaml'", "'---'", "'video_id: ' || video_id", title, "'type: yt-research-note'", *more, "'created: YYYY-MM-DD'", "'tags: []'", "'---'", "'```'", "''"]


def _ch_range(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({c} AS VARCHAR) END"


@query(
    with_(_manifest_sql(False))
    + "SELECT video_id, chapter_number, 'manifest-' || printf('%02d', chapter_number) || '-part-' || (chapter_number + 1) || '.md' AS path, "
    + _sql_lines(
        *_head("'chapter_number: ' || chapter_number", "'chapter_title: \"' || title || '\"'", f"'chapter_timerange: ' || {_ch_range('start_time')} || '-' || {_ch_range('end_time')}"),
        "'# Manifest: Chapter ' || chapter_number || ' — ' || title", "''", *_CONTEXT, "section", "'---'", "''", "'## Final Synthesis'", "''",
        "'**Target output path:** `output/' || video_id || '-ch' || printf('%02d', chapter_number) || '-part-' || (chapter_number + 1) || '.md`'", "''",
        *_yaml("'title: \"Video ' || video_id || ' — ' || title || '\"'", "'chapter: ' || chapter_number"), *_TAIL,
    )
    + " AS content FROM ch LEFT JOIN sec USING (video_id, chapter_number)"
)
def k12_chapter_manifests(spark, sf):
    v = all_videos(spark, sf).select("video_id", F.concat(F.lit("Video "), F.col("video_id").cast("string")).alias("title"), "duration", F.lit("").alias("description"))
    return render.manifests(v, all_chapters(spark, sf), all_frames(spark, sf), all_captions(spark, sf))


@query(
    with_(_manifest_sql(True))
    + "SELECT video_id, 0 AS chapter_number, 'manifest.md' AS path, "
    + _sql_lines(
        *_head(interval="'5.0'"), "'# Manifest: Video ' || video_id", "''", *_CONTEXT, "section", "'---'", "''", "'## Final Synthesis'", "''",
        "'**Target output path:** `output/' || video_id || '-research-note.md`'", "''", *_yaml("'title: \"Video ' || video_id || '\"'"), *_TAIL,
    )
    + " AS content FROM (SELECT video_id, 'normal' AS density FROM vid) LEFT JOIN sec USING (video_id)"
)
def k11_manifest(spark, sf):
    v = all_videos(spark, sf).select("video_id", F.concat(F.lit("Video "), F.col("video_id").cast("string")).alias("title"), "duration", F.lit(None).cast("string").alias("description"))
    one = chapters.with_density(chapters.synthetic_chapters(all_videos(spark, sf), 720.0))
    return render.manifests(v, one, all_frames(spark, sf).withColumn("chapter_number", F.lit(0)), all_captions(spark, sf))


@query(with_(_manifest_sql(False)) + "SELECT video_id, chapter_number, frame_number, chunk, chunks FROM k")
def f10_chunks(spark, sf):
    return render.chunked(all_frames(spark, sf)).select("video_id", "chapter_number", "frame_number", "chunk", "chunks")


@query(with_(_manifest_sql(False)) + "SELECT video_id, chapter_number, string_agg(f, chr(10) ORDER BY timestamp, frame_number) AS section FROM k GROUP BY video_id, chapter_number")
def k11_plain_frames_section(spark, sf):
    f = all_frames(spark, sf)
    texts = f.join(align.align_captions(f, all_captions(spark, sf)).drop("captions"), ["video_id", "frame_number"])
    return render.frames_section(texts)


@query("SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS name FROM pages")
def e5_embedded_references(spark, sf):
    return frames.embedded(table(spark, sf, "pages"), 'href="([^"]+)"', "html")


@query("SELECT url AS name FROM pages WHERE url NOT IN (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) FROM pages)")
def e5_unused_files(spark, sf):
    pages = table(spark, sf, "pages")
    return frames.unused(pages.select(F.col("url").alias("name")), frames.embedded(pages, 'href="([^"]+)"', "html"))


# ---------------------------------------------------------------- more of the store and the parsers


@query("SELECT c_custkey AS video_id, c_name AS title FROM customer WHERE c_custkey = 7")
def s12_get_video(spark, sf):
    """A point lookup."""
    return frames.videos(table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("title")), 7)


@query(with_(FR) + "SELECT video_id, chapter_number, frame_number FROM fr WHERE chapter_number = 3 AND is_kept")
def s14_frames_by_chapter(spark, sf):
    """One chapter number of every video, kept frames only."""
    return frames.frames_of(all_frames(spark, sf).filter("chapter_number = 3"), True).select("video_id", "chapter_number", "frame_number")


@query(with_(CH) + "SELECT video_id, chapter_number, title FROM ch")
def s15_chapters(spark, sf):
    return frames.chapters_of(all_chapters(spark, sf)).select("video_id", "chapter_number", "title")


@query(with_(FR) + "SELECT frame_number, density, true AS is_slide FROM fr")
def k3_added_column(spark, sf):
    """A column that older tables lack gets its default; one that is there stays."""
    f = all_frames(spark, sf).select("frame_number", "density")
    return frames.with_column(frames.with_column(f, "is_slide", True), "density", "none")


@query(with_(FR) + "SELECT video_id, chapter_number, count(*) AS frames, count(*) FILTER (ocr_text IS NOT NULL) AS with_text, min(timestamp) AS first, max(timestamp) AS last FROM fr GROUP BY video_id, chapter_number")
def a7_a10_frame_counts(spark, sf):
    f = all_frames(spark, sf)
    return f.groupBy("video_id", "chapter_number").agg(F.count("*").alias("frames"), F.count("ocr_text").alias("with_text"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("SELECT event_id, ((event_id % 3) * 3600 + (event_id % 60) * 60 + (event_id % 7))::DOUBLE + 0.5::DOUBLE AS sec FROM events")
def x3_strict_seconds(spark, sf):
    n = F.col("event_id")
    text = F.format_string("%d:%02d:%02d.5", n % 3, n % 60, n % 7)
    return table(spark, sf, "events").select("event_id", scalars.seconds(text, strict=True).alias("sec"))


@query(with_(EV) + ", o AS (SELECT user_id AS video_id, min((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / CAST(3.6e9 AS DOUBLE)) AS t FROM events GROUP BY user_id) SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'own' ELSE 'Part 1' END AS title, CASE WHEN video_id % 2 = 0 THEN t ELSE 0.0::DOUBLE END AS start_time FROM o")
def f7_own_or_synthetic(spark, sf):
    """Videos with chapters keep them; the others get one part."""
    e = events(spark, sf).groupBy("video_id").agg(F.min("t").alias("start_time"))
    own = e.filter("video_id % 2 = 0").select("video_id", F.lit(0).alias("chapter_number"), F.lit("own").alias("title"), "start_time", F.lit(720.0).alias("end_time"), F.lit(False).alias("is_synthetic"))
    return timeline.chapters_or_synthetic(all_videos(spark, sf), own).select("video_id", "title", "start_time")
