"""Worked cases of cue matching, anchored windows, filling, sampling and chapters."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import chapters, cues, sampling
from framewright.profiles import build_profiles, profile_rows
from framewright.schemas import CHAPTER, SCENE

SEG = "video_id string, seg_idx int, start double, text string"


@pytest.fixture(scope="module")
def seg(spark):
    return lambda rows: spark.createDataFrame([("v", i, float(s) if s is not None else None, t) for i, (s, t) in enumerate(rows)], SEG)


@pytest.fixture(scope="module")
def cue(spark):
    return lambda rows: spark.createDataFrame([("v", i, float(t), n, "p", "c") for i, (t, n) in enumerate(rows)], "video_id string, seg_idx int, timestamp double, tier int, phrase string, context string")


@pytest.fixture(scope="module")
def ch(spark):
    def make(spans, density="normal", video="v"):
        density = [density] * len(spans) if isinstance(density, str) else density
        return spark.createDataFrame([(video, i, f"c{i}", float(a), float(b), False, d) for i, ((a, b), d) in enumerate(zip(spans, density))], CHAPTER)

    return make


@pytest.fixture(scope="module")
def at(spark):
    return lambda times: spark.createDataFrame([("v", float(t)) for t in times], "video_id string, timestamp double")


def found(df):
    return sorted((r["timestamp"], r["tier"], r["phrase"]) for r in df.collect())


@pytest.mark.parametrize(
    "text,tiers,want",
    [
        ("as you can see here the diagram shows", (1, 2, 3), (1, "as you can see")),
        ("let me pull up the file manager", (2,), (2, "let me pull up")),
        ("these results are really interesting", (3,), (3, "these results")),
        ("as you can see this benchmark shows the data", (1, 2, 3), (1, "as you can see")),
        ("as you can see this benchmark shows the data", (3,), (3, "this benchmark")),
        ("AS YOU CAN SEE", (1,), (1, "as you can see")),
        ("open the database", (1, 2, 3), (3, "the data")),
        ("on\nscreen", (1, 2, 3), None),
        ("nothing at all", (1, 2, 3), None),
        ("xthis slide", (1,), None),
        (None, (1, 2, 3), None),
        ("this slide", (), None),
    ],
)
def test_find_cues(seg, text, tiers, want):
    got = found(cues.find_cues(seg([(10, text)]), tiers))
    assert got == ([(10.0, *want)] if want else [])


def test_phrases_are_no_patterns(spark):
    df = spark.createDataFrame([("see a.b now",), ("see axb now",), ("c[1] (x)",)], "t string")
    got = [bool(r[0]) for r in df.select(F.regexp_extract("t", cues.tier_pattern(["a.b", "c[1] (x"]), 0)).collect()]
    assert got == [True, False, True]


def test_find_cues_without_start_and_context(seg):
    r = cues.find_cues(seg([(None, " \nthis slide\t ")])).first()
    assert (r["timestamp"], r["context"]) == (0.0, "this slide")


def anchored(rows, window):
    out, group = [], []
    for c in sorted(rows):
        if group and c[0] - group[0][0] > window:
            out.append(min(group, key=lambda x: (x[1], x[0])))
            group = []
        group.append(c)
    return out + ([min(group, key=lambda x: (x[1], x[0]))] if group else [])


@pytest.mark.parametrize(
    "rows,window,want",
    [
        ([(10, 1), (12, 2), (14, 3)], 15, [10]),
        ([(10, 1), (50, 2)], 15, [10, 50]),
        ([(10, 1), (12, 1), (14, 1), (30, 2)], 5, [10, 30]),
        ([(10, 2), (12, 1), (24, 3), (26, 3), (50, 1)], 15, [12, 26, 50]),
        ([(0, 3), (15, 3), (15.001, 3)], 15, [0, 15.001]),
        ([], 15, []),
    ],
)
def test_anchored_window(cue, rows, window, want):
    assert [r["timestamp"] for r in cues.deduplicate_cues(cue(rows), window).orderBy("timestamp").collect()] == want


def test_anchored_window_of_many_cues(cue):
    """Twice the cues take about twice the time; none is lost where the fold's parts meet."""
    import time

    took = {}
    for n in (100, 15_000, 30_000):  # the first one compiles
        df = cue([(20.0 * i, 1) for i in range(n)]).cache()
        df.count()
        began = time.time()
        assert cues.deduplicate_cues(df).count() == n
        took[n] = time.time() - began
    assert took[30_000] < 2.9 * took[15_000] + 2


def test_anchored_window_random(cue):
    rng = random.Random(0)
    rows = [(rng.randrange(400) / 2, rng.randrange(1, 4)) for _ in range(200)]
    got = sorted((r["timestamp"], r["tier"]) for r in cues.deduplicate_cues(cue(rows), 7.5).collect())
    assert got == [(float(t), n) for t, n in anchored(rows, 7.5)]


@pytest.mark.parametrize(
    "spans,existing,budget,per,want",
    [
        ([(0, 60), (60, 120)], [], 200, 3, [15, 30, 45, 75, 90, 105]),
        ([(0, 60), (60, 120)], [15, 75], 200, 3, [15, 20, 40, 75, 80, 100]),
        ([(0, 60), (60, 120)], [10, 20, 30], 200, 3, [10, 20, 30, 75, 90, 105]),
        ([], [10], 200, 3, [10]),
        ([(0, 60)], list(range(12)), 10, 3, list(range(12))),
        ([(0, 60)], list(range(12)), 12, 3, list(range(12))),
        ([(0, 0), (0, 8)], [], 4, 3, [2.667, 5.333]),
    ],
)
def test_fill(ch, at, spans, existing, budget, per, want):
    got = [r["timestamp"] for r in sampling.fill(ch(spans), at(existing), budget, per).orderBy("timestamp").collect()]
    assert got == [float(x) for x in want]


def fill_by_hand(spans, existing, total, per):
    """The sequential rule: even places, dropped where a tenth of a second is taken, until the total."""
    left = total - len(existing)
    if left <= 0:
        return sorted(existing)
    slots = {round(t, 1) for t in existing}
    have = [sum(a <= t < b for t in existing) for a, b in spans]
    short = [i for i in range(len(spans)) if have[i] < per]
    new = []
    share = max(1, left // len(short)) if short else 0
    for i in short:
        a, b = spans[i]
        n = min(per - have[i], share)
        for j in range(1, n + 1) if b > a else ():
            t = round(a + j * (b - a) / (n + 1), 3)
            if t < b and round(t, 1) not in slots:
                slots.add(round(t, 1))
                new.append(t)
        if len(new) + len(existing) >= total:
            break
    return sorted(existing + new)[:total] if len(existing) <= total else sorted(existing)


def test_fill_random(spark):
    rng = random.Random(1)
    c, e, want = [], [], {}
    for v in range(60):
        edges = sorted(rng.randrange(0, 900) / 10 for _ in range(rng.randrange(2, 9)))
        spans = list(zip(edges, edges[1:]))
        existing = sorted({rng.randrange(0, 900) / 10 for _ in range(rng.randrange(12))})
        c += [(str(v), i, "t", a, b, False, "normal") for i, (a, b) in enumerate(spans)]
        e += [(str(v), t) for t in existing]
        want[str(v)] = fill_by_hand(spans, existing, 14, 4)
    got = {v: [] for v in want}
    for r in sampling.fill(spark.createDataFrame(c, CHAPTER), spark.createDataFrame(e, "video_id string, timestamp double"), 14, 4).orderBy("timestamp").collect():
        got[r["video_id"]].append(r["timestamp"])
    for v in want:
        assert got[v] == pytest.approx(want[v], abs=1e-9)


def test_light_points(ch, at):
    p = sampling.light_points(at([10, 30, 75, 100, 10, 60]), ch([(0, 60), (60, 120)])).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["chapter_number"]) for r in p] == [(10, 0), (30, 0), (60, 1), (75, 1), (100, 1)]
    assert sampling.light_points(at([5]), ch([(10, 20)])).first()["chapter_number"] == 0


def steps_by_hand(scenes, spans, densities, every, fallback=30.0):
    def chapter(t):
        return next((i for i, (a, b) in enumerate(spans) if a <= t < b), len(spans) - 1)

    out = []
    if not scenes:
        t, i = 0.0, 0
        while t < spans[-1][1]:
            out.append((t, i))
            t, i = t + fallback, i + 1
    for i, (a, b) in enumerate(scenes):
        out.append((a, i))
        t = a
        while every[densities[chapter(t)]] > 0:
            t += every[densities[chapter(t)]]
            if t >= b:
                break
            out.append((t, i))
    seen, kept = set(), []
    for t, i in out:
        if round(t, 3) not in seen:
            seen.add(round(t, 3))
            kept.append((round(t, 3), i, chapter(t)))
    return sorted(kept)


def test_scene_points_unknown_density(spark, ch):
    one = spark.createDataFrame([("v", 0, 0.0, 10.0)], SCENE)
    with pytest.raises(Exception, match="unknown density: dense"):
        sampling.scene_points(one, ch([(0, 10)], "dense"), profile_rows(spark, build_profiles("normal", 5.0))).collect()


def test_scene_points(spark, ch):
    profiles = profile_rows(spark, build_profiles("normal", 5.0))
    one = spark.createDataFrame([("v", 0, 0.0, 10.0)], SCENE)
    got = sampling.scene_points(one, ch([(0, 10)], "high"), profiles).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["density"]) for r in got] == [(0, "high"), (3, "high"), (6, "high"), (9, "high")]
    bare = sampling.scene_points(one.limit(0), ch([(0, 65)]), profiles).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["scene_id"]) for r in bare] == [(0, 0), (30, 1), (60, 2)]


def test_scene_points_random(spark):
    rng = random.Random(2)
    every = {"high": 3.0, "normal": 0.0, "low": 15.0}
    profiles = profile_rows(spark, build_profiles("normal", 0.0))
    c, s, want = [], [], []
    for v in range(40):
        edges = sorted(rng.sample(range(0, 200), rng.randrange(2, 6)))
        spans, dens = list(zip(edges, edges[1:])), [rng.choice(list(every)) for _ in edges[1:]]
        cuts = sorted(rng.sample(range(0, 220), rng.randrange(0, 5)))
        scenes = [(float(a), float(b)) for a, b in zip(cuts, cuts[1:])]
        c += [(str(v), i, "t", float(a), float(b), False, d) for i, ((a, b), d) in enumerate(zip(spans, dens))]
        s += [(str(v), i, a, b) for i, (a, b) in enumerate(scenes)]
        want += [(str(v), *x) for x in steps_by_hand(scenes, spans, dens, every)]
    got = sampling.scene_points(spark.createDataFrame(s, SCENE), spark.createDataFrame(c, CHAPTER), profiles)
    assert sorted((r["video_id"], round(r["timestamp"], 3), r["scene_id"], r["chapter_number"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("duration,length,n,last", [(2700, 900, 3, 2700), (1500, 900, 1, 1500), (3600, 600, 6, 3600), (0, 600, 1, 0), (100, 600, 1, 100)])
def test_synthetic_chapters(spark, duration, length, n, last):
    got = chapters.synthetic_chapters(spark.createDataFrame([("v", float(duration))], "video_id string, duration double"), length).orderBy("chapter_number").collect()
    assert len(got) == n and got[-1]["end_time"] == last and all(r["is_synthetic"] for r in got)
    assert got[0]["title"] == ("Part 1" if duration else "Full Video")


def test_densities_and_coverage(ch, at):
    c = ch([(0, 60), (60, 120), (120, 180)])
    got = chapters.with_density(c.drop("density"), "low", [2], 60.0).orderBy("chapter_number").collect()
    assert [r["density"] for r in got] == ["high", "low", "high"]
    have = chapters.coverage(c, at([0, 59.9, 60, 180])).orderBy("chapter_number").collect()
    assert [r["have"] for r in have] == [2, 1, 0]
    none = chapters.assign_chapter(at([1.0]).withColumn("video_id", F.lit("w")), c)
    assert none.count() == 0
