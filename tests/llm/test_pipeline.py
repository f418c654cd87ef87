"""The pipeline against a plain run of the same decisions, stage by stage."""

import re

import pytest
from test_rowwise import targets_by_hand
from test_similar import leaks_by_hand, want_rows

from framewright.llm import language_id, secret_scan

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark", "secrets", "mix"]

    out = stages["language"](spark, docs, SF).cache()
    told = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    letters = {d for d, t in rows(docs) if re.search(r"[^\W\d_]", t or "")}
    assert out.columns == cols and ids(out) == {d for d in letters if told[d]["score"] >= 0.5} and len(ids(out)) > 0.99 * len(letters)

    before, out = out, stages["near_duplicates"](spark, out, SF).cache()
    assert out.columns == cols and ids(out) == {c for _, _, c in want_rows(rows(before))}

    before, out = out, stages["benchmark"](spark, out, SF).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks_by_hand(rows(before), items)}
    assert out.columns == cols and bad and ids(out) == ids(before) - bad

    before, out = out, stages["secrets"](spark, out, SF).cache()
    live = {r["doc_id"]: [s for s in r["spans"] if s["live"]] for r in secret_scan.secret_scan(before).collect()}
    after = dict(rows(out))
    assert out.columns == cols and set(after) == ids(before)
    for d, t in rows(before):
        assert (after[d] == t) == (not live[d])
        for s in live[d]:
            assert t[s["start"] : s["end"]] not in after[d]

    got = stages["mix"](spark, out, SF).toPandas()
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in after.items()}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    source = {r["doc_id"]: r["source"] for r in out.collect()}
    total = {}
    for d, n in sizes.items():
        total[source[d]] = total.get(source[d], 0) + n
    want = targets_by_hand(total)
    assert all(r.target == pytest.approx(want[source[r.doc_id]]) for r in got.itertuples())
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert whole.sort_values("doc_id").reset_index(drop=True).equals(got.sort_values("doc_id").reset_index(drop=True))


def test_language_stage_decides_by_its_prediction(spark, docs_of):
    """Texts of no known language go, however many letters they have; unwanted languages go where some are named."""
    en, es = "the cat and the dog were here with all of them ", "el perro y la gata estaban con todos los de aqui "
    docs = docs_of([(i, en * (1 + i % 3), "en") for i in range(60)] + [(100 + i, es * (1 + i % 3), "es") for i in range(60)] + [(200, "12 34", "en"), (201, None, "es")])
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs, SF).collect()}
    assert kept == {*range(60), *range(100, 160)}
    model = language_id.train(docs)
    assert {r["doc_id"] for r in language_id.accepted(docs, model, wanted=["es"]).collect()} == {*range(100, 160)}
    score = {r["doc_id"]: r["score"] for r in language_id.language_id(docs).collect()}
    high = sorted(score.values())[-40]
    assert {r["doc_id"] for r in language_id.accepted(docs, model, least=high).collect()} == {d for d, x in score.items() if x >= high}


def test_stages_on_odd_tables(spark, docs_of):
    from pyspark.sql import functions as F

    odd = docs_of([(1, None, None, None), (None, "no id here at all", None, "s"), (2, "password=abcdefgh12", "en", None), (2, "password=abcdefgh12", "en", None), (3, "", "en", "s"), (4, "12 34", None, "s")])
    for docs in (odd, odd.limit(0), odd.withColumn("score", F.lit(1.5)).withColumn("_id", F.lit("x"))):
        out = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
