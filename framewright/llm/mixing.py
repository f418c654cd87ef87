"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  Whole copies of all its documents are certain as long as they fit; the rest is
an unequal-probability sample of fixed size.  There a document's inclusion probability is proportional to its size, as far
as it stays below one: those that would reach one are certain, and the others share what is left, so that the expected
words are the rest exactly.  Each document gets a random number u, and the documents are taken in the order of
(u / (1 - u)) / (p / (1 - p)), the Pareto order, until the fixed size, counted in words, is reached.  The cut that comes
nearest to the rest is taken.  ``u`` is a hash of the row, so reruns agree; rows that are equal in id and text share it.

Scale: texts are read once, to a table of ids and sizes.  No source is ever sorted as a whole: probabilities come from the
counts of its distinct sizes; the order is mapped to (0, 1) and cut into bins whose words are summed on the map side; only
the bin of each source in which the cut falls is sorted.  Sources are first reduced to one row each.

Defined results: null text has size 0; null source is a source of its own, the last; documents of size 0 take 0; repeated
rows are separate documents; an empty table gives an empty table; further columns, whatever their names, are ignored; a
very long text is counted whole and may be certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, text_of, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: No target above this many copies of its source.
COPIES = 2
BINS = 1 << 14


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: float = COPIES) -> DataFrame:
    """``source, source_size, target`` for ``sources(source, source_size)``: one row a source.

    Shares by weight, capped at ``copies`` times the size, the excess reshared.  In order of size by weight the capped
    sources come first, so one running sum finds the level at which the others stand.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    w = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(copies)) * F.col("source_size"))
    every = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    # were this source and all after it uncapped, they'd stand at this level
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("nth", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    # the first that stays below its cap is right about the level
    final = F.min_by(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")), F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("nth"))).over(every)
    return w.withColumn("final", final).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def inclusion(sizes: DataFrame) -> DataFrame:
    """``source, size, p`` of ``sizes(source, size, n, rest)``: the inclusion probability of each of the n documents of a size.

    In order of size from the largest, the sizes that are certain come first: as many as leave the others a probability
    below one when these share what the certain ones leave, in proportion to their sizes.
    """
    by = Window.partitionBy("source").orderBy(F.desc("size"))
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size").cast("double")
    words, squares = size * F.col("n"), size * size * F.col("n")
    # were all larger sizes certain and this one not, a word of it would be in with this chance
    left = F.col("rest") - F.coalesce(F.sum(words).over(before), F.lit(0.0))
    level = F.greatest(left, F.lit(0.0)) / F.sum(squares).over(after)
    w = sizes.filter("size > 0").withColumn("level", level).withColumn("free", F.col("level") * size < 1)
    # the largest size that is not certain is right about the level
    final = F.max_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("size"))).over(Window.partitionBy("source"))
    return w.withColumn("p", F.when(F.col("rest") <= 0, 0.0).otherwise(F.least(F.coalesce(final * size, F.lit(1.0)), F.lit(1.0)))).select("source", "size", "p")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, bins: int = BINS, seed: int = 5) -> DataFrame:
    """``doc_id, size, source_size, target, p, taken, copies`` of each row of ``docs(doc_id, text, source)``.

    ``copies`` says how often the document stands in the mix; ``taken`` is its size times that; ``p`` is the inclusion
    probability for the copy beyond the whole ones.
    """
    text = text_of()
    rows = written(docs.select("doc_id", F.struct("source").alias("_s"), n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("row")), "sizes")
    counts = written(rows.groupBy("_s", "size").agg(F.count("*").alias("n")), "counts")
    goal = targets(counts.groupBy("_s.source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, copies)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(copies))).otherwise(F.lit(0)))
    goal = goal.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # null is no key of an equi-join: a struct that holds it is
    goal = goal.select(F.struct("source").alias("_s"), "source_size", "target", "whole", "rest")
    chances = inclusion(counts.join(goal, "_s").select(F.col("_s").alias("source"), "size", "n", "rest")).withColumnRenamed("source", "_s")
    sized = counts.select("_s", "size").join(chances, ["_s", "size"], "left").join(goal, "_s").withColumn("p", F.coalesce("p", F.lit(0.0)))
    joined = rows.join(sized, ["_s", "size"])
    u = _uniform(F.col("row"))
    pareto = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # q / (1 + q): the same order, in (0, 1); certain documents come first, impossible ones last
    q = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, pareto / (1 + pareto)).otherwise(1.0)
    ranked = joined.withColumn("q", q).withColumn("bin", F.floor(F.col("q") * bins).cast("int"))
    bin_words = ranked.groupBy("_s", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.sum("words").over(Window.partitionBy("_s").orderBy("bin")) - F.col("words")
    # the first bin that goes beyond the rest holds the cut, also if the bins before it make up the rest exactly
    beyond = bin_words.withColumn("before", before).filter((F.col("rest") > 0) & (F.col("before") + F.col("words") > F.col("rest")))
    cuts = beyond.groupBy("_s").agg(F.min(F.struct("bin", "before")).alias("x")).select("_s", F.col("x.bin").alias("cut_bin"), "x.before")
    marked = ranked.join(cuts, "_s", "left")
    below = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))
    keep = ["doc_id", "size", "source_size", "target", "p", "whole"]
    out = marked.filter(below | (F.col("bin") > F.col("cut_bin"))).select(*keep, F.when((F.col("rest") > 0) & below, 1).otherwise(0).alias("extra"))
    inner = Window.partitionBy("_s").orderBy("q", "doc_id", "row")
    upto = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the document that crosses the cut is in if the mix is nearer to its target with it
    near = F.col("before") + F.col("upto") - F.col("size") / 2.0 <= F.col("rest")
    edge = marked.filter(F.col("bin") == F.col("cut_bin")).withColumn("upto", upto).select(*keep, F.when(near, 1).otherwise(0).alias("extra"))
    both = out.unionByName(edge)
    taken = F.least(F.col("whole") + F.col("extra"), F.lit(copies))
    return both.select("doc_id", "size", "source_size", "target", "p", (taken * F.col("size")).cast("long").alias("taken"), taken.cast("long").alias("copies"))
