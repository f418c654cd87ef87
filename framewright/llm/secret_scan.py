"""Secret scans with corpus-wide ownership frequency.  DataFrame functions only.

1. Each text is scanned for each kind; a match is a row, and running sums of the gaps and matches before it place it.
2. The secret value of each candidate is hashed; for each hash the distinct repositories and the distinct owners in the
   whole corpus are counted, after pre-aggregation on the map side.
3. A value that more than a few owners hold is a copied example; a value of few owners that looks random is specific to
   them and taken for live.  ``opaque`` candidates (long mixed strings that no base pattern covers) become spans only if they are so.

Defined results: null text is empty and has no spans; a null repository or owner counts as one value of its own; repeated
rows each get the row's result; an empty table gives an empty table; clashing further columns are not looked at.  A very
long text is scanned whole, in time linear in its length and matches; its spans are one row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_of, written

#: The base patterns; their order breaks ties of start.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of this alphabet that are long and mixed are candidates of the method's own kind.
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
#: Equal to dropping the shorter matches afterwards, as these patterns match whole runs; spares building the short ones.
_ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
_HEX_LONG = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Values held by more owners, or more repositories of one owner, than this are widely copied.
MAX_OWNERS = 2
MAX_REPOS = 20
#: Values that one row in so many holds, or more, don't meet by hash: they are so many at most, and broadcast.
HOT = 1000


def _found(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<struct<kind, rank, gap, n, value>>: the leftmost non-overlapping matches in order, each with the length of the
    gap before it and its own; ``value`` is null if it is shorter than ``least``.

    Lengths only: where a match starts is the sum of all before it, which :func:`placed` makes of the rows.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    each = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    rank = F.lit(KINDS.index(kind)).alias("rank")
    one = lambda x: F.struct(F.lit(kind).alias("kind"), rank, F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("n"), F.when(F.length(x["value"]) >= least, x["value"]).alias("value"))
    empty = F.array().cast("array<struct<kind:string,rank:int,gap:int,n:int,value:string>>")
    # the last gap has no match behind it
    return F.when(text.rlike(pattern), F.filter(F.transform(each, one), lambda x: x["n"].isNotNull())).otherwise(empty)


def _mixed(value: Column) -> Column:
    """Digits, capitals and small letters together: what generated credentials look like and words don't."""
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _random(kind: Column, value: Column) -> Column:
    """Whether a value looks generated: keys and long hex do, mixed ones do, and long assigned ones of letters and digits."""
    assigned = (kind == "assign") & (F.length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return kind.isin("access", "hex") | _mixed(value) | assigned


def matches(text: Column) -> Column:
    """All matches of a text, kind by kind in order, as :func:`_found` has them."""
    base = [_found(text, "assign", ASSIGN, 2, 6), _found(text, "access", _ACCESS_LONG), _found(text, "hex", _HEX_LONG)]
    return F.concat(*base, _found(text, "opaque", OPAQUE))


def placed(found: DataFrame, *keys: str) -> DataFrame:
    """``keys, start, end, kind, rank, hash, random`` of the candidates of ``found(keys, c)``, ``c`` being the matches of a text.

    A match is a row, and where it starts is a running sum over its text's rows of that kind: the time is linear in the
    matches of a text, however many it has.  One exchange, by text and kind, serves both steps; rows that are equal in all
    keys have one result.
    """
    each = found.select(*keys, F.posexplode("c").alias("pos", "x")).select(*keys, "pos", "x.kind", "x.rank", "x.gap", "x.n", "x.value")
    kept = F.col("value").isNotNull() & ((F.col("kind") != "opaque") | _mixed(F.col("value")))
    each = each.select(*keys, "pos", "kind", "rank", "gap", "n", F.when(kept, F.sha2("value", 256)).alias("hash"), F.when(kept, _random(F.col("kind"), F.col("value"))).alias("random"))
    by = [*keys, "kind", "rank"]
    once = each.repartition(*by).groupBy(*by, "pos").agg(*[F.first(c).alias(c) for c in ("gap", "n", "hash", "random")])
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return once.withColumn("end", end.cast("int")).filter(F.col("hash").isNotNull()).select(*keys, (F.col("end") - F.col("n")).alias("start"), "end", "kind", "rank", "hash", "random")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners, n_rows``: how many distinct repositories and owners hold each value of ``found(hash, repo, owner)``.

    Each count runs over distinct pairs, so a value that a third of all rows holds is one row a task in the last shuffle.
    """
    def distinct(col: str, name: str) -> DataFrame:
        pairs = found.groupBy("hash", F.struct(col).alias("_x")).agg(F.count("*").alias("_n"))
        return pairs.groupBy("hash").agg(F.count("_x").alias(name), F.sum("_n").alias("n_rows"))

    return distinct("repo", "n_repos").join(distinct("owner", "n_owners").drop("n_rows"), "hash")


def judged(hit: DataFrame, most: int = HOT) -> DataFrame:
    """``hit(hash, repo, owner, ...)`` with ``n_repos`` and ``n_owners`` of each row's value.

    A value that very many rows hold is not brought to one task: those that hold at least one row in ``most`` are ``most``
    at most, which bounds what is broadcast; all others meet by hash.
    """
    owned = written(ownership(hit), "owned")
    share = owned.agg(F.sum("n_rows").alias("n")).select(F.ceil(F.col("n") / most).alias("n")).first()[0] or 1
    hot = F.broadcast(owned.filter(F.col("n_rows") >= share).drop("n_rows")) if share > 1 else None
    if hot is None:  # fewer rows than the bound
        return hit.join(F.broadcast(owned.drop("n_rows")), "hash")
    cold = hit.join(hot.select("hash"), "hash", "left_anti").join(owned.filter(F.col("n_rows") < share).drop("n_rows"), "hash")
    return cold.unionByName(hit.join(hot, "hash"))


def secret_scan(docs: DataFrame, key: str = "doc_id", repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """For each row of ``docs``: ``key``, ``spans`` and the hash of the text.

    ``spans`` is an array of struct(start, end, kind, value_sha256, n_repos, n_owners, live), by start, then kind; starts
    and ends are code points of the text.  ``live``: held by at most ``max_owners`` owners and ``max_repos`` repositories,
    and random to look at.  Spans of the kind ``opaque`` are there only if live.
    """
    text = text_of()
    scanned = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.col(repo).alias("repo"), F.col(owner).alias("owner"), matches(text).alias("c"))
    hit = written(placed(scanned.filter(F.size("c") > 0), "_key", "_text", "repo", "owner"), "secret-candidates")
    live = F.col("random") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    told = judged(hit).withColumn("live", live).filter((F.col("kind") != "opaque") | F.col("live"))
    entry = F.struct("start", "rank", "end", "kind", F.col("hash").alias("value_sha256"), "n_repos", "n_owners", "live")
    spans = told.groupBy("_key", "_text").agg(F.array_sort(F.collect_set(entry)).alias("spans"))
    rows = docs.select(F.col(key), F.xxhash64(text).alias("_t"))
    return rows.join(spans, rows[key].eqNullSafe(spans["_key"]) & (rows["_t"] == spans["_text"]), "left").select(
        rows[key], F.col("_t").alias("text_hash"), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans")
    )


def _pieces(text: Column, runs: Column) -> Column:
    """array<string>: the texts before each of ``runs(start, end)``, which are in order and apart, and behind the last.

    ``substring`` walks from the text's beginning, so the text is cut in as many parts as each has runs, and these in
    their pieces: a text of n characters with m runs takes about n * sqrt(m) steps and not n * m.
    """
    size = F.ceil(F.sqrt(F.size(runs))).cast("int")
    none = F.array().cast("array<struct<start:int,end:int>>")
    nth = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(runs) / size).cast("int") - 1, F.lit(0)))
    at = lambda j: F.when(j > 0, F.try_element_at(runs, j * size)["end"]).otherwise(F.lit(0))  # noqa: E731  where part j begins

    def part(j: Column) -> Column:
        some = F.when(F.size(runs) > 0, F.slice(runs, j * size + 1, size)).otherwise(none)
        whole = F.struct(F.substring(text, at(j) + 1, F.element_at(some, -1)["start"] - at(j)).alias("t"), at(j).alias("at"), some.alias("runs"))
        ends = lambda w: F.concat(F.array(w["at"]), F.transform(F.slice(w["runs"], 1, F.size(w["runs"]) - 1), lambda r: r["end"]))
        cut = lambda w: F.zip_with(ends(w), w["runs"], lambda a, r: F.substring(w["t"], a - w["at"] + 1, r["start"] - a))
        return F.element_at(F.transform(F.array(whole), cut), 1)

    last = F.substring(text, F.element_at(runs, -1)["end"] + 1, F.length(text))
    return F.concat(F.flatten(F.transform(nth, part)), F.array(last))


def redacted(docs: DataFrame, scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each run of live spans of ``scanned`` replaced by ``mark``; all columns stay, ``n_chars`` follows the text.

    Live spans that overlap are one run; those that only touch are two.
    """
    i, h, found = fresh(docs, "_id", "_h", "_live")
    live = scanned.select("doc_id", "text_hash", F.filter("spans", lambda s: s["live"]).alias("s")).filter(F.size("s") > 0)
    each = live.select("doc_id", "text_hash", F.explode("s").alias("s")).select("doc_id", "text_hash", "s.start", "s.end")
    by = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = each.withColumn("_new", F.when(F.col("start") >= F.coalesce(before, F.lit(0)), 1).otherwise(0))
    run = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = new.withColumn("_run", run).groupBy("doc_id", "text_hash", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    hits = runs.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(found))
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits[i]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hits[h]), "left")
    text = F.array_join(_pieces(F.col("text"), F.col(found)), mark)
    out = joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
