"""Line dedup by distinct-site spread, in DataFrame functions only.

A line that many different sites carry is boilerplate, however often it occurs; a line that one site repeats is not.
Per line hash a HyperLogLog sketch of its sites is built by (partial, mergeable) aggregation. Lines whose estimate
clears the threshold by more than the sketch's error bound are decided by the estimate; lines near the threshold get
exact distinct counts. Boilerplate lines are then removed from every text.

Defined results: NULL and empty texts have no lines and stay as they are. A line is compared with outer blanks
trimmed; blank lines are never boilerplate. A NULL site counts as one site of its own. Repeated rows change nothing,
since sites are counted once. A text all of whose lines are boilerplate becomes empty; its row stays. An empty table
gives an empty table. Columns other than key, text and site are carried along untouched by ``drop_boilerplate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import hidden, inputs, text_or_empty
from tamis.session import materialize

MIN_SITES = 10
LG_K = 10  # 1024 registers


def _plain(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _digest(plain: Column) -> list[Column]:
    """Two 64-bit hashes, so that collisions stay out of reach for any corpus."""
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit("line"), plain).alias("h2")]


def lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per non-blank line: key, text_hash, site, position (from 0), h1, h2."""
    narrow = inputs(docs, key=key, text=text, site=site)
    cut = narrow.select(
        "key",
        F.xxhash64(text_or_empty()).alias("text_hash"),
        F.coalesce(F.col("site").cast("string"), F.lit("\0")).alias("site"),
        F.posexplode(F.split(text_or_empty(), "\n")).alias("position", "line"),
    ).withColumn("line", _plain(F.col("line")))
    return cut.where("line <> ''").select("key", "text_hash", "site", "position", *_digest(F.col("line")))


def spread(found: DataFrame, *, lg_k: int = LG_K) -> DataFrame:
    """Estimated distinct sites per line hash. Sketches of tasks merge; no line's rows meet in one task."""
    sketch = F.hll_sketch_agg("site", lg_k)
    return found.groupBy("h1", "h2").agg(F.hll_sketch_estimate(sketch).alias("estimate"))


def boilerplate(found: DataFrame, *, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, sites) of lines on at least ``min_sites`` sites; ``sites`` is exact where the estimate is near."""
    margin = 3 * 1.04 / 2 ** (lg_k / 2)  # three relative standard errors of a sketch
    # a line can be on no more sites than it has rows, so rarer lines need no sketch
    often = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    often = materialize(often, "often")
    estimates = spread(found.join(often, ["h1", "h2"], "left_semi"), lg_k=lg_k)
    estimates = materialize(estimates.where(F.col("estimate") >= min_sites * (1 - margin)), "spread")
    clear = estimates.where(F.col("estimate") > min_sites * (1 + margin)).select("h1", "h2", F.col("estimate").alias("sites"))
    near = estimates.where(F.col("estimate") <= min_sites * (1 + margin)).select("h1", "h2")
    exact = (
        found.join(near, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("one").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return clear.unionByName(exact)


def drop_boilerplate(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, report: bool = False
) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``; all other columns as they are.

    With ``report`` two columns come last: lines_before, and removed_lines (positions from 0).
    """
    found = materialize(lines(docs, key=key, text=text, site=site), "lines")
    marked = materialize(boilerplate(found, min_sites=min_sites, lg_k=lg_k), "boilerplate")
    own = hidden("key", "hash", "removed", "lines", "text_hash", "null")
    removed = (
        found.join(marked, ["h1", "h2"], "left_semi")
        .groupBy(F.col("key").alias(own["key"]), F.col("text_hash").alias(own["hash"]))
        .agg(F.array_sort(F.collect_set("position")).alias(own["removed"]))
    )
    # lines travel as an array, so that taking them by position below does not split the text again
    work = docs.withColumns({own["lines"]: F.split(text_or_empty(text), "\n"), own["text_hash"]: F.xxhash64(text_or_empty(text)), own["null"]: F.col(text).isNull()}).drop(text)
    joined = work.join(removed, work[key].eqNullSafe(removed[own["key"]]) & (F.col(own["text_hash"]) == F.col(own["hash"])), "left")
    gone, cut = F.col(own["removed"]), F.col(own["lines"])
    count = F.size(cut)
    staying = F.array_except(F.sequence(F.lit(0), count - 1), gone)
    kept = F.when(gone.isNull(), cut).otherwise(F.transform(staying, lambda i: F.get(cut, i)))
    columns = [F.col(c) if c != text else F.when(F.col(own["null"]), F.lit(None)).otherwise(F.array_join(kept, "\n")).alias(text) for c in docs.columns]
    told = [count.alias("lines_before"), F.coalesce(gone, F.array().cast("array<int>")).alias("removed_lines")]
    return joined.select(*columns, *(told if report else []))
