"""Substring dedup by hashing lines, paragraphs or the sentences inside lines.

Every text is cut into units, each unit is normalised (lower case, runs of white space as one space, trimmed) and
hashed, digests are grouped over the whole corpus, and all occurrences but the earliest are removed. Spans keep their
offsets in the original text, so the removal can be replayed or undone.

No unit is too short to be hashed. What is asked is that a run of adjacent repeated units is long: a copied passage
seldom starts and ends with a unit, so the units on both sides of a run close it, and run and closing units together must
have ``RUN_WORDS`` words. Short units repeat by chance; at least ``SAME_WORDS`` words of the run must therefore be copies
of units that stand in one other place in the same order. Only then do the repeated units of the run go.

Defined results: NULL, empty and blank texts have no units. Units of rows that agree in key and text have the same rank,
so neither row loses to the other. A NULL key ranks after all other keys; of one key, texts rank by a hash. An empty table
gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import frugal, hidden, inputs, text_or_empty
from tamis.session import materialize

_SPACE = re.compile(r"[ \t\r\f\v\n]+")
_UNITS = {"sentence": re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"), "line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t\r]*\n))+")}
RUN_WORDS, SAME_WORDS = 50, 15
_COLUMNS = {"key": None, "text_hash": "bigint", "nth": "int", "start": "bigint", "end": "bigint", "words": "int", "before": "int", "after": "int", "digest": "binary"}


def cut(text: str, unit: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of each unit that is not blank, in code points; the span has no outer white space."""
    for found in _UNITS[unit].finditer(text):
        piece = found.group()
        words = _SPACE.split(piece.lower())
        plain = " ".join(w for w in words if w)
        if plain:
            lead = len(piece) - len(piece.lstrip(" \t\r\f\v\n"))
            yield found.start() + lead, found.start() + len(piece.rstrip(" \t\r\f\v\n")), plain


def units(docs: DataFrame, *, key: str = "doc_id", text: str = "text", unit: str = "sentence") -> DataFrame:
    """One row per unit: key, text_hash, nth (from 0), start, end (code points, end exclusive), words, words of the units
    before and after, digest (16 bytes)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nth, spans, counts, before, after, digests = [], [], [], [], [], [], []
            for row, value in enumerate(batch.column(2)):
                own = list(cut(value.as_py(), unit))
                sizes = [0, *(plain.count(" ") + 1 for _, _, plain in own), 0]
                rows += [row] * len(own)
                nth += range(len(own))
                spans += own
                before += sizes[:-2]
                counts += sizes[1:-1]
                after += sizes[2:]
                digests += [hashlib.md5(plain.encode(), usedforsecurity=False).digest() for _, _, plain in own]
            at = pa.array(rows, pa.int64())
            numbers = [pa.array([x[i] for x in spans], pa.int64()) for i in (0, 1)]
            small = [pa.array(x, pa.int32()) for x in (nth, counts, before, after)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), small[0], *numbers, *small[1:], pa.array(digests, pa.binary())], list(_COLUMNS)
            )

    narrow = inputs(docs, key=key, text=text).select("key", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    kind = dict(narrow.dtypes)["key"]
    return narrow.mapInArrow(frugal(scan), ", ".join(f"`{n}` {t or kind}" for n, t in _COLUMNS.items()))


def repeated_spans(docs: DataFrame, *, run_words: int = RUN_WORDS, same_words: int = SAME_WORDS, **options) -> DataFrame:
    """One row per span to remove: key, text_hash, start, end, digest, kept_key, kept_start, copies.

    The earliest occurrence by (key, start) stays. Grouping uses partial aggregation, so a unit that a third of all
    documents hold costs one row per task; the way back is a plain equi-join, which Spark splits where it is skewed.
    Runs are found among the repeated units of one document.
    """
    found = materialize(units(docs, **options), "units")
    rank = F.struct(F.col("key").isNull().alias("last"), *[F.col(n).alias(n) for n in ("key", "text_hash", "start", "nth")])
    groups = found.groupBy("digest").agg(F.min(rank).alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = found.join(groups, "digest").withColumn("loses", ~rank.eqNullSafe(F.col("kept")))
    document = [F.col("key"), F.col("text_hash")]
    # a repeated row has each unit twice at the same place
    placed = again.withColumn("run", F.col("nth") - F.dense_rank().over(Window.partitionBy(*document).orderBy("nth")))
    run = Window.partitionBy(*document, "run")
    ends = F.struct("nth", "before"), F.struct("nth", "after")
    long = F.sum("words").over(run) + F.min(ends[0]).over(run)["before"] + F.max(ends[1]).over(run)["after"]
    source = Window.partitionBy(*document, "run", "kept.key", "kept.text_hash", F.col("kept.nth") - F.col("nth"))
    in_order = F.sum(F.when(F.col("loses"), F.col("words")).otherwise(0)).over(source)
    judged = placed.withColumns({"long": long, "in_order": in_order}).withColumn("in_order", F.max("in_order").over(run))
    return judged.where(F.col("loses") & (F.col("long") >= run_words) & (F.col("in_order") >= same_words)).select(
        "key", "text_hash", "start", "end", "digest", F.col("kept.key").alias("kept_key"), F.col("kept.start").alias("kept_start"), "copies"
    )


def remove_spans(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of ``text`` and their offsets in ``removed_spans`` (array of start, end; NULL if none).

    Spans belong to a key and a text, so rows of one key with other texts keep theirs.
    """
    mine = hidden("key", "hash", "spans")
    lists = spans.groupBy(F.col("key").alias(mine["key"]), F.col("text_hash").alias(mine["hash"])).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(mine["spans"]))
    same = docs[key].eqNullSafe(lists[mine["key"]]) & (F.xxhash64(text_or_empty(text)) == lists[mine["hash"]])
    joined = docs.join(lists, same, "left").drop(mine["key"], mine["hash"])
    places = F.col(mine["spans"])
    # the kept pieces lie between the end of one span and the start of the next
    pieces = F.zip_with(
        F.concat(F.array(F.lit(0).cast("bigint")), places["end"]),
        F.concat(places["start"], F.array(F.length(text).cast("bigint"))),
        lambda begin, stop: F.substring(F.col(text), (begin + 1).cast("int"), (stop - begin).cast("int")),
    )
    cut_text = F.when(places.isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    return joined.withColumns({text: cut_text, "removed_spans": places}).drop(mine["spans"])
