"""Near duplicates by DartMinHash signatures and banded joining.

A text's elements are its shingles of five words, weighted by how often they occur. Signatures (``darts``) of 100
coordinates give 20 bands of 5; two texts of weighted Jaccard similarity 0.8 share a band with probability 0.9996.
Buckets of a band never give all their pairs. In rounds, each bucket that still holds several classes compares its
members with its next leaders (1, then 2, 4, ...), the members that share most buckets with others; an exact check of
both whole texts decides each link, and linked classes become one. A member that the leader does not match meets the
next leaders, so texts that are joined by a chain of links come together. Buckets that still hold several classes after
seven leaders are finished exactly: their members are joined by their rarest shingles (``_rest``), one of which any two
texts of the wanted similarity share, so no pair of a bucket stays untested that could be a link.

Defined results: words are compared in lower case, so texts with the same words are copies, whatever their white space;
copies are grouped by a 128-bit hash before all else. NULL counts as empty; texts without words are copies of each
other. Repeated rows belong to the same class. The class id is the least key of the class (NULL where no member has a
key). An empty table gives an empty table. Other columns are not read, or pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm import darts
from tamis.llm.common import frugal, hidden, inputs, text_or_empty
from tamis.llm.components import components
from tamis.session import materialize

COORDINATES, ROWS, SIMILARITY = 100, 5, 0.8
LEADER_ROUNDS = 3
BLOCK_WORDS = 120_000


def _node(text: str) -> bytes:
    """The same for texts with the same words."""
    return xxhash.xxh128_digest(" ".join(text.lower().split()))


def sign(docs: DataFrame, *, key: str = "doc_id", text: str = "text", coordinates: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """One row per row: key, text_hash, node (16 bytes, the words' hash), bands (array<bigint>, empty without words)."""
    narrow = inputs(docs, key=key, text=text).select("key", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    kind = dict(narrow.dtypes)["key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = darts.WordHash()
        for batch in batches:
            column, at = batch.column(2), 0
            while at < len(column):
                nodes, sets, load, begin = [], [], 0, at
                while at < len(column) and load < BLOCK_WORDS:
                    text = column[at].as_py()
                    nodes.append(_node(text))
                    sets.append(darts.shingles(text, words))
                    load += len(sets[-1][0])
                    at += 1
                some = [i for i, s in enumerate(sets) if len(s[0])]
                bands: list = [[]] * len(sets)
                for i, row in zip(some, darts.band_hashes(darts.signatures([sets[i] for i in some], coordinates), rows)):
                    bands[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, at - begin), batch.column(1).slice(begin, at - begin), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["key", "text_hash", "node", "bands"],
                )

    return narrow.mapInArrow(frugal(scan), f"key {kind}, text_hash bigint, node binary, bands array<bigint>")


def _exact(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes whose whole texts have a weighted Jaccard similarity of ``least`` or more."""
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = darts.WordHash()
        for batch in batches:
            alike = [
                darts.similarity(darts.shingles(x.as_py(), words), darts.shingles(y.as_py(), words)) >= least for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.mapInArrow(frugal(scan), "a binary, b binary")


def _rest(still: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of nodes of different labels that may have a similarity of ``least`` or more.

    Shingles have one order, rarest first, and x is the first that two texts have in common. Then all they share lies
    from x on, so the weight from x on is in both at least the overlap that the similarity asks for. Shingles that
    come later are no keys of the join, so what a whole bucket has in common makes no pairs.
    """
    nodes = still.select("node", "label").distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = darts.WordHash()
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                ids, counts = darts.shingles(text.as_py(), words)
                row = pa.array(np.full(len(ids), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(ids.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(np.full(len(ids), int(counts.sum())))],
                    ["node", "label", "token", "weight", "total"],
                )

    found = materialize(
        nodes.join(texts, "node").select("node", "label", "text").mapInArrow(frugal(scan), "node binary, label binary, token bigint, weight bigint, total bigint"), "tokens"
    )
    often = found.groupBy("token").agg(F.count(F.lit(1)).alias("often"), (F.min("label") < F.max("label")).alias("mixed"))
    ahead = F.sum("weight").over(Window.partitionBy("node").orderBy("often", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    keyed = found.join(often, "token").withColumn("onward", F.col("total") - ahead)
    keyed = materialize(keyed.where(F.col("mixed") & (F.col("onward") >= least * F.col("total") - 1e-6)).select("token", "node", "label", "total", "onward"), "prefixes")
    other = keyed.select("token", *[F.col(n).alias(f"{n}_b") for n in ("node", "label", "total", "onward")])
    enough = F.least("onward", "onward_b") * (1 + least) >= (F.col("total") + F.col("total_b")) * least - 1e-6
    pairs = keyed.join(other, (keyed["token"] == other["token"]) & (F.col("node") < F.col("node_b")) & (F.col("label") != F.col("label_b")) & enough)
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, popularity) for buckets of several nodes; of buckets with the same nodes one stays."""
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), F.col("node"))).alias("y")
    )
    sizes = materialize(sizes.where("n > 1"), "sizes")
    shared = materialize(placed.join(sizes.select("bucket", "n"), "bucket"), "buckets")
    popularity = shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("popularity"))
    kept = sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return materialize(shared.drop("n").join(kept, "bucket").join(popularity, "node"), "popular")


def near_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, coordinates: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: key, text_hash, label (16 bytes, names the class), class_id, class_size (rows)."""
    signed = materialize(sign(docs, key=key, text=text, coordinates=coordinates, rows=rows), "signed")
    # copies have the same bands, so any row of a node stands for it
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"), F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), "text_hash")).alias("at"))
    nodes = materialize(nodes, "nodes")
    members = _buckets(nodes)
    labels = materialize(members.select("node").distinct().withColumn("label", F.col("node")), "labels")
    own = hidden("key", "hash")
    wanted = nodes.join(labels.select("node"), "node", "left_semi").select("node", F.col("at.key").alias("key"), F.col("at.text_hash").alias("text_hash"))
    rows_of = inputs(docs, key=key, text=text).select("key", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    found = rows_of.join(wanted.withColumnsRenamed({"key": own["key"], "text_hash": own["hash"]}), F.col("key").eqNullSafe(F.col(own["key"])) & (F.col("text_hash") == F.col(own["hash"])))
    texts = materialize(found.select("node", "text").dropDuplicates(["node"]), "texts")
    tried, leaders, passed = None, 1, 0
    for turn in range(LEADER_ROUNDS + 1):
        now = members.join(labels, "node")
        open_buckets = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        still = materialize(now.join(open_buckets, "bucket", "left_semi"), "open")
        if still.isEmpty():
            break
        if turn < LEADER_ROUNDS:
            by_rank = Window.partitionBy("bucket").orderBy(F.desc("popularity"), "node")
            first = still.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= passed + leaders).where(F.col("rank") > passed)
            lead = first.select("bucket", F.col("node").alias("leader"), F.col("label").alias("leader_label"))
            pairs = still.join(lead, "bucket").where("label <> leader_label").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        else:
            pairs = _rest(still, texts, similarity)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        links = materialize(_exact(pairs, texts, similarity), "links")
        if not links.isEmpty():
            edges = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("u")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("v")), "b")
            roots = components(edges.select("u", "v")).select(F.col("node").alias("label"), F.col("label").alias("root"))
            labels = materialize(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        tried = pairs if tried is None else tried.unionByName(pairs)
        passed, leaders = passed + leaders, leaders * 2
    labelled = signed.select("key", "text_hash", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return labelled.join(classes, "label").select("key", "text_hash", "label", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that of the least key; all columns as they are.

    Of rows with the same key in one class, the one with the least text hash stays, and of equal rows one.
    """
    found = materialize(near_classes(docs, key=key, text=text, similarity=similarity).where("class_size > 1"), "classes")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("text_hash").alias("text_hash"))
    kept = found.groupBy("label").agg(F.min(order).alias("kept"))
    marked = found.join(kept, "label").withColumn("stays", order.eqNullSafe(F.col("kept")))
    own = hidden("key", "hash")
    names = {"key": own["key"], "text_hash": own["hash"]}
    gone = marked.where("NOT stays").select("key", "text_hash").distinct().withColumnsRenamed(names)
    twice = materialize(marked.where("stays").groupBy("key", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").withColumnsRenamed(names), "twice")
    same = lambda other: docs[key].eqNullSafe(other[own["key"]]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == other[own["hash"]])
    rest = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return rest
    repeated = docs.join(twice, same(twice), "left_semi").dropDuplicates([key, text])
    return rest.join(twice, same(twice), "left_anti").unionByName(repeated)
