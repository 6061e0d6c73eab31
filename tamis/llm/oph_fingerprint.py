"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once. The leading bits of the hash name one of 256 bins, and each bin keeps its
least hash. An empty bin borrows from a full one that its own probe sequence names, the same for every document
(optimal densification), so equality of bins stays an unbiased vote on the resemblance. Of each bin only the low four
bits are stored, packed into 16 longs; two unlike bins then agree once in 16, which ``likeness`` corrects for.

Defined results: NULL counts as empty. A text of one to four words has one shingle, all its words. A text without words
has the fingerprint "" (no bins); two such are alike by 1, one such and another by 0. Equal texts have equal
fingerprints. Words are separated by white space and compared as they are. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import inputs, text_or_empty

BINS, BITS, SHINGLE = 256, 4, 5
PROBES = 12
_BELOW = 2**56 - 1  # the bits of a hash below its bin


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array of 16 longs, or an empty array for a text without words."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    step = df.withColumn("__words", words)
    n = F.size("__words")
    shingle = lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(SHINGLE)])
    # one largest value per bin marks bins that nothing fills, and puts all bins in place after the sort
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.shiftleft(j.cast("bigint"), 56).bitwiseOR(F.lit(_BELOW)))
    hashes = (
        F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), shingle))
        .when(n > 0, F.array(F.xxhash64("__words")))
        .otherwise(F.array().cast("array<bigint>"))
    )
    step = step.withColumn("__some", n > 0).withColumn("__sorted", F.sort_array(F.concat(hashes, marks))).drop("__words")
    bin_of = lambda h: F.shiftright(h, 56)
    least = F.filter(F.col("__sorted"), lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col("__sorted"), i - 1))))
    step = step.withColumn("__least", least).drop("__sorted")
    full = lambda h: h.bitwiseAND(F.lit(_BELOW)) != F.lit(_BELOW)
    code = lambda h: h.bitwiseAND(F.lit(2**BITS - 1)).cast("int")
    step = step.withColumn("__full", F.filter(F.transform(F.col("__least"), lambda h, j: F.when(full(h), F.struct(j.alias("j"), code(h).alias("c")))), lambda x: x.isNotNull()))

    def borrowed(j: Column) -> Column:
        def probe(found: Column, t: Column) -> Column:
            other = F.get(F.col("__least"), F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int"))
            return F.when(found >= 0, found).when(full(other), code(other)).otherwise(F.lit(-1))

        quick = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), F.lit(-1), probe)
        # where few bins are full, the probe sequence goes on as a permutation of all bins
        rest = F.array_min(F.transform(F.col("__full"), lambda x: F.struct(F.xxhash64(j, F.lit(0), x["j"]).alias("h"), x["c"].alias("c"))))["c"]
        return F.aggregate(F.array(quick), F.lit(0), lambda _, q: F.when(q >= 0, q).otherwise(rest))

    codes = F.transform(F.col("__least"), lambda h, j: F.when(full(h), code(h)).otherwise(borrowed(j)))
    step = step.withColumn("__codes", F.when(F.col("__some"), codes))
    per_long = 64 // BITS
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // per_long - 1)),
        lambda k: F.aggregate(
            F.slice(F.col("__codes"), k * per_long + 1, F.lit(per_long)), F.lit(0).cast("bigint"), lambda acc, c: F.shiftleft(acc, BITS).bitwiseOR(c.cast("bigint"))
        ),
    )
    return step.withColumn(out, F.when(F.col("__codes").isNotNull(), packed).otherwise(F.array().cast("array<bigint>"))).drop("__some", "__least", "__full", "__codes")


def as_text(fingerprint: Column) -> Column:
    """256 hexadecimal digits, one per bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1, with the chance agreement of short codes taken out."""

    def equal_codes(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.lit(64 // BITS) - F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    agree = F.aggregate(F.zip_with(a, b, equal_codes), F.lit(0), lambda s, v: s + v) / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


def _slices(docs: DataFrame) -> list[int]:
    """Lower ends of range slices of the keys, from Spark's own range partitioning of the keys alone."""
    count = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("key").where("key IS NOT NULL").repartitionByRange(count, "key")
    ends = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("low")).collect()
    return sorted({r["low"] for r in ends})[1:]


def _slice_of(key: Column, lows: list[int]) -> Column:
    """Number of lower ends at or below the key, looked up in two steps."""
    if not lows:
        return F.lit(0)
    side = int(len(lows) ** 0.5) + 1
    tops = F.array(*[F.lit(x) for x in lows[::side]])
    all_lows = F.array(*[F.lit(x) for x in lows])
    chunk = F.size(F.filter(tops, lambda x: x <= key))
    inside = F.size(F.filter(F.slice(all_lows, (chunk - 1) * side + 1, F.lit(side)), lambda x: x <= key))
    return F.when(key.isNull() | (chunk == 0), F.lit(0)).otherwise((chunk - 1) * side + inside)


def followed(docs: DataFrame) -> DataFrame:
    """Each row (key, text, print) with the text and print of the next row, descending key; the last meets the first.

    Rows are dealt once, by range slices of the key. The first row of every slice is also dealt to the slice that ends
    before it, so no other exchange of texts is needed. Equal keys are ordered by a hash of the text.
    """
    rows = docs.withColumn("tie", F.xxhash64("text")).withColumn("slice", _slice_of(F.col("key"), _slices(docs)))
    # first row of each slice; one row per slice comes to the driver, to name the slice before it that has rows
    first = rows.groupBy("slice").agg(F.max(F.struct(F.col("key").isNotNull().alias("known"), "key", "tie")).alias("head")).collect()
    ring = sorted(first, key=lambda r: -r["slice"])
    named = [(r["head"]["key"], r["head"]["tie"], ring[i - 1]["slice"]) for i, r in enumerate(ring)]
    wanted = docs.sparkSession.createDataFrame(named, f"head_key {dict(docs.dtypes)['key']}, head_tie bigint, slice int")
    extras = (
        rows.drop("slice")
        .join(F.broadcast(wanted), F.col("key").eqNullSafe(F.col("head_key")) & (F.col("tie") == F.col("head_tie")))
        .dropDuplicates(["slice"])
        .withColumn("extra", F.lit(True))
    )
    dealt = rows.withColumn("extra", F.lit(False)).select("key", "text", "tie", "slice", "extra")
    both = with_fingerprint(dealt.unionByName(extras.select(*dealt.columns)), "text", "print")
    along = Window.partitionBy("slice").orderBy("extra", F.desc_nulls_last("key"), F.desc("tie"))
    return both.withColumns({"next_text": F.lead("text").over(along), "next_print": F.lead("print").over(along)}).where(~F.col("extra"))


def edited_prints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text beside its edited text, whose last half of code points gives way to the start of the next text.

    Columns: key, n_chars, edited (text), print, edited_print, next_print.
    """
    pairs = followed(inputs(docs, key=key, text=text).withColumn("text", text_or_empty()))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.select("key", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    return with_fingerprint(made, "edited", "edited_print")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and print (packed longs) of every text."""
    return with_fingerprint(inputs(docs, key=key, text=text).withColumn("text", text_or_empty()), "text", "print").select("key", "print")
