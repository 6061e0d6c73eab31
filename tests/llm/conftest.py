import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
NEAR = [f"token{i}" for i in range(120)]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *[T.StructField(n, T.StringType()) for n in ("key", "label", "node", "bucket", "text_hash", "slice", "tie", "print", "shard", "size", "line", "score", "removed_lines", "file", "__lines", "__key", "__hash", "__spans", "__removed", "__null")],
    ]
)


def rows():
    texts = {
        1: "Plain words of a first text, which has a few more words than five.\nShared line of all sites.",
        2: None,
        3: "",
        4: "one",
        5: "  blanks   and\n\n\nempty lines\t\n ",
        6: LONG,
        7: PASSAGE + "\nOwn end.",
        8: "Own start.\n" + PASSAGE.upper(),
        9: " ".join(NEAR),
        10: " ".join([*NEAR[:60], "changed", *NEAR[61:]]),
        11: "Plain words of a first text, which has a few more words than five.\nShared line of all sites.",
        12: "naïve Ünïcode ßtraße 日本語 \U0001f600 é   end",
        -5: "a negative id and some more words than five",
    }
    out = [(k, t) for k, t in texts.items()]
    out += [(7, texts[7]), (7, texts[7]), (None, "a row without id, of more than five words"), (None, None), (20, "same id twice, first of two"), (20, "same id twice, second of two")]
    return [(k, t, "en", None if k == 5 else f"src{i % 3}", len(t or ""), *["x"] * 20) for i, (k, t) in enumerate(out)]


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and very long texts, ties, repeated rows and extra columns."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, F.col("source")).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()
