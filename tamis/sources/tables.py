"""Readers for the sources of a workflow. All are lazy and take an explicit schema where possible."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.functions.scalars import col, glob_regex

Schema = StructType | str

# Upload formats and the mark of a validated form submission.
UPLOAD_FORMATS = ("CSV", "PARQUET", "JSONL")
VALIDATED = "validated"


def safe_predicate(predicate: str) -> str:
    """A WHERE condition from a definition: statement ends and comments are refused."""
    if ";" in predicate or "--" in predicate:
        raise ValueError("a predicate may contain neither ';' nor '--'")
    return predicate


def jdbc_table(
    spark: SparkSession,
    url: str,
    schema: str,
    table: str,
    predicate: str | None = None,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table over JDBC, read in ``partitions`` ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, schema, table, partition_column, bounds, partitions))
    df = reader.options(**dict(options or {})).load()
    return df.where(F.expr(safe_predicate(predicate))) if predicate else df


def jdbc_options(
    url: str, schema: str, table: str, partition_column: str | None, bounds: tuple | None, partitions: int
) -> dict[str, str]:
    options = {"url": url, "dbtable": f"{schema}.{table}", "fetchsize": "10000", "pushDownPredicate": "true"}
    if partition_column:
        if not bounds:
            raise ValueError("a partitioned read needs the bounds of its column")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def upload(spark: SparkSession, path: str, format: str, schema: Schema | None = None) -> DataFrame:
    """An uploaded file or folder: CSV with header, Parquet, or one JSON document per line."""
    kind = format.upper()
    if kind not in UPLOAD_FORMATS:
        raise ValueError(f"upload format '{format}' is not supported")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "PARQUET":
        return reader.parquet(path)
    if kind == "JSONL":
        return reader.json(path)
    if schema is None:
        reader = reader.option("inferSchema", "true")
    return reader.csv(path, header=True, multiLine=False)


def form_submissions(
    spark: SparkSession, path: str, schema: Schema, validated_only: bool = True, status: str = "validation_status_id"
) -> DataFrame:
    """Landed form submissions, one JSON per line ``{"validation_status_id": ..., "rec": {...}}``.

    The record is flattened next to the status; by default only validated ones are kept.
    """
    raw = spark.read.schema(schema).json(path)
    kept = raw.where(col(status) == VALIDATED) if validated_only else raw
    return kept.select(*[col(c) for c in raw.columns if c != "rec"], "rec.*")


def survey_responses(spark: SparkSession, path: str, questions: list[str]) -> DataFrame:
    """Landed survey answers as one row per response, one column per listed question.

    Lines are ``{"response_id", "answers": [{"question", "answer"}]}``; a response may come in
    several lines. Several answers to one question (multiple choice, corrections) are all kept, as
    distinct texts in order, joined by ``; ``. The answers of one response are one row of the result.
    """
    raw = spark.read.schema("response_id string, answers array<struct<question:string,answer:string>>").json(path)
    given = raw.select("response_id", F.explode_outer("answers").alias("a"))
    answers = {q: F.array_sort(F.collect_set(F.when(F.col("a.question") == q, F.col("a.answer")))) for q in questions}
    picks = [F.when(F.size(found) > 0, F.array_join(found, "; ")).alias(q) for q, found in answers.items()]
    return given.groupBy("response_id").agg(*picks)


def keyed_snapshots(table: DataFrame, pattern: str, schema: Schema, key: str = "key", value: str = "value") -> DataFrame:
    """Rows of a dumped key/value table whose key matches the glob, with the JSON value decoded."""
    prefix = pattern
    for mark in "*?[":
        prefix = prefix.split(mark)[0]
    found = table.where(col(key).startswith(prefix)) if prefix else table
    found = found.where(col(key).rlike(glob_regex(pattern)))
    return found.select(col(key).alias("key"), F.from_json(col(value), schema).alias("__v")).select("key", "__v.*")


def topic_options(servers: str, topic: str, group: str, from_beginning: bool = False) -> dict[str, str]:
    """Options of Spark's Kafka source for a topic of a Kafka-compatible broker."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "kafka.group.id": group,
        "startingOffsets": "earliest" if from_beginning else "latest",
        "failOnDataLoss": "true",
    }


def topic_batch(spark: SparkSession, servers: str, topic: str, group: str, schema: Schema) -> DataFrame:
    """All messages of a topic so far; a batch read always starts at the beginning."""
    raw = spark.read.format("kafka").options(**topic_options(servers, topic, group, True)).load()
    return decode_messages(raw, schema)


def decode_messages(raw: DataFrame, schema: Schema) -> DataFrame:
    """JSON message values as columns, with the key and the broker's time."""
    body = F.from_json(F.col("value").cast("string"), schema)
    return raw.select(F.col("key").cast("string").alias("message_key"), F.col("timestamp").alias("message_time"), body.alias("__v")).select(
        "message_key", "message_time", "__v.*"
    )


def golden_dataset(spark: SparkSession, registry: DataFrame, sub_project: str, name: str, digest: str | None = None) -> DataFrame:
    """A registered frozen dataset, refused when rows, schema or (if given) content differ.

    ``registry`` holds ``(sub_project, name, schema, rows_count, storage_uri)`` with the schema as DDL.
    """
    from tamis.operators.compare import content_hash

    entry = registry.where((F.col("sub_project") == sub_project) & (F.col("name") == name)).limit(2).collect()
    if len(entry) != 1:
        raise LookupError(f"golden dataset {sub_project}/{name}: {len(entry)} entries")
    found = spark.read.parquet(entry[0]["storage_uri"])
    wanted = StructType.fromDDL(entry[0]["schema"])
    if [(f.name, f.dataType) for f in wanted] != [(f.name, f.dataType) for f in found.schema]:
        raise ValueError(f"golden dataset {sub_project}/{name}: schema differs from the registry")
    rows = found.count()
    if rows != entry[0]["rows_count"]:
        raise ValueError(f"golden dataset {sub_project}/{name}: {rows} rows, registry says {entry[0]['rows_count']}")
    if digest is not None and content_hash(found).first()["digest"] != digest:
        raise ValueError(f"golden dataset {sub_project}/{name}: content differs")
    return found


Reader = Callable[[dict], DataFrame]


def file_readers(spark: SparkSession, landing: str, schemas: Mapping[str, Schema] | None = None) -> dict[str, Reader]:
    """Readers by source type for what lands as files below ``landing``.

    ``schemas`` names the schema of an upload, form, survey or key pattern by its identifier; uploads and
    forms without one are inferred from the files. Databases and topics need a connection, so their
    readers (``jdbc_table``, ``topic_batch``) are made by the caller.
    """
    known = dict(schemas or {})

    def forms(s: dict) -> DataFrame:
        path = f"{landing}/forms/{s['assetUid']}"
        schema = known.get(s["assetUid"]) or spark.read.json(path).schema
        return form_submissions(spark, path, schema, s.get("validatedOnly", True))

    def survey(s: dict) -> DataFrame:
        path = f"{landing}/surveys/{s['surveyId']}"
        asked = known.get(s["surveyId"])
        if asked is None:  # a survey has few questions
            raw = spark.read.schema("answers array<struct<question:string>>").json(path)
            asked = sorted(r[0] for r in raw.select(F.explode("answers.question")).distinct().collect() if r[0] is not None)
        return survey_responses(spark, path, list(asked))

    def keyed(s: dict) -> DataFrame:
        return keyed_snapshots(spark.read.schema("key string, value string").json(f"{landing}/keys"), s["keyPattern"], known[s["keyPattern"]])

    # The source types of a definition that land as files.
    return {
        "upload": lambda s: upload(spark, f"{landing}/{s['objectKey']}", s["format"], known.get(s["objectKey"])),
        "kobo": forms,
        "surveymonkey": survey,
        "dragonfly": keyed,
    }


def open_source(source: dict, readers: Mapping[str, Reader]) -> DataFrame:
    """The input of a definition through the reader registered for its source type."""
    kind = source["type"]
    if kind not in readers:
        raise LookupError(f"no reader for source type '{kind}'")
    df = readers[kind](source)
    predicate = source.get("sqlPredicate")
    return df.where(F.expr(safe_predicate(predicate))) if predicate else df
