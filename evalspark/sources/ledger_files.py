"""Reading and writing the event ledger and other line-delimited JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.session import materialize

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("ingest_time", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("actor_agent_id", T.StringType()),
        T.StructField("actor_task_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("payload_json", T.StringType()),
    ]
)
POSTING_SCHEMA = T.StructType(
    [
        T.StructField("posting_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("delta_numeric", T.DoubleType()),
        T.StructField("dims_json", T.StringType()),
    ]
)
CONTRACTS = {"events": EVENT_SCHEMA, "postings": POSTING_SCHEMA}


def _lines(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """All ``<kind>.jsonl`` files (or folders of that name) below ``source``.

    The path test only uses file metadata, so other files are dropped from the listing. The
    explicit schema makes empty files, blank lines and missing files typed and harmless.
    """
    rows = (
        spark.read.schema(CONTRACTS[kind])
        .option("recursiveFileLookup", "true")
        .json(source)
        .filter(F.col("_metadata.file_path").rlike(rf"/{kind}\.jsonl(/[^/]*)?$"))
    )
    key = CONTRACTS[kind].fieldNames()[0]
    return rows.filter(F.col(key).isNotNull())


def read_ledger(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Events and postings below a folder, or of the folder a given events file lies in.

    Repeated ids collapse to the newest row; the postings are empty when there are none.
    """
    from evalspark.operators.ledger import dedupe_latest

    folder = source.rsplit("/", 1)[0] if source.endswith("events.jsonl") else source
    events = dedupe_latest(_lines(spark, folder, "events"), "event_id", ["ingest_time"])
    postings = dedupe_latest(_lines(spark, folder, "postings"), "posting_id", [])
    return events, postings


def write_ledger(events: DataFrame, postings: DataFrame | None, folder: str) -> None:
    """Write line-delimited JSON that :func:`read_ledger` understands."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    events.write.option("timestampFormat", stamp).json(f"{folder}/events.jsonl")
    if postings is not None:
        postings.write.json(f"{folder}/postings.jsonl")


def normalize_contract(df: DataFrame, kind: str) -> DataFrame:
    """Contract column names and types for any source; nested payloads become JSON text."""
    schema = CONTRACTS[kind]
    present = {f.name.lower(): f for f in df.schema.fields}
    columns: list[Column] = []
    for field in schema.fields:
        found = present.get(field.name)
        if found is None:
            col = F.lit(None)
        elif field.name.endswith("_json") and isinstance(found.dataType, (T.StructType, T.MapType, T.ArrayType)):
            col = F.to_json(F.col(found.name))
        else:
            col = F.col(found.name)
        columns.append(col.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def read_json_permissive(
    spark: SparkSession, path: str, schema: T.StructType, list_columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Good rows with their source file, and the lines that could not be read.

    List columns become JSON text for targets without array columns.
    """
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = (
        spark.read.schema(wide)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", "true")
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )
    # both results need the parse outcome, which Spark only gives for rows that are stored
    rows = materialize(rows, "parsed_lines")
    good = rows.filter(F.col("_bad").isNull()).drop("_bad")
    for name in list_columns or []:
        good = good.withColumn(name, F.to_json(F.col(name)))
    bad = rows.filter(F.col("_bad").isNotNull()).select("source_file", F.col("_bad").alias("line"))
    return good, bad
