"""Table level sources and sinks: star loading, bulk copy, partition replacement, CSV export."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Table and column names of the descriptive layout; columns not named keep their names.
DESCRIPTIVE_TABLES = {"merchant_data": "merchants", "fees": "fee_rules"}
DESCRIPTIVE_COLUMNS = {
    "payments": {
        "psp_reference": "transaction_id",
        "merchant": "merchant_id",
        "eur_amount": "transaction_amount_eur",
        "ip_country": "ip_country_code",
        "issuing_country": "card_issuing_country_code",
        "has_fraudulent_dispute": "is_fraudulent_dispute",
        "aci": "authorization_characteristics_indicator",
        "acquirer_country": "acquirer_country_code",
    },
    "acquirer_countries": {"acquirer": "acquirer_name"},
    "merchant_category_codes": {"description": "mcc_description"},
    "merchant_data": {
        "merchant": "merchant_id",
        "capture_delay": "capture_delay_days_or_immediate_or_manual",
        "acquirer": "acquirers",
    },
    "fees": {
        "id": "fee_rule_id",
        "card_scheme": "card_scheme_filter",
        "account_type": "account_types_filter_empty_means_any",
        "capture_delay": "capture_delay_bucket_filter_null_means_any",
        "monthly_fraud_level": "monthly_fraud_level_bucket_filter_null_means_any",
        "monthly_volume": "monthly_volume_bucket_filter_null_means_any",
        "merchant_category_code": "mccs_filter_empty_means_any",
        "is_credit": "is_credit_filter_null_means_any",
        "aci": "acis_filter_empty_means_any",
        "fixed_amount": "fixed_fee_eur",
        "rate": "variable_rate_bps",
        "intracountry": "intracountry_filter_null_means_any",
    },
}


def load_star(
    spark: SparkSession,
    paths: dict[str, str],
    schemas: dict[str, T.StructType],
    renames: dict[str, dict[str, str]] | None = None,
    table_names: dict[str, str] | None = None,
    documents: frozenset[str] = frozenset(),
) -> dict[str, DataFrame]:
    """Load the tables of a star from CSV or JSON by file ending.

    ``renames`` maps columns per table and ``table_names`` the tables themselves, which gives
    the descriptive and the placeholder layout from the same files. JSON files hold one object per line, so that
    tasks share a file; those of the tables in ``documents`` hold one array each, which one task reads whole.
    """
    out = {}
    for name, path in paths.items():
        reader = spark.read.schema(schemas[name])
        if path.rstrip("/").endswith(".csv"):
            df = reader.option("header", "true").csv(path)
        else:
            df = reader.option("multiLine", str(name in documents).lower()).json(path)
        out[(table_names or {}).get(name, name)] = df.withColumnsRenamed((renames or {}).get(name, {}))
    return out


def placeholder_layout(schemas: dict[str, T.StructType]) -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """Column and table renames of the layout without meaning: ``table_1.column_a`` and so on."""
    renames, tables = {}, {}
    for number, (name, schema) in enumerate(schemas.items(), start=1):
        tables[name] = f"table_{number}"
        renames[name] = {f: f"column_{chr(ord('a') + i)}" for i, f in enumerate(schema.fieldNames())}
    return renames, tables


def descriptive_layout() -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """Column and table renames of the layout whose names say what they hold."""
    return DESCRIPTIVE_COLUMNS, DESCRIPTIVE_TABLES


def copy_schema_tables(
    sources: dict[str, dict[str, DataFrame]], target: str, at_once: int = 4
) -> dict[str, list[str]]:
    """Write every table of every source database below ``target/<database>/<table>``, ``at_once`` tables at a time.

    Small tables fill the executors that the last tasks of a large one leave idle. The first failure is raised
    when the running copies have ended; a copy that is repeated overwrites its table.
    """
    named = [(database, table) for database, tables in sources.items() for table in tables]
    spark = next((df.sparkSession for tables in sources.values() for df in tables.values()), None)
    if spark is None:
        return {}

    def copy(database: str, table: str) -> None:
        sources[database][table].write.mode("overwrite").parquet(f"{target}/{database}/{table}")

    with ThreadPoolExecutor(at_once) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(copy), *pair) for pair in named]
        for job in running:
            job.result()
    return {database: list(tables) for database, tables in sources.items() if tables}


def sample_rows(df: DataFrame, order: list[Column | str], n: int = 3) -> DataFrame:
    """A fixed page of ``n`` rows; the order makes it repeatable."""
    return df.orderBy(*order).limit(n)


def write_partition_replace(df: DataFrame, path: str, partition: str = "schema_name") -> None:
    """Replace only the partitions that ``df`` holds, keep all others."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Reports are small; a large frame stays in several part files."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def union_with_source(tables: dict[str, DataFrame], name: str = "source_table") -> DataFrame:
    """Union by name of several tables with the table's name as a column."""
    parts = [df.withColumn(name, F.lit(key)) for key, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
