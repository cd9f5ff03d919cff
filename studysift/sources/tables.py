"""Table sources and the run report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studysift.operators.validate import drop_unnamed

REVIEWER_SCHEMA = "uuid STRING, Titles STRING, `Was Selected?` INT, R1 DOUBLE, R2 DOUBLE, R3 DOUBLE"

# Fixed names of the report tables.
REPORT_TABLES = (
    "scores", "analysis", "predictions", "probabilities", "parameters", "test_configuration", "validation",
)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header. Give a schema where possible; inferring one costs a second pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_reviewers(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reviewer verdicts under the column names the agreement operators use."""
    return drop_unnamed(read_csv(spark, path, schema)).withColumnsRenamed(
        {"Titles": "title", "Was Selected?": "was_selected"}
    )


def read_result(spark: SparkSession, run: str, table: str = "probabilities", fmt: str = "parquet") -> DataFrame:
    """One named table of an earlier run."""
    if table not in REPORT_TABLES:
        raise ValueError(f"unknown table {table!r}, expected one of {REPORT_TABLES}")
    path = f"{run.rstrip('/')}/{table}"
    return drop_unnamed(spark.read.parquet(path) if fmt == "parquet" else read_csv(spark, path))


def refuse_existing(spark: SparkSession, out: str) -> None:
    """Raise before any work is done if one of the report tables is there already."""
    for name in REPORT_TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise FileExistsError(f"{path.toString()} exists already")


def write_report(tables: dict[str, DataFrame], out: str, fmt: str = "parquet") -> None:
    """Write the report tables under one folder; an existing table is refused, never overwritten."""
    unknown = set(tables) - set(REPORT_TABLES)
    if unknown:
        raise ValueError(f"unknown report tables: {sorted(unknown)}")
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        path = f"{out.rstrip('/')}/{name}"
        writer.parquet(path) if fmt == "parquet" else writer.option("header", True).csv(path)
