"""Table scans and authored inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def sql_values(names: list[str], rows: list[tuple]) -> str:
    """The same rows as a SQL relation."""
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


def recorded(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A recorded input: SQL that Spark and the oracle both read, over {name} for each of the tables."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def in_oracle(sql: str, *names: str) -> str:
    """The same input as a SQL relation of the oracle."""
    return "(" + sql.format(**{n: n for n in names}) + ")"
