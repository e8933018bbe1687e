"""Scans of database tables by many tasks: ranges of a column, or batches of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

#: Rows that one task of a range scan reads, about, and the most tasks that ask the database.
ROWS_A_TASK, MOST_TASKS = 500_000, 256
#: Keys of one query, and most keys that are sent as predicates; more are joined.
KEYS_A_QUERY, MOST_KEYS = 500, 50_000


def _options(url: str, options: dict[str, str]) -> dict[str, str]:
    return {"url": url, **options}


def quoted(spark: SparkSession, url: str, column: str) -> str:
    """A column's name as the database's dialect writes it."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)


def bounds(spark: SparkSession, url: str, table: str, column: str, **options: str):
    """(least, greatest, rows) of a column, found by one query in the database; the first two are None where it has no values."""
    name = quoted(spark, url, column)
    asked = f"(SELECT MIN({name}) AS lo, MAX({name}) AS hi, COUNT(*) AS n FROM {table}) b"
    r = spark.read.format("jdbc").options(**_options(url, options), dbtable=asked).load().toDF("lo", "hi", "n").first()
    return r["lo"], r["hi"], int(r["n"])


def scan(spark: SparkSession, url: str, table: str, column: str, rows_a_task: int = ROWS_A_TASK, most: int = MOST_TASKS, **options: str) -> DataFrame:
    """A whole table by ranges of a numeric, date or timestamp ``column``, about ``rows_a_task`` rows each if it is even.

    Rows with a null there are read by the first task. Filters and column lists are pushed down in each task's query.
    """
    plain = spark.read.format("jdbc").options(**_options(url, options), dbtable=table).load()
    found = {f.name.lower(): f for f in plain.schema.fields}
    if column.lower() not in found:
        raise KeyError(f"{table} has no column {column!r}")
    column, kind = found[column.lower()].name, found[column.lower()].dataType
    if not isinstance(kind, NumericType | DateType | TimestampType | TimestampNTZType):
        raise TypeError(f"{column} of {table} is {kind.simpleString()}: ranges need numbers, dates or timestamps")
    low, high, n = bounds(spark, url, table, column, **options)
    tasks = min(most, -(-n // rows_a_task))
    if low is None or tasks < 2 or low == high:
        return plain
    if isinstance(kind, NumericType):
        low, high = int(low), int(high)
    limits = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(tasks)}
    return spark.read.format("jdbc").options(**_options(url, options), dbtable=table, **limits).load()


def literal(value) -> str:
    if value is None or isinstance(value, bool | float):
        raise TypeError(f"{value!r} is no key")
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def batches(column: str, keys: list, size: int = KEYS_A_QUERY) -> list[str]:
    """Predicates of at most ``size`` keys that have no key in common."""
    kept = sorted(set(keys))
    return [f"{column} IN ({', '.join(literal(k) for k in kept[i : i + size])})" for i in range(0, len(kept), size)]


def lookup(spark: SparkSession, url: str, table: str, column: str, keys: DataFrame, range_column: str | None = None, size: int = KEYS_A_QUERY, most: int = MOST_KEYS, **options: str) -> DataFrame:
    """Rows of ``table`` whose ``column`` is one of ``keys`` (a frame of one column; nulls and repeats count for nothing).

    ``column`` is written as the table has it. Up to ``most`` keys are sent to the database, a batch of ``size`` in each task's query. Where there are more, the table is
    scanned, by ranges of ``range_column`` if it is given, and joined.
    """
    wanted = keys.toDF("_key").filter("_key IS NOT NULL").distinct()
    sent = [r["_key"] for r in wanted.limit(most + 1).collect()]  # at most ``most`` + 1 keys
    if 0 < len(sent) <= most:
        given = {k: v for k, v in options.items() if k not in ("user", "password", "driver")}
        login = {k: v for k, v in options.items() if k not in given}
        return spark.read.options(**given).jdbc(url, table, predicates=batches(quoted(spark, url, column), sent, size), properties=login)
    whole = scan(spark, url, table, range_column, **options) if range_column else spark.read.format("jdbc").options(**_options(url, options), dbtable=table).load()
    return whole.join(wanted, F.col(column) == F.col("_key"), "left_semi") if sent else whole.limit(0)
