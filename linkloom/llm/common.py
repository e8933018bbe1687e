"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import json
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the operators' word patterns define it.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``); a temporary one where a local session leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # the setting is fixed once a session runs, so the folder is remembered here
        found = _local_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="linkloom-")
        _local_dirs[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


_local_dirs: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs one read, not a recomputation. The folder is removed by
    :func:`release`, or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    for made in _recorded:
        made.append(table)
    return table


_recorded: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """Collects the tables that are stored inside the block."""
    made: list[DataFrame] = []
    _recorded.append(made)
    try:
        yield made
    finally:
        _recorded.pop()


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, stored; all that it stored on its way is removed."""
    with recorded() as made:
        out = stored(make(), name)
    release(*[t for t in made if t is not out])
    return out


def release(*tables: DataFrame) -> None:
    """Remove stored tables that no later plan reads."""
    for table in tables:
        _remove(table.sparkSession, table.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


#: A key is hot when it holds more than one in HOT_SHARE of all rows, so fewer than HOT_SHARE keys are, whatever the table.
HOT_SHARE = 65_536
#: Keys with fewer rows than this are not worth another route.
HOT_ROWS = 20_000


def is_hot(n: str, total: int) -> Column:
    return (F.col(n) > HOT_ROWS) & (F.col(n) * HOT_SHARE > total)


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``per_key`` (one row per key; ``n`` counts the key's rows in ``rows``, ``total`` is all rows).

    Hot keys, fewer than ``HOT_SHARE`` by definition, are joined by broadcast where their rows are; the others meet in a
    shuffle in which no key has many rows. Both inputs are read twice and should be stored tables.
    """
    hot = per_key.filter(is_hot(n, total)).drop(n)
    others = per_key.filter(~is_hot(n, total)).drop(n)
    if hot.isEmpty():
        return rows.join(others, key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Join keys that a hot key is spread over.
HOT_SALTS = 256


def salted(rows: DataFrame, hot: DataFrame, key: str, by: list[str], salts: int, out: str) -> DataFrame:
    """``rows`` with column ``out``: which of ``salts`` parts of its key a row is in, by a hash of the columns ``by``; -1 where the key is not in ``hot``.

    ``hot`` is one column of distinct keys, fewer than ``HOT_SHARE`` by definition, which bounds what is broadcast.
    """
    marked = rows.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot"))), key, "left")
    return marked.withColumn(out, F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(-1).cast("int")).drop("_hot")


def join_salted(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """As :func:`join_hot`, but by one plan whatever the keys: hot keys are spread over ``HOT_SALTS`` join keys.

    Nothing goes through the driver. ``per_key`` is read twice and should be a stored table.
    """
    salts = F.when(is_hot(n, total), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(-1)))
    spread = per_key.withColumn("_part", F.explode(salts)).drop(n)
    hot = per_key.filter(is_hot(n, total)).select(key)
    return salted(rows, hot, key, rows.columns, HOT_SALTS, "_part").join(spread, [key, "_part"]).drop("_part")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, even where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small driver-side list as a DataFrame made of one literal (no RDD, no Python on the executors)."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = F.lit(json.dumps([dict(zip(names, row, strict=True)) for row in rows]))
    kind = ", ".join(x.replace(" ", ": ") for x in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{kind}>>")))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that names of its own cannot clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def with_key(docs: DataFrame, *carried: Column) -> DataFrame:
    """``_id`` (never null), ``_tie`` and ``text`` (never null) for each row, beside the columns ``carried``.

    Rows are ordered and joined by (``_id``, ``_tie``). A null id sorts before all others. ``_tie`` is constant while ids
    are unique; where an id repeats it is a hash of the text, so that rows that repeat an id and differ in text are
    documents of their own, and rows that repeat both are one document whose result each of them gets.
    """
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    repeated = not docs.groupBy(ids.alias("_id")).count().filter("count > 1").limit(1).isEmpty()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    return docs.select(*carried, ids.alias("_id"), tie.alias("_tie"), text.alias("text"))


#: Rows that one window task of group_ranks ranks, about.
ROWS_PER_BUCKET = 50_000


def group_ranks(rows: DataFrame, key: str, order: list[str], n_rows: int) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... inside each ``key``, without bringing a key's rows together.

    Rows of a key are dealt over sub-buckets by a hash of ``order`` and ranked there; the sub-buckets' counts, summed up
    in order, say where each begins. Rows that agree in all of ``order`` are taken as exchangeable.
    """
    subs = max(8, math.ceil(n_rows / ROWS_PER_BUCKET))
    rows = rows.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(subs)).cast("int"))
    starts = (
        rows.groupBy(key, "_sub")
        .count()
        .withColumn("_first", F.sum("count").over(Window.partitionBy(key).orderBy("_sub")) - F.col("count"))
        .select(F.col(key).alias("_key"), F.col("_sub").alias("_at"), "_first")
    )
    inside = F.row_number().over(Window.partitionBy(key, "_sub").orderBy(*order)) - 1
    joined = rows.withColumn("_inside", inside).join(starts, (F.col(key) == F.col("_key")) & (F.col("_sub") == F.col("_at")))
    return joined.withColumn("rank", F.col("_first") + F.col("_inside")).drop("_sub", "_key", "_at", "_first", "_inside")
