"""Reading inputs, written intermediate tables, and joins that no key can overload."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one: two runs never meet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(docs: DataFrame, work: Callable[[Iterator], Iterator], adds: str) -> DataFrame:
    """``work`` over record batches with one struct column ``row`` of all columns; it returns ``row`` and the fields of ``adds``."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return whole.mapInArrow(work, f"row {whole.schema['row'].dataType.simpleString()}, {adds}")


def unpacked(docs: DataFrame) -> dict[str, Column]:
    """The columns of ``docs`` out of ``row``."""
    return {c: F.col(f"row.`{c}`").alias(c) for c in docs.columns}


def least_placed(rows: DataFrame, place: str, k: int, order: list[str]) -> DataFrame:
    """The k rows of least ``place``, a 64-bit hash, then in ``order``.

    A threshold first leaves about one and a half times k rows, so what is put in order doesn't grow with the number of tasks. ``rows`` are
    read up to three times.
    """
    n = rows.count()
    if n > 4 * k:
        few = rows.where(F.col(place) < int((1.5 * k / n - 0.5) * 2.0 ** 64))
        if few.count() >= k:
            rows = few
    return rows.orderBy(place, *order).limit(k)


def text_crc(column: Column) -> Column:
    """crc32 of a value written as text; null as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, heavy: int = 1000) -> DataFrame:
    """rows left join groups (one row per key, with the group's number of rows in ``size``).

    A group with more than 1/heavy of all rows is hot. There are fewer than ``heavy`` of them, so they
    are broadcast; for the rest, no key has more than that share of the rows in one task.
    """
    limit = max(1, n_rows // heavy)
    hot = groups.where(F.col(size) > limit)
    hot_keys = hot.select(F.col(key).alias("_hot"))
    marked = rows.join(F.broadcast(hot_keys), rows[key] == F.col("_hot"), "left")
    warm = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), key)
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(F.col(size) <= limit), key, "left")
    return warm.unionByName(rest)
