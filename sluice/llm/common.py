"""Shared pieces of the text operators: words, staging tables, table access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import configure, remove, scratch_dir

# A word is a maximal run of characters that are not ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the session's runtime settings applied."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Staging:
    """Tables of one operator's run, deleted as soon as their last reader has been written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_dir(spark, label)
        self.made = 0
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write a frame and read it back, like ``keep``."""
        path = f"{self.root}/{self.made}-{label}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.made += 1
        self.kept.append((back, path))
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables kept here. Nothing computed later may read them."""
        gone = [x for x in self.kept if any(x[0] is f for f in frames)]
        for _, path in gone:
            remove(self.spark, path)
        # A frame that is held here keeps its plan and file list in the driver's memory.
        self.kept = [x for x in self.kept if not any(x is g for g in gone)]


def words(text: Column) -> Column:
    """Words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def whole(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that an operator's own names cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def where_made(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose computed ``flag`` holds.

    A plain filter is pushed below the projections that made the flag, with their
    expressions written out inside one another's lambdas, and so costs a pass per word. A
    projection with a task-dependent column stops that.
    """
    placed = df.withColumn("_here", F.spark_partition_id())
    return placed.where(F.col(flag) & (F.col("_here") >= 0)).drop("_here")
