"""Typed source scans and column-drift resolution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.schemas import EntitySpec


def resolve_column(df: DataFrame, candidates: Sequence[str], slot: str) -> tuple[DataFrame, bool]:
    """Put whichever candidate column is present into a stable slot.

    The second value tells whether the live name drifted away from the slot. If no
    candidate is present the frame is returned as it is and the slot counts as live.
    """
    live = next((name for name in candidates if name in df.columns), slot)
    if live == slot:
        return df, False
    return df.withColumnRenamed(live, slot), True


def with_arrival(df: DataFrame) -> DataFrame:
    """Add ``_arrived``: when a row's file was written, the file, and the row's place in it.

    A later file's version of a key wins over an earlier one's, and in one file the lower row.
    Needs a frame that reads files.
    """
    at = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "row_index")]
    return df.select("*", F.struct(*at).alias("_arrived"))


def read_all_names(
    spark: SparkSession, spec: EntitySpec, path: str, candidates: Sequence[str], slot: str
) -> DataFrame:
    """Files of which some have one name of a column and some another: all names, and ``_file``.

    The declared schema names every candidate, so each file gives what it has and NULL for
    the rest, and no footer is read beforehand.
    """
    kind = dict(spec.columns)[slot]
    others = [f"{c} {kind}" for c in candidates if c not in spec.column_names]
    rows = spark.read.schema(", ".join([spec.ddl, *others])).parquet(path)
    return with_arrival(rows).withColumn("_file", F.col("_arrived.file_path"))


def drift_by_file(rows: DataFrame, candidates: Sequence[str], slot: str) -> DataFrame:
    """``_file``, its ``rows``, the ``live`` name of the column in it, and whether that drifted.

    The live name is the first candidate with a value; a file without any counts as not
    drifted. Only the candidates are scanned, and counts combine before the shuffle.
    """
    seen = [F.count(c).alias(f"_n_{c}") for c in candidates]
    counted = rows.groupBy("_file").agg(F.count("*").alias("rows"), *seen)
    live = F.coalesce(*[F.when(F.col(f"_n_{c}") > 0, F.lit(c)) for c in candidates], F.lit(slot))
    return counted.select("_file", "rows", live.alias("live"), (live != slot).alias("_schema_drift"))


def resolve_by_file(
    rows: DataFrame, files: DataFrame, candidates: Sequence[str], slot: str
) -> DataFrame:
    """One slot for all names of a column, and on every row whether its file drifted.

    ``files`` comes from ``drift_by_file``, best written out, so that its size is known: there
    is one row per file.
    """
    found = files.select(F.col("_file").alias("_of"), "_schema_drift")
    joined = rows.join(found, F.col("_file") == F.col("_of"), "left").drop("_of", "_file")
    rest = [c for c in candidates if c != slot]
    return joined.withColumn(slot, F.coalesce(*candidates)).drop(*rest)


def project(df: DataFrame, spec: EntitySpec, extra: Sequence[str] = ()) -> DataFrame:
    """Only the declared columns, in the declared types, and ``extra`` ones as they are."""
    kinds = dict(df.dtypes)
    columns: list[Column] = []
    for name, kind in spec.columns:
        col = F.col(name)
        columns.append(col if _same_type(kinds[name], kind) else col.cast(kind).alias(name))
    return df.select(*columns, *extra)


def _same_type(actual: str, declared: str) -> bool:
    return actual.replace(" ", "").lower() == declared.replace(" ", "").lower()


def read_entity(
    spark: SparkSession,
    spec: EntitySpec,
    source: str | dict[str, str] | DataFrame,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Typed, projected scan of one source table.

    ``source`` is a Parquet path, a dict of JDBC options, or an existing DataFrame, of which the
    ``extra`` columns ride along.
    """
    if isinstance(source, DataFrame):
        return project(source, spec, extra)
    if isinstance(source, dict):
        return project(read_jdbc(spark, spec, source), spec)
    return project(spark.read.schema(spec.ddl).parquet(source), spec)


def read_jdbc(spark: SparkSession, spec: EntitySpec, options: dict[str, str]) -> DataFrame:
    """Parallel JDBC scan split on the primary key; filters are pushed to the database.

    Needs a driver jar on the class path, plus ``url`` and the key bounds.
    """
    defaults = {
        "dbtable": spec.name,
        "partitionColumn": spec.pk,
        "numPartitions": "64",
        "fetchsize": "10000",
        "pushDownPredicate": "true",
    }
    return spark.read.format("jdbc").options(**{**defaults, **options}).load()


def read_log_lines(spark: SparkSession, groups: Sequence[str]) -> DataFrame:
    """Lines of text files as (seq, path, line); ``seq`` orders them.

    ``groups`` are paths or globs; all files of a group come after those of the group
    before it, in the order of their paths. Within a file the start of the split and the
    row's place in it give the order of lines, so large files are split and nothing is
    numbered in one task.
    """
    parts = []
    for number, group in enumerate(groups):
        reader = spark.read.format("text").option("recursiveFileLookup", "true")
        lines = reader.option("ignoreMissingFiles", "true").load(group)
        parts.append(
            lines.select(
                F.struct(
                    F.lit(number).alias("group"),
                    F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("place"),
                ).alias("seq"),
                F.col("_metadata.file_path").alias("path"),
                F.col("value").alias("line"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
