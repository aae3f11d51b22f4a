"""Upkeep: compaction, retention, checksums, and the repair of replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators.merge import latest
from tidemark.sources.points import FILE_ROWS, KEYS, fields_of


def file_counts(spark: SparkSession, path: str, part: str = "local_date") -> DataFrame:
    """Files and rows of each partition."""
    return spark.read.parquet(path).select(part, F.col("_metadata.file_path").alias("_f")).groupBy(part).agg(F.countDistinct("_f").alias("files"), F.count("*").alias("rows"))


def compact(spark: SparkSession, path: str, staging: str, min_files: int = 4, part: str = "local_date", keys: tuple[str, ...] = KEYS, dry_run: bool = False) -> list:
    """Rewrites the partitions with more than ``min_files`` files as few large ones, the last write of each key alone; ranges of the keys share the work.

    The new files are written to ``staging`` first, as they can't be read and overwritten at once.
    """
    crowded = [r[part] for r in file_counts(spark, path, part).where(F.col("files") > min_files).orderBy(part).collect()]
    if crowded and not dry_run:
        x = spark.read.parquet(path).where(F.col(part).isin(crowded))
        x = latest(x, keys) if "inserted_at" in x.columns else x.dropDuplicates(list(keys))
        write = lambda x, to: x.repartitionByRange(part, *keys).sortWithinPartitions(part, *keys).write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).mode("overwrite").partitionBy(part).parquet(to)
        write(x, staging)
        write(spark.read.parquet(staging), path)
    return crowded


def retain(spark: SparkSession, path: str, cutoff, level: str = "raw", tz: str = "UTC") -> list[str]:
    """Drops the partitions that end before the cutoff; gives their names."""
    part = calendar.partition_column(level)
    limit = spark.range(1).select(calendar.partition_value(F.lit(cutoff).cast("timestamp"), level, tz).cast("string")).first()[0]
    jvm, gone = spark._jvm, []
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith(f"{part}=") and name.partition("=")[2] < limit:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def checksum(points: DataFrame) -> DataFrame:
    """One row: 16 hex digits and the number of points. Rows are hashed and the hashes summed, so order doesn't matter and no task gathers them."""
    parts = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("\x00"))) for f in sorted(fields_of(points))]
    row = F.concat_ws("|", F.col("id"), F.unix_micros("time").cast("string"), *parts)
    two = [F.sum(F.conv(F.substring(F.sha2(row, 256), at, 8), 16, 10).cast("decimal(38,0)")) for at in (1, 9)]
    total = F.concat(*[F.lpad(F.lower(F.hex((s % (1 << 32)).cast("long"))), 8, "0") for s in two])
    return points.agg(F.when(F.count("*") > 0, total).otherwise("empty").alias("checksum"), F.count("*").alias("points"))


def light_checksum(points: DataFrame) -> DataFrame:
    """``count:first:last``, times in milliseconds; of no points ``empty``."""
    ms = lambda c: F.unix_millis(c).cast("string")
    return points.agg(F.when(F.count("*") > 0, F.concat_ws(":", F.count("*").cast("string"), ms(F.min("time")), ms(F.max("time")))).otherwise("empty").alias("checksum"))


def compare(mine: DataFrame, theirs: DataFrame, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """Groups whose checksums or counts differ between two replicas, or that only one has."""

    def sums(x: DataFrame, name: str) -> DataFrame:
        parts = [F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in sorted(fields_of(x))]
        return x.groupBy(*by).agg(F.sum(F.xxhash64("id", F.unix_micros("time"), *parts).cast("decimal(38,0)")).alias(f"sum_{name}"), F.count("*").alias(f"count_{name}"))

    both = sums(mine, "mine").join(sums(theirs, "theirs"), list(by), "full_outer")
    return both.where(~(F.col("sum_mine").eqNullSafe(F.col("sum_theirs")) & F.col("count_mine").eqNullSafe(F.col("count_theirs"))))


def repair_rows(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """What a replica lacks: the other's points that it doesn't have, or has from an earlier write."""
    have = mine.groupBy("id", "time").agg(F.max("inserted_at").alias("_have"))
    x = theirs.join(have, ["id", "time"], "left").where(F.col("_have").isNull() | (F.col("inserted_at") > F.col("_have")))
    return latest(x.drop("_have"))


def last_timestamp(points: DataFrame) -> DataFrame:
    return points.agg(F.max("time").alias("last_time"))


def first_data_date(points: DataFrame, tz: str = "UTC") -> DataFrame:
    return points.agg(F.min(calendar.local_date(F.col("time"), tz)).alias("first_date"))
