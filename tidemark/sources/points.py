"""Points: wide rows ``id, time, inserted_at, seq, <fields>``, long rows ``id, time, field, value``; reading and writing them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import calendar

KEYS = ("id", "time")
META = ("id", "time", "inserted_at", "seq", "local_date", "group_id")
NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)
MAX_BATCH = 10_000
#: Rows that one written file holds at most.
FILE_ROWS = 5_000_000


def to_points(df: DataFrame, id: str | Column, time: str | Column, fields: dict[str, str | Column] | Iterable[str], inserted_at: str | Column | None = None, seq: str | Column | None = None) -> DataFrame:
    """Wide points out of any table. Zoneless times are taken as UTC; seq orders writes of one moment."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    fields = fields if isinstance(fields, dict) else {f: f for f in fields}
    when = col(time).cast("timestamp")
    return df.select(
        col(id).cast("string").alias("id"),
        when.alias("time"),
        (col(inserted_at).cast("timestamp") if inserted_at is not None else when).alias("inserted_at"),
        (col(seq) if seq is not None else F.lit(0)).cast("long").alias("seq"),
        *[col(c).alias(f) for f, c in fields.items()],
    )


def in_range(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Rows of any table in a range whose ends both count. The bounds take the column's own type, so that files are skipped by them."""
    kind = df.schema[time].dataType
    bound = lambda t: F.lit(t).cast("timestamp").cast(kind)
    df = df if start is None else df.where(F.col(time) >= bound(start))
    return df if end is None else df.where(F.col(time) <= bound(end))


#: Comparisons that ``condition`` knows.
COMPARISONS = ("==", "!=", ">", ">=", "<", "<=", "IS_NULL", "IS_NOT_NULL")


def condition(field: str, comparison: str, value=None) -> Column:
    """A predicate on one field by the name of its comparison."""
    c = F.col(field)
    made = {"==": c == value, "!=": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value, "IS_NULL": c.isNull(), "IS_NOT_NULL": c.isNotNull()}
    if comparison not in made:
        raise ValueError(f"INVALID_REQUEST: comparison must be one of: {', '.join(COMPARISONS)}")
    return made[comparison]


def fields_of(points: DataFrame, numeric: bool = False) -> list[str]:
    return [f.name for f in points.schema.fields if f.name not in META and (not numeric or isinstance(f.dataType, NUMERIC))]


def to_long(points: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """A row for each numeric field that has a value; other fields and nulls don't appear."""
    own = fields_of(points, numeric=True)
    fields = [f for f in (own if fields is None else fields) if f in own]
    keys = [k for k in ("id", "time", "inserted_at", "seq") if k in points.columns]
    if not fields:
        return points.where(F.lit(False)).select(*keys, F.lit("").alias("field"), F.lit(0.0).alias("value"))
    if len(fields) == 1:
        return points.select(*keys, F.lit(fields[0]).alias("field"), F.col(fields[0]).cast("double").alias("value")).where("value is not null")
    return points.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(keys, fields, "field", "value").where("value is not null")


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def scan(points: DataFrame, ids: Iterable[str] | None = None, start=None, end=None, fields: Iterable[str] | None = None, tz: str = "UTC") -> DataFrame:
    """Points of some devices in a range whose ends both count. Fields that no point has come as nulls.

    On a table partitioned by ``local_date`` the range also bounds that column, as Spark can't derive it from ``time``.
    """
    if ids is not None:
        points = points.where(F.col("id").isin(list(ids)))
    moment = lambda t: F.lit(t).cast("timestamp")
    if start is not None:
        points = points.where(F.col("time") >= moment(start))
        if "local_date" in points.columns:
            points = points.where(F.col("local_date") >= calendar.local_date(moment(start), tz))
    if end is not None:
        points = points.where(F.col("time") <= moment(end))
        if "local_date" in points.columns:
            points = points.where(F.col("local_date") <= calendar.local_date(moment(end), tz))
    if fields is None:
        return points.drop("local_date")
    have = set(points.columns)
    return points.select(*[c for c in ("id", "time", "inserted_at", "seq") if c in have], *[F.col(f) if f in have else F.lit(None).cast("double").alias(f) for f in fields])


def devices(points: DataFrame) -> DataFrame:
    return points.select("id").distinct()


def recent(points: DataFrame, hours: float) -> DataFrame:
    """The points of the last hours before now, for a cache of what is asked for most."""
    return points.where(F.col("time") >= F.timestamp_micros(F.unix_micros(F.current_timestamp()) - int(hours * 3_600_000_000)))


def write_points(points: DataFrame, path: str, tz: str = "UTC", mode: str = "append", bloom: bool = False) -> None:
    """Appends to a table partitioned by local date; rows of a file stand by device and time, so that its statistics skip.

    ``bloom`` adds Bloom filters of the devices, for tables where single devices are asked for.
    """
    x = points.withColumn("local_date", calendar.local_date(F.col("time"), tz))
    # ranges cut by the data: a day of many points is shared among tasks, days of few share one
    x = x.repartitionByRange("local_date", "id", "time").sortWithinPartitions("local_date", "id", "time")
    x.write.option("parquet.bloom.filter.enabled#id", str(bloom).lower()).option("maxRecordsPerFile", FILE_ROWS).mode(mode).partitionBy("local_date").parquet(path)


def dump_csv(spark: SparkSession, path: str, out: str) -> None:
    """A stored table, points or rollups, as CSV with a header."""
    spark.read.parquet(path).write.mode("overwrite").option("header", True).csv(out)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def partitions(points: DataFrame) -> DataFrame:
    """Rows and files of each local date of a stored table."""
    return points.select("local_date", F.col("_metadata.file_path").alias("_f")).groupBy("local_date").agg(F.count("*").alias("rows"), F.countDistinct("_f").alias("files"))


def parse_json(lines: DataFrame, fields: dict[str, str], column: str = "value") -> DataFrame:
    """JSON points, each a string: RFC 3339 ``time``, string ``id``, and fields by name and type. What can't be read is null; ingest sets rows without id or time aside."""
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("time", T.StringType()), *[T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()]])
    x = lines.withColumn("_p", F.from_json(F.col(column), kind))
    return x.select(F.col("_p.id").alias("id"), F.try_to_timestamp("_p.time").alias("time"), *[F.col(f"_p.{k}").alias(k) for k in fields])


def read_json_batch(spark: SparkSession, records: list[dict]) -> DataFrame:
    """One request's points. The whole batch is refused if it is too long or a point lacks its id or time."""
    if len(records) > MAX_BATCH:
        raise ValueError(f"INVALID_REQUEST: more than {MAX_BATCH} points")
    for k, r in enumerate(records):
        if not isinstance(r.get("id"), str) or not r["id"] or not isinstance(r.get("time"), str):
            raise ValueError(f"INVALID_REQUEST: point {k} needs a string id and a time")
    kinds: dict[str, str] = {}
    for r in records:
        for k, v in r.items():
            if k not in KEYS and v is not None:
                kind = "boolean" if isinstance(v, bool) else "double" if isinstance(v, (int, float)) else "string"
                kinds[k] = kind if kinds.get(k, kind) == kind else "string"
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    rows = [(r["id"], r["time"], *[None if r.get(k) is None else text(r[k]) if t == "string" else bool(r[k]) if t == "boolean" else float(r[k]) for k, t in kinds.items()]) for r in records]
    df = spark.createDataFrame(rows, "id string, time string" + "".join(f", `{k}` {t}" for k, t in kinds.items()))
    parsed = df.withColumn("time", F.to_timestamp("time"))
    return parsed.withColumns({"inserted_at": F.current_timestamp(), "seq": F.monotonically_increasing_id()})


def inferred_types(points: DataFrame) -> dict[str, str]:
    """Catalog names of the fields' types."""
    names = {T.BooleanType: "bool", T.StringType: "string", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.LongType: "int", T.IntegerType: "int"}
    return {f.name: names.get(type(f.dataType), "float") for f in points.schema.fields if f.name not in META}
