"""A registry of databases and collections, kept as JSON beside the data through Spark's own file system."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import points as P

NAME = re.compile(r"^[a-zA-Z0-9_-]+$")
RESERVED = {"metadata", "config", "system"}
FIELD_TYPES = ("timestamp", "string", "number", "boolean")


class CatalogError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def check_name(name: str) -> None:
    if not NAME.match(name or "") or len(name) > 64 or name in RESERVED:
        raise CatalogError("INVALID_NAME", f"{name!r} is not a usable name")


@dataclass
class Collection:
    name: str
    fields: dict[str, str] = field(default_factory=dict)
    hints: dict[str, str] = field(default_factory=dict)
    first_data_date: str | None = None
    inferred: dict[str, str] = field(default_factory=dict)


@dataclass
class Database:
    name: str
    description: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    collections: dict[str, Collection] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_catalog/{name}.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _save(self, db: Database) -> None:
        path, fs = self._path(db.name)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(asdict(db)).encode()))
        out.close()

    def get(self, name: str) -> Database:
        path, fs = self._path(name)
        if not fs.exists(path):
            raise CatalogError("DATABASE_NOT_FOUND", name)
        text = "\n".join(r[0] for r in self.spark.read.text(path.toString(), wholetext=True).collect())
        raw = json.loads(text)
        return Database(**raw | {"collections": {k: Collection(**v) for k, v in raw["collections"].items()}})

    def list(self) -> list[str]:
        path, fs = self._path("x")
        folder = path.getParent()
        return sorted(s.getPath().getName()[:-5] for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def create_database(self, name: str, description: str = "", metadata: dict | None = None) -> Database:
        check_name(name)
        if name in self.list():
            raise CatalogError("DATABASE_EXISTS", name)
        db = Database(name, description, metadata or {})
        self._save(db)
        return db

    def drop_database(self, name: str) -> None:
        self.get(name)
        path, fs = self._path(name)
        fs.delete(path, False)

    def create_collection(self, database: str, name: str, fields: dict[str, str], hints: dict | None = None) -> Collection:
        check_name(name)
        db = self.get(database)
        if name in db.collections:
            raise CatalogError("COLLECTION_EXISTS", name)
        if fields.get("time") != "timestamp" or fields.get("id") != "string":
            raise CatalogError("INVALID_REQUEST", "time (timestamp) and id (string) are required")
        if bad := [k for k, t in fields.items() if t not in FIELD_TYPES]:
            raise CatalogError("INVALID_REQUEST", f"unknown types of {bad}")
        db.collections[name] = Collection(name, fields, hints or {})
        self._save(db)
        return db.collections[name]

    def collection(self, database: str, name: str) -> Collection:
        db = self.get(database)
        if name not in db.collections:
            raise CatalogError("COLLECTION_NOT_FOUND", name)
        return db.collections[name]

    def drop_collection(self, database: str, name: str) -> None:
        self.collection(database, name)
        db = self.get(database)
        del db.collections[name]
        self._save(db)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._devices_path(database, name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _devices_path(self, database: str, name: str) -> str:
        return f"{self.root}/_catalog/devices/{database}/of-{name}"

    def devices(self, database: str, name: str) -> DataFrame:
        """The ids that points have brought. They are a table and not part of the JSON, as there may be very many."""
        self.collection(database, name)
        path = self._devices_path(database, name)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "id string")
        return self.spark.read.schema("id string").parquet(path).distinct()

    def track(self, database: str, name: str, points: DataFrame, tz: str = "UTC") -> Collection:
        """Notes the first date, the devices and the types of the fields that points bring. Known types stay."""
        from tidemark.functions.calendar import local_date

        self.collection(database, name)
        db = self.get(database)
        c = db.collections[name]
        first = points.agg(F.min(local_date(F.col("time"), tz)).cast("string")).first()[0]
        c.first_data_date = min(filter(None, [first, c.first_data_date]), default=None)
        c.inferred = P.inferred_types(points) | c.inferred
        self._save(db)
        ids = points.select("id").where("id is not null").distinct()
        ids.join(self.devices(database, name), "id", "left_anti").write.mode("append").parquet(self._devices_path(database, name))
        return c
