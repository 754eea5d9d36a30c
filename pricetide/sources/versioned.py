"""Tables that are merged into part by part, with a pointer that is published last.

A table is a folder with a folder for each version and a manifest for each version that tells which version holds each part.
A merge writes the parts that incoming rows touch, and only these, under a new version, and then creates its manifest. Who
reads takes the newest manifest; a job that is lost before leaves files that no manifest names, and the old version stays.
Two writers that start from the same version write to folders of their own, and only one can create the next manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def part_of(keys: list[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def publish_once(spark: SparkSession, folder: str, name: str, content: dict) -> bool:
    """Create folder/name with JSON in it, whole or not at all; False if it is there already."""
    of = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    own = of(f".{uuid.uuid4().hex}")
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(own, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return not fs.exists(of(name)) and fs.rename(own, of(name))


class BatchLog:
    """What the micro-batches of streams have written: one entry for each batch, made when all its folders are there.

    A batch that runs again after its entry was made is skipped; one that was lost before writes new folders, and nobody
    reads the old ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> dict[str, dict[str, str]]:
        """name -> folder by kind; as many as there were batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        names = [n for n in names if not n.startswith(".")]
        if not names:
            return {}
        rows = self.spark.read.text([f"{self.root}/batches/{n}" for n in names], wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
        return {r["name"]: json.loads(r["value"]) for r in rows}

    def read(self, kind: str, schema: str) -> DataFrame:
        folders = [e[kind] for e in self.entries().values() if kind in e]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def folder(self, kind: str, name: str) -> str:
        return f"{self.root}/{kind}/{name}-{uuid.uuid4().hex[:8]}"

    def publish(self, name: str, folders: dict[str, str]) -> bool:
        return publish_once(self.spark, f"{self.root}/batches", name, folders)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], parts: int = PARTS):
        self.spark, self.root, self.schema, self.keys, self.parts = spark, root.rstrip("/"), schema, keys, parts

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version that is whole; 0 for a new table."""
        path, fs = self._path("manifests")
        if not fs.exists(path):
            return 0
        return max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """part -> folder."""
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{version}", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        held = self.manifest(version)
        paths = [f"{self.root}/{folder}/part={p}" for p, folder in sorted(held.items()) if only is None or p in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame], DataFrame], before_publishing: Callable[[], None] | None = None) -> list[int]:
        """Merge rows into the table; ``combine`` gets the old and the incoming rows (_new 0 and 1) of the touched parts.

        Returns the parts that were written. ``before_publishing`` is for tests of lost jobs.
        """
        start = self.version()
        held = self.manifest(start)
        touched = [r[0] for r in incoming.select(part_of(self.keys, self.parts)).distinct().collect()]  # at most ``parts`` rows
        if not touched:
            return []
        old = self.read(start, touched)
        both = old.withColumn("_new", F.lit(0)).unionByName(incoming.select(*old.columns).withColumn("_new", F.lit(1)))
        folder = f"v{start + 1}-{uuid.uuid4().hex[:8]}"
        out = combine(both).withColumn("part", part_of(self.keys, self.parts))
        out.repartition(min(len(touched), self.parts), "part").write.partitionBy("part").parquet(f"{self.root}/{folder}")
        path, fs = self._path(folder)
        written = {int(f.getPath().getName()[5:]) for f in fs.listStatus(path) if f.getPath().getName().startswith("part=")}
        if before_publishing:
            before_publishing()
        kept = {p: v for p, v in held.items() if p not in touched}
        if not publish_once(self.spark, f"{self.root}/manifests", str(start + 1), kept | {p: folder for p in written}):
            raise RuntimeError(f"version {start + 1} of {self.root} was published by another writer")
        return sorted(touched)


def upsert_into(table: VersionedTable, incoming: DataFrame, version: str, **kwargs) -> list[int]:
    """The last version of each key stays, incoming rows before known ones of the same version."""
    from pricetide.operators.dedup import first_by

    return table.merge(incoming, lambda both: first_by(both, table.keys, F.desc(version), F.desc("_new")).drop("_new"), **kwargs)
