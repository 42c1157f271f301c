"""A chunk store: Parquet files by a hash of the scope, replaced scope by scope.

A part (a hash value) is a folder of its own, and a small manifest names the folder of every part.
An upsert writes new folders, then a new manifest; readers see the old state or the new one.  Nothing
that is read is overwritten, so a lost executor recomputes from files that are still there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def _part(parts: int):
    return F.pmod(F.xxhash64("scope"), F.lit(parts)).cast("int")


class _Folder:
    """Listing, reading and replacing small files through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file appears whole under its name, which must be new."""
        made = self.at(f"{name}.{uuid.uuid4().hex}")
        out = self.fs.create(made, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(made, self.at(name)):
            raise OSError(f"{name} was written by another upsert")

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifest(folder: _Folder) -> dict:
    """The newest manifest: its number, how many parts there are, and the folder of each that has rows."""
    found = [n for n in folder.names("manifests") if n.endswith(".json")]
    return json.loads(folder.read(f"manifests/{found[-1]}")) if found else {"number": 0, "parts": None, "folders": {}}


def upsert(spark: SparkSession, path: str, incoming: DataFrame, parts: int = PARTS) -> None:
    """Replace the scopes that ``incoming`` has; others, also in the same parts, stay.  Nothing happens for no rows.

    ``parts``: for a new store; an existing one keeps its number.  One upsert runs at a time."""
    folder = _Folder(spark, path)
    now = _manifest(folder)
    parts = now["parts"] or parts
    name = f"data-{uuid.uuid4().hex[:12]}"
    # Incoming rows are computed once.
    incoming.withColumn("part", _part(parts)).repartition("part", "scope").write.partitionBy("part").parquet(f"{path}/{name}/new")
    touched = [n.removeprefix("part=") for n in folder.names(f"{name}/new") if n.startswith("part=")]
    if not touched:
        folder.drop(name)
        return
    folders = dict(now["folders"])
    stale = {k: folders[k] for k in touched if k in folders}
    new = spark.read.parquet(f"{path}/{name}/new")
    if stale:
        old = spark.read.parquet(*[f"{path}/{f}" for f in stale.values()]).withColumn("part", _part(parts))
        scopes = new.select(F.col("scope").alias("__s")).distinct()
        kept = old.join(scopes, old.scope.eqNullSafe(F.col("__s")), "left_anti")
        kept.repartition("part", "scope").write.partitionBy("part").parquet(f"{path}/{name}/kept")
    for k in touched:
        moved = [kind for kind in ("new", "kept") if f"part={k}" in folder.names(f"{name}/{kind}")]
        for kind in moved:
            for f in folder.names(f"{name}/{kind}/part={k}"):
                if not f.startswith(("_", ".")):
                    folder.fs.mkdirs(folder.at(f"{name}/part-{k}"))
                    folder.fs.rename(folder.at(f"{name}/{kind}/part={k}/{f}"), folder.at(f"{name}/part-{k}/{f}"))
        folders[k] = f"{name}/part-{k}"
    folder.drop(f"{name}/new")
    folder.drop(f"{name}/kept")
    folder.write(f"manifests/{now['number'] + 1:012d}.json", json.dumps({"number": now["number"] + 1, "parts": parts, "folders": folders}))
    for f in stale.values():
        folder.drop(f)


def read_scope(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """Rows of a scope, from its part alone; of all scopes for None or an empty name."""
    now = _manifest(_Folder(spark, path))
    if not now["folders"]:
        raise FileNotFoundError(f"{path} holds no store")
    if not scope:
        return spark.read.parquet(*[f"{path}/{f}" for f in now["folders"].values()])
    part = spark.range(1).select(F.lit(scope).alias("scope")).select(_part(now["parts"])).first()[0]
    own = now["folders"].get(str(part)) or next(iter(now["folders"].values()))
    return spark.read.parquet(f"{path}/{own}").where(F.col("scope") == scope)
