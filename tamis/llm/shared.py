"""Scratch folders that the driver and every executor can reach.

A cluster names one folder in ``spark.checkpoint.dir``.  Everything an operator hands from one
pass to another without a shuffle is written there, by tasks, under names of their own, so a
retried task never meets half-written files of its predecessor.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tamis.tables import shared_folder


def base_dir(spark: SparkSession) -> str:
    """The shared folder as a URI; a temporary one only where the session names none and all runs on one machine."""
    return shared_folder(spark)


class _Made(threading.local):
    """Scratch folders that this thread has named, in order."""

    def __init__(self):
        self.uris: list[str] = []


_made = _Made()


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared one."""
    base = base_dir(spark)
    _made.uris.append(f"{base}/tamis/{name}-{uuid.uuid4().hex[:12]}")
    return _made.uris[-1]


def mark() -> int:
    """Where the folders of what begins now will begin."""
    return len(_made.uris)


def finish(spark: SparkSession, df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` as a written table; the scratch folders named since ``mark``, from which it was computed, go."""
    uri = scratch(spark, name)
    out = table(spark, df, uri)
    drop(spark, *[u for u in _made.uris[since:] if u != uri])
    _made.uris[since:] = [uri]
    return out


def drop(spark: SparkSession, *uris: str) -> None:
    """Delete scratch folders through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, df: DataFrame, uri: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None where the folder is in another store."""
    u = urlparse(uri)
    return (u.path or "/") if u.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_chunks(uri: str, chunks: Iterable) -> None:
    """Write a file, piece by piece, so that it appears whole or not at all."""
    path = local_path(uri)
    if path is None:
        store, path = _remote(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:
            for c in chunks:
                out.write(c)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for c in chunks:
            out.write(c)
    os.replace(part, path)


def put_bytes(uri: str, data: bytes) -> None:
    put_chunks(uri, [data])


def open_read(uri: str):
    """A seekable binary reader of a shared file."""
    path = local_path(uri)
    if path is None:
        store, path = _remote(uri)
        return store.open_input_file(path)
    return open(path, "rb")


def put_arrays(uri: str, arrays: dict[str, list[np.ndarray]]) -> None:
    """One file of named arrays, each given in pieces, with a table of their places at its end."""

    def chunks() -> Iterator:
        table, at = {}, 0
        for name, parts in arrays.items():
            start = at
            for p in parts:
                raw = np.ascontiguousarray(p)
                yield raw.data if raw.size else b""
                at += raw.nbytes
            table[name] = [start, at, parts[0].dtype.str]
            yield b"\0" * (-at % 8)
            at += -at % 8
        foot = json.dumps(table).encode()
        yield foot + len(foot).to_bytes(8, "little")

    put_chunks(uri, chunks())


def get_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of such a file: views of one memory map where the shared folder is mounted, else read."""
    path = local_path(uri)
    if path is not None:
        raw = np.memmap(path, np.uint8, "r")
    else:
        with open_read(uri) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(raw[-8:].tobytes(), "little")
    table = json.loads(raw[-8 - size : -8].tobytes())
    return {name: np.asarray(raw[a:b]).view(kind) for name, (a, b, kind) in table.items()}


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in upper or lower case."""
    own = {c.lower() for c in docs.columns}
    while name.lower() in own:
        name += "_"
    return name


def add_up(parts: DataFrame) -> dict[str, np.ndarray]:
    """Sums of vectors (key string, vector binary of doubles) by key.  A task sends one vector a key, and one task adds those of a key.

    Keys and lengths of vectors are the caller's, whatever the input's size; the driver gets one vector a key."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("vector"), strict=True):
                v = np.frombuffer(raw.as_buffer(), float)
                total[key] = total[key] + v if key in total else v
        if total:
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["key", "vector"])

    tasks = parts.sparkSession.sparkContext.defaultParallelism
    summed = parts.select("key", "vector").repartition(tasks, "key").mapInArrow(run, "key string, vector binary")
    return {r.key: np.frombuffer(bytes(r.vector), float) for r in summed.collect()}


def vectors(named: dict[str, np.ndarray]):
    """A batch of such vectors."""
    import pyarrow as pa

    return pa.record_batch([pa.array(list(named), pa.string()), pa.array([np.asarray(v, float).tobytes() for v in named.values()], pa.binary())], names=["key", "vector"])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished passes, which nothing reads again."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a few numbers each that may be broadcast: some tens of megabytes.
MOST_BROADCAST = 1 << 20


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` (a written table) marked for broadcast if its counted rows are few, else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df


def input_bytes(df: DataFrame, text: str) -> int:
    """About how large the input is: the optimizer's estimate, or the texts' bytes where it has none."""
    from pyspark.sql import functions as F

    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55:
        return size
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
