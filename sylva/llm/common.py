"""Shared helpers: tables in the shared folder, Arrow maps, broadcasts that are unpickled once a process."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch; texts have no length limit, so rows alone would not bound it (one row may still be larger).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir`` or what ``setCheckpointDir`` was given.

    A session of one machine (master ``local``) without one gets a folder under the warehouse; a cluster without one is an error,
    since a folder of one machine is invisible to the others.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/sylva-shared"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes. Spark reads the limit when the plan runs, so the session keeps it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Return freed memory to the system, where the C library can; else a worker keeps the peak of all stages it served."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
    if trim is not None:
        trim(0)


def per_process(key, make: Callable, limit: int = 1):
    """``make()``, kept for later tasks of the same Python worker (functions arrive anew with every task).

    One value, since workers outlive queries: the one before goes first, and its memory back to the system.
    """
    store = sys.modules.setdefault("_sylva_process", types.ModuleType("_sylva_process")).__dict__.setdefault("kept", {})
    if key not in store:
        if len(store) >= limit:
            while len(store) >= limit:
                store.pop(next(iter(store)))
            give_back()
        store[key] = make()
    return store[key]


def share(spark: SparkSession, value) -> Callable:
    """Broadcast a value of this package's types; the returned function gets it on a worker, unpickled once a process."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: per_process(key, lambda: pickle.loads(sent.value))
