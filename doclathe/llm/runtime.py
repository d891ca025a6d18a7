"""What every operator here needs from the session: shipped code, lineage cuts, table paths."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application; where the size of Arrow batches is left at Spark's 64 MB, make it 8 MB, since whole texts
    are in them and each is held by the JVM and by Python."""
    if spark.conf.get(BATCH) in ("67108864b", "64m", "64MB"):
        spark.conf.set(BATCH, "8m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    # The driver serves the zip to the executors itself; no executor opens this path.
    path = os.path.join(tempfile.mkdtemp(), "doclathe_pkg.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own if Spark runs in one process; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="doclathe-ckpt-"))  # one process: its own folder is shared
    return sc.getCheckpointDir()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a query as soon as it has ended: for queries whose results are written, so that nothing reads those files again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table written to the shared folder: smaller than a checkpoint, which isn't compressed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete tables of store() that nothing reads any more."""
    for df in stored:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Whole groups of sorted rows, whatever batches they come in; small groups come together, until they are `least` rows. No more than
    that, one batch and one group are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        whole = pa.Table.from_batches([*held, batch])
        cols = [whole.column(c).to_numpy() for c in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        lo = 0
        if len(cuts) and (least <= 1 or int(cuts[-1]) >= least):
            for hi in cuts.tolist() if least <= 1 else [int(cuts[-1])]:
                yield whole.slice(lo, hi - lo)
                lo = hi
        held = whole.slice(lo).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of ours through Hadoop's file system API."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
