"""Session utilities: where intermediate tables go, and how workers find this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the
    context's checkpoint directory, else (in local mode alone, as in tests) a
    folder of our own: a cluster's executors couldn't see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="meshwright-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and reread it.

    Void columns can't be written; they become strings. The table outlives the
    loss of any executor, and rereading it prunes columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    void = {c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"}
    (df.withColumns(void) if void else df).write.parquet(path)
    return spark.read.schema((df.withColumns(void) if void else df).schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a checkpointed frame that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that an Arrow batch to a Python worker has at most, unless the session has its own setting.
BATCH_ROWS = 1000


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and
    keep their batches small: whole documents in batches of the default 10,000
    rows would be held in memory several times over.

    On a cluster without a common file system, ship it with ``--py-files``.
    """
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
