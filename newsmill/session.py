"""Session defaults and the shared scratch folder."""

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE may hash-join instead of sort-merge when every build partition is this small, so
    # fetching survivors back by row key does not sort full article rows
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans here hold long expressions; do not send a call site to the JVM for each part
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # rows here carry whole documents or pages: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build(app="newsmill", master=None, **extra):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark, name):
    """A fresh path under the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is unset, as in
    local tests, a temporary folder is made and recorded in the running session.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="newsmill-", dir="/tmp"))
        root = context.getCheckpointDir()
    return f"{_home(spark, root)}/{name}-{uuid.uuid4().hex}"


def _home(spark, root):
    return f"{root.rstrip('/')}/newsmill-{spark.sparkContext.applicationId}"


def clear_scratch(spark):
    """Remove what this application has stored. DataFrames made from it can't be read any more."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        _delete(spark, _home(spark, root))


def _delete(spark, path):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark):
    """Let the JVM find DataFrames that nothing refers to, which is when their shuffle files go.

    What reports on a job may hold it for a moment after it has ended, so call this some work later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_PASSING = ContextVar("passing", default=())


@contextmanager
def passing(spark):
    """Tables stored inside are removed at the end; those stored with ``last`` belong to the scope
    around it, and stay where there is none.

    Keep no other DataFrame of the inside: its shuffle files stay as long as it does.
    """
    paths = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            _delete(spark, path)
        forget(spark)


def stored(df, name, last=False):
    """Write a table that is read more than once, and read it back.

    It lives in the shared folder, so losing an executor costs no recomputation. A scope opened
    with ``passing`` removes it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    scopes = _PASSING.get()[:-1] if last else _PASSING.get()
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df):
    """Remove the files of a stored table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
