"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one (tests); on a
    cluster that is an error, as a folder of the driver's own machine is out of the executors' reach."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; named by the application, so that a run's tables are told apart."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/corpusmill/{app}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder, with options of the writer, and reads it back."""
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def clear_staged(spark: SparkSession) -> None:
    """Removes all tables that this application has staged; results that still read them must have been used up."""
    _remove(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what is staged inside, once the block's result has been written elsewhere; on failure all stays for a look."""
    app = spark.sparkContext.applicationId
    before = _written.get(app, [])
    _written[app] = []
    try:
        yield
    except BaseException:
        _written[app] = before + _written[app]
        raise
    inside, _written[app] = _written[app], before
    _remove(spark, inside)
