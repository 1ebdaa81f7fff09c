"""Shared working folders and byte files that every executor can reach.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that is unset and the master is this machine (a test) a local folder is set.
Files are written through ``pyarrow.fs``, so any scheme it knows (file, hdfs, s3,
gs) will do, and are committed by a rename: a task that is run again writes the
same bytes under the same name, and a half-written file is never seen.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; sets one where none is configured and all tasks run on this machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if path := spark.sparkContext.getCheckpointDir():
        return path
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="nightframe-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder (not created yet)."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read again."""
    return _stored(df, new_folder(df.sparkSession, what))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows beyond which no side of a join may be broadcast.
BROADCAST_ROWS = 1 << 18


def dealt(df: DataFrame, many: bool) -> DataFrame:
    """``df`` for a join that deals out both sides where there are ``many`` rows: a small file can hold millions, which a broadcast passes through the driver."""
    return df.hint("merge") if many else df


class Working:
    """Tables of the shared folder that are removed once all that was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(new_folder(self.spark, what))
        return _stored(df, self.paths[-1])

    def clear(self, but_last: int = 0) -> None:
        """Removes all tables, or all but the latest ones."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        while len(self.paths) > but_last:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            path.getFileSystem(conf).delete(path, True)


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def committed(uri: str):
    """A binary sink that appears under ``uri`` only once it is complete."""
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as sink:
        yield sink
    system.move(part, path)


def reader(uri: str):
    """A seekable binary source."""
    system, path = _open(uri)
    return system.open_input_file(path)
