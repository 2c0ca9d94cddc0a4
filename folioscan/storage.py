"""Where intermediate tables live, and how tables of a data folder are read.

Everything that must outlive an executor is written as Parquet below ``spark.checkpoint.dir``, which all executors
share. Only where that setting is missing (tests, a laptop) a folder of the local machine is taken.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; set from ``spark.checkpoint.dir``, or a local one when that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folioscan-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _made[folder] = spark
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/folioscan/{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def publish_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text in one step; False if it is there already. Of several writers just one succeeds: the
    draft is linked into place on a local file system, elsewhere renamed by a rename that never replaces."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    final = hadoop.Path(path)
    draft = hadoop.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(final.getParent())
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted, without hidden ones; none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(target)) if not n.startswith("."))


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system of the executors knows it; None on a file system that is not mounted."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    return target.toUri().getPath() if scheme == "file" else None


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


@atexit.register
def _tidy() -> None:
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            pass
    _made.clear()
