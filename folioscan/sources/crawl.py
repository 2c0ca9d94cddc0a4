"""Files below a list of directories, with what the index keeps of them.

Directories are listed on the executors, which must see the same files; each level of the tree is a job of its own, so a
deep or uneven tree spreads over all tasks, and the crawl goes on until a level is empty. Hidden entries are left out;
links are followed, once for each real path, so the crawl ends whatever they point to; what cannot be read is left out."""

from __future__ import annotations

import os
import stat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.schema import FILES
from folioscan.storage import scratch_path

LISTING = "device bigint, inode bigint, mtime bigint, parent string, file string, is_dir boolean, real string"


def _listed(batches):
    for b in batches:
        rows = []
        for folder, parent in zip(b["file"], b["parent"]):
            try:
                names = sorted(os.listdir(folder))
            except OSError:
                continue
            for n in names:
                if n.startswith("."):
                    continue
                path = f"{folder.rstrip('/')}/{n}"
                try:
                    s = os.stat(path)
                except OSError:
                    continue
                if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode):
                    rows.append((s.st_dev, s.st_ino, int(s.st_mtime), parent, path, stat.S_ISDIR(s.st_mode), os.path.realpath(path)))
        yield pd.DataFrame(rows, columns=["device", "inode", "mtime", "parent", "file", "is_dir", "real"])


def _roots(batches):
    for b in batches:
        rows = [(r.rstrip("/") or "/", os.path.dirname(r.rstrip("/")), True, os.path.realpath(r)) for r in b["file"]]
        yield pd.DataFrame(rows, columns=["file", "parent", "is_dir", "real"]).reindex(columns=["device", "inode", "mtime", "parent", "file", "is_dir", "real"])


def crawl(spark: SparkSession, roots: list[str] | DataFrame) -> DataFrame:
    """(device, inode, mtime, parent, file); parent is the directory that holds the root in which a file was found.
    ``roots``: paths, or a table of any size with a column ``file``. What each level lists is written below one folder, so
    the plan does not grow with the depth."""
    if isinstance(roots, list):
        roots = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "file string")
    width, folder = max(1, spark.sparkContext.defaultParallelism), scratch_path(spark, "listing")
    roots.select("file").distinct().mapInPandas(_roots, LISTING).write.parquet(f"{folder}/level=0")
    depth = 0
    while True:
        listed = spark.read.schema(LISTING + ", level int").parquet(folder)
        # of each real path the first level that has it, and there one name of it
        level = listed.filter("is_dir").groupBy("real").agg(F.min(F.struct("level", "file", "parent")).alias("m")).select("m.*").filter(F.col("level") == depth)
        level.select("file", "parent").repartition(width, "file").mapInPandas(_listed, LISTING).write.parquet(f"{folder}/level={depth + 1}")
        depth += 1
        if spark.read.schema(LISTING).parquet(f"{folder}/level={depth}").filter("is_dir").isEmpty():
            return spark.read.schema(LISTING + ", level int").parquet(folder).filter("not is_dir").select(*FILES.names).dropDuplicates(["file"])


def directories(lines: DataFrame) -> DataFrame:
    """Directories of a configuration, one path on each line of ``value``, as a table for ``crawl``: any number of them."""
    return lines.select(F.trim("value").alias("file")).filter("file <> '' and not startswith(file, '#')").distinct()
