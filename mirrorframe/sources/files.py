"""Opening files by URI inside tasks, and listing them with Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def opened(uri: str):
    """A seekable binary stream, on whatever file system the URI names."""
    from pyarrow import fs

    uri = uri.replace("file:///", "/").removeprefix("file:") if uri.startswith("file:") else uri
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    with system.open_input_file(path) as stream:
        yield stream


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files below `root`; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        .select("path", "length", "modificationTime")
    )


def children(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """`name`: distinct path parts `depth` levels below `root` that hold files."""
    files = listing(spark, root)
    # Paths come back as file:/..., s3a://... and so on; `root` is found in them as plain text.
    home = re.sub("^file:/+", "/", root.rstrip("/")) + "/"
    below = F.split(F.expr("substring(path, instr(path, home) + length(home))"), "/")
    files = files.withColumn("home", F.lit(home)).where("instr(path, home) > 0")
    return files.select(below.alias("parts")).where(F.size("parts") > depth).select(
        F.element_at("parts", depth).alias("name")
    ).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def batches(rows: Iterator, size: int) -> Iterator[list]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
