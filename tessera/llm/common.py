"""What the operators share: word patterns, the shared scratch folder and file access."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE)).otherwise(F.array().cast("array<string>"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one is set only where none is and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, a query's shuffle files go when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ran(df: DataFrame) -> None:
    """Run df for what its tasks write."""
    with shuffles_dropped(df.sparkSession):
        df.write.format("noop").mode("overwrite").save()


def input_bytes(df: DataFrame) -> int:
    """Size of what df reads, as the optimizer sees it; 256 MB where it cannot tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, size) if size < 1 << 60 else 1 << 28


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Files:
    """Files of a shared folder, for the driver and the workers.

    A ``file:`` folder is one that all machines mount; others (hdfs, s3, ...) go through
    pyarrow's file systems, and are copied to the worker's own folder before they are mapped.
    """

    def __init__(self, root: str):
        self.root = root
        self.local = root[5:] if root.startswith("file:") else root if root.startswith("/") else None
        if self.local is not None:
            self.local = "/" + self.local.lstrip("/")

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, name: str, data) -> None:
        """Whole or not at all: a retried or second attempt of a task replaces the file."""
        if self.local is not None:
            Path(self.local).mkdir(parents=True, exist_ok=True)
            part = Path(self.local, f".{name}.{uuid.uuid4().hex}")
            with part.open("wb") as out:
                for piece in data:
                    out.write(piece)
            part.rename(Path(self.local, name))
            return
        store, base = self._remote()
        store.create_dir(base, recursive=True)
        part = f"{base}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            for piece in data:
                out.write(piece)
        store.move(part, f"{base}/{name}")

    def path(self, name: str) -> str:
        """A path that can be memory-mapped here."""
        if self.local is not None:
            return f"{self.local}/{name}"
        mine = Path(tempfile.gettempdir(), "tessera-" + uuid.uuid5(uuid.NAMESPACE_URL, self.root).hex)
        mine.mkdir(exist_ok=True)
        if not (mine / name).exists():
            store, base = self._remote()
            part = mine / f".{name}.{uuid.uuid4().hex}"
            with store.open_input_stream(f"{base}/{name}") as src, part.open("wb") as out:
                shutil.copyfileobj(src, out)
            part.rename(mine / name)
        return str(mine / name)
