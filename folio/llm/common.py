"""What the operators share: a folder all executors see, and small helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset and the master is local (tests), a local one.

    Executors on other machines would write to their own disks, so there a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="folio-")
    return _local["dir"]


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Workspace:
    """Written tables in the shared folder; they cut lineage, so a lost executor
    costs only a re-read. Tables go when dropped, or when the process ends."""

    _kept: list["Workspace"] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/folio-{label}-{uuid.uuid4().hex[:12]}"
        self._kept.append(self)

    def file(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return a DataFrame over the files."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.file(name))
        return self.spark.read.schema(df.schema).parquet(self.file(name))

    def drop(self, *names: str) -> None:
        for name in names:
            p, fs = _path(self.spark, self.file(name))
            fs.delete(p, True)

    def close(self) -> None:
        p, fs = _path(self.spark, self.path)
        fs.delete(p, True)


@atexit.register
def _close_all() -> None:
    for w in Workspace._kept:
        try:
            w.close()
        except Exception:  # the session may have ended first
            return


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(name: str) -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: others cannot clash."""
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in columns.items()))


__all__ = ["WORD", "Workspace", "fresh", "pick", "shared_dir", "text_of"]
