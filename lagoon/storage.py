"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: rows of one task, where their number decides.
ROWS = 1 << 18

_OWN: list[str] = []
_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """The tables that are written inside a ``with`` block of this thread; ``sweep`` deletes those whose readers are done.

    What is left at the end belongs to the block around it, if there is one. Blocks of other threads own their own tables.
    """

    def __init__(self) -> None:
        self.made: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scope:
        self.outer = _SCOPE.get()
        self.token = _SCOPE.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPE.reset(self.token)
        if self.outer is not None:
            self.outer.made += self.made

    def sweep(self, *keep: DataFrame) -> None:
        """Delete this scope's tables but for the files of ``keep``."""
        kept = {x.rsplit("/", 1)[0].rsplit("/", 1)[1] for k in keep for x in k.inputFiles()}
        for spark, path in self.made:
            if path.rsplit("/", 1)[1] not in kept:
                _delete(spark, path)
        self.made = [m for m in self.made if m[1].rsplit("/", 1)[1] in kept]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset and Spark is local (tests), one made for this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lagoon-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage but files that outlive executors, so an iteration's plan does not
    grow and a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagoon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows dealt by ``keys`` over as many tasks as hold some ``ROWS`` each; a small one stays as it is.

    Adaptive execution joins partitions by their compressed bytes; rows that compress well would fill a task's memory.
    """
    if rows <= ROWS:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS + 1), *keys)


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows for a join: at most ``ROWS`` go to every task, so that the other side is not shuffled; for more Spark decides."""
    return F.broadcast(df) if rows <= ROWS else df


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if f.rsplit("/", 1)[1].startswith("lagoon-"):
            _delete(df.sparkSession, f)
