"""Shared run-time helpers: durable intermediates, size-checked broadcasts, one-pass aggregates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only after it was counted to hold no more rows than this.
BROADCAST_ROWS = 200_000
# Levels that become columns (pivots, one-hot): more than this is an error, never a silent cut.
MAX_LEVELS = 10_000
# Spark's switch (4.1) that removes an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCAL_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediates, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a temporary folder, one for its lifetime.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="staylens-")
    return _LOCAL_ROOT[app]


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage, survives lost executors, fixes the bits of computed doubles that are
    read more than once, and gives Catalyst the true size for its join choice. Shuffle files of the
    write go when it has ended, not when the driver happens to collect its garbage.
    """
    path = path or f"{checkpoint_root(df.sparkSession)}/staylens-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind; for runs whose result is stored and whose plan is not run again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


class Rounds:
    """Stored tables of an iteration: each round reads what the one before has written, and drops it when done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0

    def place(self) -> str:
        """A folder that nothing was written to yet."""
        self._n += 1
        return f"{self.root}/{self._n}"

    def put(self, df: DataFrame) -> DataFrame:
        path = self.place()
        out = materialize(df, path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = self._paths.pop(id(df), None)
            if path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a counted bound; past the bound the plan is left to Catalyst and AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def distinct_levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values of a column whose values are to become columns."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} distinct values, too many for columns")
    return sorted(r[0] for r in rows)


def column_names(values: list[str], taken: list[str] = ()) -> list[str]:
    """Names for columns made from data values: no dots or backticks, none twice, none already taken."""
    used, out = {t.lower() for t in taken}, []
    for v in values:
        base = v.replace(".", "_").replace("`", "_") or "blank"
        name, k = base, 2
        while name.lower() in used:
            name, k = f"{base} ({k})", k + 1
        used.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of few splits (small, gzipped or single-row-group files) over all cores.

    For row work that is much heavier than the read. A scan that already has a split per core is returned
    as it is, so large tables are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def side_by_side(fn: Callable, items: Iterable, threads: int = 5) -> list:
    """Run independent fits over the same cached data at once, so that one fills the gaps of the other."""
    tasks = [inheritable_thread_target(lambda item=item: fn(item)) for item in items]
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda task: task(), tasks))
