"""What the corpus operators have in common: tables, written intermediates, tasks over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortry.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="cohortry-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/cohortry-{uuid.uuid4().hex}"


def written(df: DataFrame, by: list[str] | None = None, rows: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and go on from the files.

    Files have at most ``rows`` rows, if given: a reader holds up to 4,096 rows of a file at
    once, too many where a row is megabytes.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", rows)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_tasks(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(task, schema)


def with_fields(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` and further fields, whatever its columns are called."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def portions(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` in a portion hold about ``limit`` bytes; no row is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, limit // each)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


class Bounded(dict):
    """What a worker remembers, up to about ``limit`` bytes; beyond that it starts again.

    ``each`` estimates the bytes of an entry beside its key. Results never depend on it.
    """

    limit = 24_000_000
    each = 120

    def __init__(self) -> None:
        super().__init__()
        self.held = 0

    def keep(self, key, value):
        self.held += len(key) + self.each
        if self.held > self.limit:
            self.clear()
            self.held = len(key) + self.each
        self[key] = value
        return value


_state: tuple[object, object] = (None, None)


def worker_state(name: object, make: Callable[[], object]) -> object:
    """What tasks of one operator share in a Python worker: one thing at a time.

    Workers outlive stages, so the state of one operator is dropped when the next one asks.
    """
    global _state
    if _state[0] != name:
        _state = (None, None)
        _state = (name, make())
    return _state[1]


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id's text modulo ``of``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0))


def spread_rows(df: DataFrame, column: str) -> DataFrame:
    """A small table that is read in fewer tasks than there are cores is dealt to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, column)


def runs(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Consecutive rows with one value of ``column``, also across batches, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(column))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected to by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    return root
