"""What the operators share: the inputs, the shared folder for cut lineage, and Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in a batch that Spark sends to Python, and bytes of one that an operator works on at a time.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batches to ``BATCH_ROWS`` rows: they hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, through Spark's own reader (any file system Spark knows)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  On a cluster the session names it; only a local session gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="pelago-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: the lineage ends there, so a lost executor costs a
    re-read and not a re-run, and no later plan repeats the work."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for held in _scratch[-1:]:
        held.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(keep: Callable[[], DataFrame]) -> Iterator[DataFrame]:
    """What ``keep`` makes; all other tables that are stored on the way are deleted at the end."""
    _scratch.append([])
    try:
        yield (kept := keep())
        drop(*(t for t in _scratch[-1] if t is not kept))
    finally:
        _scratch.pop()


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`stored` has written, once nothing that is still to run reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name already, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(text.cast("string"), F.lit(""))


def per_batch(make: Callable[[pa.RecordBatch], Iterable[dict | pa.RecordBatch]], schema: pa.Schema | None, rows: int = 512) -> Callable:
    """A ``mapInArrow`` function: ``make`` gets batches of at most ``rows`` rows and about BATCH_BYTES (or one row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows)
                while part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                    part = batch.slice(at, part.num_rows // 2)
                at += part.num_rows
                for out in make(part):
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Sorted batches gathered into tables of about ``rows`` rows or more, cut only where the key changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0))
            apart = any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, values, strict=True))
            cut = int(change[-1]) + 1 if len(change) else 0 if apart else -1
            if cut >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
