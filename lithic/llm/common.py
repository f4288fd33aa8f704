"""Small helpers that several operators of this folder use."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; such files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and whole text only; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Bytes of a batch that are turned into Python objects at a time, about.
SLICE_BYTES = 2 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES, so that a task's memory doesn't grow with batches."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


#: Bytes of an Arrow batch on its way to a worker: both sides hold a few of them a task.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_small_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session whose Arrow batches are bounded in bytes and not in rows only;
    a bound that the session has already stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``make()`` once a task and its result on every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in sliced(batch):
                yield step(part)
        del step
        give_back()

    return with_small_batches(rows).mapInArrow(run, schema)


def content_key(text: Column) -> Column:
    """A 128-bit key of a text: equal texts have equal keys."""
    return F.md5(text.cast("binary"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; one of our own only in a local session."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def let_go(spark: SparkSession) -> None:
    """Collect garbage on the driver between rounds: only then Spark deletes the shuffles, broadcasts
    and checkpoints that nothing refers to any more, and the driver's heap shrinks again."""
    spark._jvm.java.lang.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: smaller than a checkpoint.

    ``spent`` are earlier such tables that nothing reads once this one is there; they are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in spent:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.held_in)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
