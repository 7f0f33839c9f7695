"""What the operators of this package share: table access, Arrow mapping over texts, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes that one Arrow batch may carry to a Python worker. Long texts make small batches.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20
#: Rows that the Parquet reader decodes at once: whole texts are large, its usual thousands of rows are many MB on the heap.
READER_ROWS = 512
#: Characters that a text function gets at once within a batch.
CHUNK_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within BATCH_ROWS and BATCH_BYTES, and decoded Parquet batches within READER_ROWS.

    Spark reads these settings when a plan runs, so they can neither be given for one DataFrame nor be put back here. They are only
    ever lowered, and always to the same values, so that the order of calls makes no difference.
    """
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        now = str(spark.conf.get(key))
        if not (now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(key, str(bound))


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of consecutive texts with at most ``limit`` characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[list]]],
    fields: T.StructType,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns computed from the whole text of each row, in one narrow pass without a shuffle.

    ``make`` runs once per task and returns a function from a list of texts to one list per field.
    Null texts count as empty. Columns in ``keep`` pass through unchanged; where a kept column has
    the name of a result, the result stands and the kept column goes. Other columns are not read.
    """
    bound_batches(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    made_types = [f.type for f in to_arrow_schema(fields)]
    n = len(keep)
    source = df.select(*[df[c] for c in keep], df[text_col].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(n).to_pylist()]
            for part in chunks(texts):
                got = fn(texts[part])
                kept = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(n)]
                made = [pa.array(v, type=t) for v, t in zip(got, made_types, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)

    return source.mapInArrow(run, schema)


def local_folder(prefix: str) -> str:
    """A folder of this machine, for a local master only; it goes when the driver ends."""
    folder = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the one that the session or context names; only a local master gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = local_folder("checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the reliable checkpoint folder; the plan behind them is cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder under the shared one for what a query writes and reads again; it is deleted when the driver ends with its JVM still up."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Exception):  # a JVM that is gone
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(conf).delete(hadoop, True)

    atexit.register(remove)
    return path


def hash_order(col: str):
    """A fixed pseudo-random order of rows by an id, the same on every run and at every size."""
    return F.xxhash64(F.lit("order"), F.col(col))
