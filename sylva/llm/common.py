"""Helpers shared by the training-data operators: shared storage, words and Arrow streaming."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII blanks (as a Java/RE2/Python regex).
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: ASCII-only lower-casing, so that every engine agrees.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of an Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold at most BATCH_ROWS rows (a long text must not meet thousands of others)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="sylva-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What is told of the tables that materialise writes (see scratch).
_watched: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths of the tables that materialise writes meanwhile."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.remove(made)


#: Spark deletes the shuffle files of an execution at its end, so those of steps that are done don't pile up on the disks.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors.

    The write's own shuffle files go as soon as it has ended; nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylva/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for made in _watched:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table made by materialise, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that materialise has written; does nothing if it is gone."""
    if "/sylva/" in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict | None]]], schema: str) -> DataFrame:
    """mapInArrow with a worker-side factory: make() runs once a task and gives a function from a batch to columns.

    The function yields dicts of columns (lists or arrays); it is called with None at the end of the partition.
    """
    spark = df.sparkSession
    short_batches(spark)
    arrow = to_arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for out in step(batch) or ():
                yield to_batch(out, arrow)
        for out in step(None) or ():
            yield to_batch(out, arrow)

    return df.mapInArrow(run, schema)


def to_batch(out: dict, arrow: pa.Schema) -> pa.RecordBatch:
    cols = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow]
    return pa.RecordBatch.from_arrays(cols, schema=arrow)


def to_arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert
    from pyspark.sql.types import StructType

    return convert(StructType.fromDDL(ddl))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def normal_bytes(text: bytes) -> bytes:
    """Each run of ASCII blanks becomes one space."""
    parts = text.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    if not parts:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(parts) + (b" " if text[-1:].isspace() else b"")


def words(text: str) -> list[str]:
    return re.findall(WORD, text)


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


#: Bits of a filter: so many a key, and no more than MOST_BITS (8 MiB), beyond which it lets more through.
KEY_BITS, MOST_BITS = 12, 1 << 26


def bloom_filter(keys: DataFrame, name: str) -> np.ndarray:
    """A filter over a column of 64-bit hashes: each sets three bits of one word; the words are or-ed where the keys lie."""
    n = 64
    while n < min(MOST_BITS, KEY_BITS * keys.count()):
        n *= 2
    h = F.col(name)
    one = lambda at: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{name}`, {at}) & 63 as int))")
    mask = one(0).bitwiseOR(one(6)).bitwiseOR(one(12))
    words = keys.select((F.shiftrightunsigned(h, 24) % F.lit(n // 64)).cast("int").alias("at"), mask.alias("word"))
    found = words.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(n // 64, np.int64)
    out[found["at"].to_numpy(int)] = found["word"].to_numpy("int64")
    return out


def in_bloom(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    k = keys.astype(np.int64).view(np.uint64)
    bit = lambda at: np.uint64(1) << ((k >> np.uint64(at)) & np.uint64(63))
    mask = bit(0) | bit(6) | bit(12)
    held = words.view(np.uint64)[((k >> np.uint64(24)) % np.uint64(len(words))).astype(np.int64)]
    return (held & mask) == mask


def only(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns (a missing one as null), whatever else the table has and whatever that is called."""
    return docs.select(*[docs[n] if n in docs.columns else F.lit(None).alias(n) for n in names])
