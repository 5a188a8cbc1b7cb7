"""Shared helpers: the cluster's shared folder, Arrow batches as byte blocks, vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is handled in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows go to Python in batches of about so many bytes; a longer row is a batch of its own. Spark's 64 MB stand in the executor and its worker at once.
BATCH_BYTES = 1 << 23

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, in a local session (as in tests) alone, a new one that this session then uses."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("larder.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-larder-")
        spark.conf.set("larder.checkpoint.dir", conf)
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larder-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number of its own for each row, and that column's name. It is written, so every reader and every attempt has the same."""
    name = "row"
    while name in df.columns:
        name += "_"
    return materialize(df.withColumn(name, F.monotonically_increasing_id())), name


def written() -> int:
    """How many tables materialize() has written and cleanup() has not deleted."""
    return len(_written)


def cleanup(spark: SparkSession, first: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that materialize() wrote in this process, but for the `first` oldest and those of `keep`; results that read them are void afterwards."""
    jvm, stay = spark.sparkContext._jvm, {df.written_to for df in keep}
    for name in [x for x in _written[first:] if x not in stay]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(name)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop shuffles and broadcasts that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches of BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


@dataclass
class Block:
    """Rows lo..hi of a batch: the bytes of their texts end to end, and where each starts."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole texts; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, content = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


#: A word is a run of bytes other than space and \t \n \v \f \r.
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """All words of a block: byte bounds, and at bounds[r]..bounds[r+1] those of row r."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words_of(block: Block) -> Words:
    data, offsets = block.data, block.offsets
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_WORD[data]
    before, after = inside[:-1].copy(), inside[1:]
    first = offsets[:-1][offsets[:-1] < n]
    # a text's first byte starts a word even where the text before it ends in one
    starts = after[:-1] & ~before[:-1]
    starts[first] = after[first]
    starts = np.flatnonzero(starts)
    ends = before[1:] & ~after[1:]  # at i: byte i is in a word, byte i + 1 isn't
    last = first[first > 0] - 1
    ends[last] = before[last + 1]
    ends = np.flatnonzero(ends) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit fingerprint of each span of bytes; equal spans have equal fingerprints."""
    n = len(data)
    value = _VALUE[LOWER[data]] if lower else _VALUE[data]
    value *= _powers_of(_BASE, n) if n else np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix((total[ends] - total[starts]) * (_powers_of(_INVERSE, n + 1)[starts] if n else np.uint64(1)) + (ends - starts).astype(np.uint64))
