"""Best-fit packing of documents into sequences of several permitted lengths.

Items go from the longest down. Each takes the open bin in which it leaves the least room. Where none has room, a bin is
opened: for each permitted length that holds the item, the bin is filled, on trial, with the lengths that still wait, the
longest that fits first, and cut down to what that needs; the length of least cost for each token held is opened. At the end
each bin shrinks to the shortest permitted length that holds its contents. A shard is packed in this way with every choice of
permitted lengths that has the longest, and the cheapest packing is kept, so that it never costs more than one length alone.

A sequence costs its tokens, each the more the longer the sequence is, as attention goes over all before it, and a fixed
overhead. Rows are dealt at random into shards of about SHARD_ROWS, which lose next to nothing against one packing of all, and
each shard is packed by a task on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, materialize, table, words_of

#: Permitted lengths; what a sequence costs besides its tokens; the length at which a token costs twice as much as in a short one.
SIZES, OVERHEAD, SPAN = (512, 1024, 2048, 4096), 64, 8192
SHARD_ROWS = 8_192


def cost(size: int | np.ndarray, overhead: int = OVERHEAD, span: int = SPAN) -> float | np.ndarray:
    """What a sequence of that length costs."""
    return overhead + size * (1 + size / span)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and `n_tokens`: the words of its whole text and one end mark; a null text has the end mark alone."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = np.concatenate([np.diff(words_of(b).bounds) for b in blocks(batch.column(1))]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")), run, f"id {kind}, n bigint").toDF(id_col, "n_tokens")


def _trial(room: int, left: list[int], present: int) -> int:
    """Tokens that a bin's room takes from the waiting lengths, the longest that fits first; bit n of present: length n waits."""
    held, used = 0, {}
    while True:
        fits = present & ((2 << (room - held)) - 1)
        if not fits:
            return held
        n = fits.bit_length() - 1
        take = min((room - held) // n, left[n] - used.get(n, 0))
        held += take * n
        used[n] = used.get(n, 0) + take
        if used[n] == left[n]:
            present &= ~(1 << n)


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items of 1..max(sizes) tokens: each one's bin, its place in the bin, and each bin's final size. Equal lengths keep their order."""
    sizes = tuple(sorted(sizes))
    final = np.array(sizes)
    price = {b: cost(b, overhead, span) for b in sizes}
    left = np.bincount(lengths, minlength=sizes[-1] + 1).tolist()
    present = sum(1 << n for n, c in enumerate(left) if c and n)
    with_room: dict[int, list[int]] = {}  # open bins by room left
    rooms = 0  # bit r: a bin with room r is open
    used: list[int] = []
    bin_of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            least = None
            for size in sizes:
                if size >= n:
                    held = n + _trial(size - n, left, present)
                    per_token = price[sizes[int(np.searchsorted(final, held))]] / held
                    # of equal costs the longer: it takes more
                    if least is None or per_token <= least[0]:
                        least = per_token, size
            room, b = least[1], len(used)
            used.append(0)
        bin_of[i], place[i] = b, used[b]
        used[b] += n
        if room > n:
            with_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bin_of, place, final[np.searchsorted(final, used)] if used else np.zeros(0, np.int64)


def cheapest_fit(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_fit() with each choice of sizes that has the largest, to which bins are downsized from all sizes; the cheapest, the fewest sizes first."""
    *others, most = sorted(sizes)
    final, best = np.array([*others, most]), None
    for k in range(len(others) + 1):
        for some in combinations(others, k):
            bin_of, place, size = best_fit(lengths, (*some, most), overhead, span)
            held = np.bincount(bin_of, lengths, len(size)).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
            size = final[np.searchsorted(final, held)]
            total = float(cost(size, overhead, span).sum())
            if best is None or total < best[0]:
                best = total, bin_of, place, size
    return best[1:]


def pack(counts: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, span: int = SPAN, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """A row per piece of document: its id, piece, first token and number of tokens, its bin, the bin's length and its place there.

    Documents longer than the largest length are cut into pieces of that length and a rest. Lengths of null or less than 1
    hold nothing and give no row. Repeated ids are documents of their own. Documents of equal length are packed in the order of
    their rows, of bins with equal room the one that last took an item is taken. An empty table gives an empty result; other columns are not read.
    """
    most = max(sizes)
    kind = counts.schema[id_col].dataType.simpleString()
    rows = counts.select(F.col(id_col).alias("id"), F.col(length_col).cast("long").alias("n")).filter("n >= 1").withColumn("row", F.monotonically_increasing_id())
    # the row numbers are written, so every later attempt deals the rows alike
    pieces = materialize(rows.select("id", "n", "row", F.posexplode(F.array_repeat(F.lit(0), F.ceil(F.col("n") / most).cast("int"))).alias("piece", "_")).drop("_"))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * most).withColumn("tokens", F.least(F.lit(most).cast("long"), F.col("n") - F.col("start")))
    shards = max(1, -(-pieces.count() // SHARD_ROWS))
    dealt = pieces.select(F.pmod(F.xxhash64("id", "row", "piece"), F.lit(shards)).alias("shard"), "id", "row", "piece", "start", "tokens")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece"], ignore_index=True)
        bin_of, place, size = cheapest_fit(frame.tokens.to_numpy(np.int64), sizes, overhead, span)
        return frame[["id", "piece", "start", "tokens"]].assign(bin=frame.shard.astype(str) + "-" + pd.Series(bin_of.astype(str)), bin_size=size[bin_of], bin_start=place)

    schema = f"id {kind}, piece int, start bigint, tokens bigint, bin string, bin_size bigint, bin_start bigint"
    return dealt.groupBy("shard").applyInPandas(run, schema).withColumnRenamed("id", id_col)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))
