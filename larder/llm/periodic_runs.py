"""Periodic runs of words: common extensions by a difference cover drive an enumeration of runs over harmonic grids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, hash_spans, map_arrow, table, words_of

#: A perfect difference set: every difference modulo PERIOD is that of two members, so any two places are in the cover after fewer than PERIOD steps.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: A run repeats its period so often at least, and has so many words at least.
EXPONENT, LEAST = 4, 6
#: Pairs of places that are looked at together.
PAIRS = 1 << 20
#: Words that one number of a sort key holds.
PACKED = 3

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
#: _STEPS[a, b]: the fewest steps that bring places congruent to a and b into the cover together.
_STEPS = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)], np.int8)


class Extensions:
    """How far words agree from two places on. `words`: numbers from 1 on; 0 follows their end.

    Only suffixes that begin in the difference cover are sorted. Two places first go step by step, fewer than PERIOD, until
    both are in the cover; from there the least common prefix between neighbours of the sorted order answers, by a sparse table.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(PERIOD + PACKED, np.int64)])

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(number of each cover place, its rank, the sparse table of common prefixes of neighbours in rank)."""
        places = np.flatnonzero(_IN_COVER[np.arange(self.n) % PERIOD])
        m, number = len(places), np.full(self.n + 1, -1, np.int64)
        number[places] = np.arange(m)
        rank, base = np.zeros(m, np.int64), int(self.words.max()) + 1
        tied = np.arange(m)

        def refine(tied: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Places of equal rank are parted by key; a rank is the number of places before. Those still tied are returned."""
            order = np.lexsort((key, rank[tied]))
            tied, key = tied[order], key[order]
            group = rank[tied]
            begins = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            at = np.arange(len(tied))
            head = at[begins][np.cumsum(begins) - 1]
            rank[tied] = group + head - first[np.searchsorted(first, at, "right") - 1]
            alone = begins & np.concatenate([begins[1:], [True]])
            return tied[~alone]

        # by the first words, PACKED at a time, until PERIOD of them are known; then by the ranks further on, which are in the cover too
        step = PACKED if base < 1 << 20 else 1
        for k in range(0, PERIOD, step):
            if not len(tied):
                break
            key = np.zeros(len(tied), np.int64)
            for j in range(step):
                key = key * base + self.words[np.minimum(places[tied] + k + j, self.n + PERIOD)]
            tied = refine(tied, key)
        levels, known = [(PERIOD, rank.copy())], PERIOD
        while len(tied):
            on = number[np.minimum(places[tied] + known, self.n)]
            tied = refine(tied, np.where(on >= 0, rank[on], -1))
            known *= 2
            levels.append((known, rank.copy()))
        # common prefixes of neighbours: down the levels of equal ranks, then word by word
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for length, ranks in reversed(levels):
            x, y = number[np.minimum(a, self.n)], number[np.minimum(b, self.n)]
            same = np.flatnonzero((x >= 0) & (y >= 0) & (ranks[x] == ranks[y]) & (x != y))
            common[same] += length
            a[same] += length
            b[same] += length
        common += self._walk(a, b, np.full(len(a), PERIOD + PACKED))
        sparse = [common]
        while 2 << len(sparse) - 1 <= len(common):
            half = 1 << len(sparse) - 1
            sparse.append(np.minimum(sparse[-1][:-half], sparse[-1][half:]))
        return number, rank, sparse

    def _walk(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree, looking at `most` words at most, fewer than the padding."""
        out, todo = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        for k in range(int(most.max(initial=0))):
            x = self.words[np.minimum(a[todo] + k, self.n)]
            todo = todo[(x == self.words[np.minimum(b[todo] + k, self.n)]) & (x > 0)]
            out[todo] += 1
            todo = todo[most[todo] > k + 1]
            if not len(todo):
                break
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of words that agree from places a and b (a < b) on."""
        steps = _STEPS[a % PERIOD, b % PERIOD].astype(np.int64)
        out = self._walk(a, b, steps)
        on = np.flatnonzero((out == steps) & (b + steps < self.n))
        if not len(on):
            return out
        number, rank, sparse = self._sorted
        x, y = rank[number[a[on] + steps[on]]], rank[number[b[on] + steps[on]]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        found = np.empty(len(on), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            found[at] = np.minimum(sparse[k][lo[at]], sparse[k][hi[at] - (1 << k)])
        out[on] += found
        return out


@dataclass
class Runs:
    """row: the text; start, stop: places of words in it; by row, start, period."""

    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    period: np.ndarray


def find_runs(words: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> Runs:
    """All runs of texts, the r-th of words[bounds[r]:bounds[r + 1]] (numbers from 0 on).

    A run of period q and `exponent` periods holds a place i of the grid of every (exponent - 1) * q words, and i + q. So for
    each period the grid's places are extended both ways to all that agrees with what stands q words on. What is found for
    several periods has the least of them as its own.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    counts = np.diff(bounds)
    n, texts = int(bounds[-1]), len(counts)
    # a word of its own before each text, so that nothing agrees beyond
    row_of = np.repeat(np.arange(texts), counts)
    place = np.arange(n) + row_of + 1
    line = np.empty(n + texts, np.int64)
    line[place] = words + 1
    top = int(words.max(initial=0)) + 2
    parted = bounds[:-1] + np.arange(texts)
    line[parted] = top + np.arange(texts)
    begin, end = parted + 1, parted + 1 + counts
    forwards, backwards = Extensions(line), Extensions(line[::-1].copy())
    last = len(line) - 1
    most = counts // exponent
    text = np.repeat(np.arange(texts), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = (exponent - 1) * period
    points = (counts[text] - period + grid - 1) // grid
    total, found, lo = np.cumsum(points), [np.zeros((0, 4), np.int64)], 0
    while lo < len(points):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        own = points[lo:hi]
        pick = np.repeat(np.arange(lo, hi), own)
        q = period[pick]
        i = begin[text[pick]] + (np.arange(len(pick)) - np.repeat(np.cumsum(own) - own, own)) * grid[pick]
        same = np.flatnonzero(line[i] == line[i + q])
        i, q, t = i[same], q[same], text[pick[same]]
        right = forwards.common(i, i + q)
        # one place back from both: in the line turned around, the later one comes first
        left = backwards.common(last - (i + q) + 1, last - i + 1) if len(i) else right
        long = right + left + q >= np.maximum(exponent * q, least)
        rows = np.stack([t, i - left, i + q + right, q], 1)[long]
        found.append(np.unique(rows, axis=0))
        lo = hi
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])[: len(rows)]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return Runs(rows[:, 0], rows[:, 1] - begin[rows[:, 0]], rows[:, 2] - begin[rows[:, 0]], rows[:, 3])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Per row of docs its id, n_words, `runs` (start, length, period in words, by start, then period) and `collapsed`: the words that no run repeats, joined by single spaces.

    A run is a stretch of consecutive words with smallest period q, of at least max(least, exponent * q) words, that no
    neighbouring word extends. A word is dropped where any run holds it after its first q words. Null texts have no words and
    no runs. Very long texts are read whole. Repeated rows give equal rows; an empty table gives an empty result; columns other
    than the two named are not read. Words are compared by fingerprints of 64 bits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column(1)):
            words = words_of(block)
            numbers = np.unique(hash_spans(block.data, words.starts, words.ends, lower=False), return_inverse=True)[1]
            runs = find_runs(numbers, words.bounds, exponent, least)
            first = words.bounds[:-1][runs.row]
            edge = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(edge, first + runs.start + runs.period, 1)
            np.add.at(edge, first + runs.stop, -1)
            kept = np.cumsum(edge[:-1]) == 0
            cuts = np.searchsorted(runs.row, np.arange(block.hi - block.lo + 1))
            rows, texts = [], []
            for r in range(block.hi - block.lo):
                own = slice(cuts[r], cuts[r + 1])
                rows.append([{"start": a, "length": b - a, "period": p} for a, b, p in zip(runs.start[own].tolist(), runs.stop[own].tolist(), runs.period[own].tolist(), strict=True)])
                at = np.flatnonzero(kept[words.bounds[r] : words.bounds[r + 1]]) + words.bounds[r]
                content = block.text(r)
                origin = int(block.offsets[r])
                texts.append(b" ".join([content[a - origin : b - origin] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(rows)), pa.array(np.diff(words.bounds), pa.int64()), pa.array(rows, out), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(rows, run, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) where one document in ten, by the crc32 of its id, repeats a part of itself from some word on; other texts, and rows without an id, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"), F.size(words).cast("long").alias("n"))
    rows = rows.withColumn("n", F.when(F.col("w").isNotNull(), F.size("w").cast("long"))).withColumn("a", F.expr("case when n > 0 then g % n end")).withColumn("p", F.expr("case when n > 0 then 1 + (n - a) div (3 + g % 8) end"))
    text = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select(id_col, F.when(F.col("n") > 0, text).otherwise(F.col(text_col)).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The runs of periodic_runs() as counts, the longest run and digest columns."""
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("s"), (-x["period"]).alias("p"))))
    said = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    rows = rows.select(id_col, "n_runs", (-F.col("l.s")).alias("start"), F.col("l.length").alias("length"), (-F.col("l.p")).alias("period"), "runs_sha256", "collapsed_sha256")
    return rows.select(id_col, "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(table(spark, sf_dir, "documents"))))
