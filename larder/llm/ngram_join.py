"""Near-duplicate texts by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Shingles are ordered from rare to common, by a sketch of how many documents hold each. A document of n shingles shares at
least o = ceil(s n) with anything of similarity s, so two similar documents share at least l of their first n - o + l
shingles, for any l. Each document takes the l at which its estimated cost is least: a longer prefix is more to look up, but
where its shingles are common, requiring l of them leaves fewer pairs to verify. Two documents are a candidate pair when
they share at least min(l, l') shingles of their prefixes at that length. For a pair of known sizes the overlap that they
need, and with it the prefix that counts, is sharper still; so shingles are kept with their places, and only those inside it
are matched.

Texts with equal sets are one class from the start. Classes that share a prefix shingle are paired where they are few. Where
they are many, as the near copies of one text, all pairs would grow with the square of the group; there one class p is made
the group's pivot and each other class x is replaced by what it differs in, x - p and p - x. With r(x) such differences,

    two classes are similar if and only if  |diff(x) & diff(y)| >= (r(x) + r(y) - a (n(x) + n(y))) / 2,  a = (1-s)/(1+s),

and that is more than nothing unless both are similar to p, which is then known. So the prefix filter applies again, to the
differences, which copies with edits of their own hardly share; a difference that many share is again a group with a pivot of
its own, level by level, until the pairs left are in proportion to the prefixes.

Pivots do not part texts that are put together from shared passages. After LEVELS levels, or where a level does not halve the
pairs, the crowded classes are parted by passages: shingles that exactly the same classes hold are one unit with a weight. Two
similar classes differ in at most b = a (n(x) + n(y)) shingles, so in at most d units heavier than b / (d + 1). With the units
dealt to d + k parts, a similar pair has equal units in k parts, and only classes with an equal choice of k parts are paired;
of several (d, k) each size takes the one with the fewest pairs. Only where that leaves no fewer pairs than the prefixes do are
these paired as they are. No pair is ever left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, blocks, cleanup, free_shuffles, hash_spans, materialize, mix, small_batches, table, words_of, written
from .components import components

#: Shingles for each counter of the sketch, and the least and most counters as powers of two (the most take 16 MB).
PER_COUNTER, LEAST_BITS, MOST_BITS, SLICE_BITS = 64, 16, 24, 14
#: The longest extension of a prefix, and the cost of verifying a candidate in look-ups.
MOST_MATCHES, VERIFY_COST = 8, 20.0
#: Pairs for each class of a shingle up to which its classes are paired; with more of them it gets a pivot.
FEW = 8
#: Crowded pairs that are paired nevertheless, as a part of the first rows: what all levels may leave.
LEFT = 4
#: Levels of pivots.
LEVELS = 6
#: Classes of a group, about, whose differences tell which ones many of the group have. They give an order alone; any order is exact.
OBSERVED = 16
#: Choices of d and k: heavy units that similar classes may differ in, and parts they are then equal in.
CHOICES = ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 2), (5, 2), (5, 3), (8, 2), (2, 6), (3, 5), (3, 7), (4, 4), (4, 6), (5, 5))
#: The first of them are tried on all classes, the others where those cost more than FEW candidates for each class.
FIRST_CHOICES = 11
#: The growth of sizes from a band to the next: a band's classes are keyed by the most that its largest may differ in.
BAND_GROWTH = 1.06
#: Counts from which a shingle is taken as shared without being looked up.
OFTEN = 1 << 10
#: Longs of a class's parity bitmap.
BITMAP = 16

_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted fingerprints of its distinct shingles of `width` words; of the whole sequence where it has fewer words."""
    w = words_of(block)
    h = hash_spans(block.data, w.starts, w.ends)
    n = len(h) - width + 1
    every = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(width):
            every = mix(every * _K + h[k : k + n])
    bounds = w.bounds.tolist()
    for a, z in zip(bounds, bounds[1:], strict=False):
        if z - a >= width:
            s = np.sort(every[a : z - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif z > a:
            one = np.full(1, z - a, np.uint64)
            for k in range(a, z):
                one = mix(one * _K + h[k : k + 1])
            yield mix(one + np.uint64(1))
        else:
            yield np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    return int((mix(s ^ _K).sum(dtype=np.uint64) + mix(np.full(1, len(s), np.uint64)))[:1].view(np.int64)[0])


def _least_overlap(n: int, similarity: Fraction) -> int:
    return -(-similarity.numerator * n // similarity.denominator)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text t, and k, which tells rows without an id apart by their texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.withColumn("k", F.when(F.col("id").isNull(), F.xxhash64("t")).otherwise(F.lit(0)).cast("long"))


def _sketch_bits(rows: DataFrame) -> int:
    """Enough counters for the corpus: its shingles are about a sixth of its bytes."""
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(size // (6 * PER_COUNTER)).bit_length()))


def _survey(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """A row per document: id, k, n, class; and rows of the sketch: slice, places in it (null: all) and their counters, from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            ns, classes = [], []
            for block in blocks(batch.column(1)):
                sets = list(shingle_sets(block, width))
                ns += [len(s) for s in sets]
                classes += [class_of(s) if len(s) else None for s in sets]
                places = (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64)
                np.add.at(counts, places, 1) if len(places) * 8 < len(counts) else np.add(counts, np.bincount(places, minlength=len(counts)), out=counts, casting="unsafe")
            none = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], ["id", "k", "n", "cls", "slice", "places", "counts"])
        for k, part in enumerate(np.minimum(counts, 65535).astype(np.uint16).reshape(-1, 1 << SLICE_BITS)):
            at = np.flatnonzero(part)
            if len(at):
                sparse = 2 * len(at) < len(part)
                one = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [one, one, one, one, pa.array([k], pa.int32()), pa.array([at.astype(np.uint16).tobytes() if sparse else None], pa.binary()), pa.array([(part[at] if sparse else part).tobytes()], pa.binary())],
                    ["id", "k", "n", "cls", "slice", "places", "counts"],
                )

    return rows.select("id", "t", "k").mapInArrow(run, "id long, k long, n long, cls long, slice int, places binary, counts binary")


#: Counters are kept as 8 times the logarithm to base two, which is enough to order by.
_LOG = 8


def _counts(logs: np.ndarray) -> np.ndarray:
    return np.exp2(logs.astype(float) / _LOG).astype(np.int64)


def _sketch(survey: DataFrame, bits: int) -> np.ndarray:
    """The logarithms of all tasks' counters' sums, a byte each; each slice is added up by a task, one part after the other."""

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for batch in parts:
            for at, c in zip(batch.column("places"), batch.column("counts"), strict=True):
                more = np.frombuffer(c.as_buffer(), np.uint16)
                if at.is_valid:
                    total[np.frombuffer(at.as_buffer(), np.uint16)] += more
                else:
                    total += more
        logs = np.minimum(np.log2(np.maximum(total, 1)) * _LOG, 255).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "logs": [logs.tobytes()]})

    out = np.zeros((1 << (bits - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in survey.filter("slice is not null").select("slice", "places", "counts").groupBy("slice").applyInArrow(run, "slice int, logs binary").toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["logs"], np.uint8)
    return out.ravel()


def _count_of(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    bits = len(sketch).bit_length() - 1
    return _counts(sketch[(tokens >> np.uint64(64 - bits)).astype(np.int64)])


def prefix_of(s: np.ndarray, sketch: np.ndarray, usual: int, similarity: Fraction) -> tuple[np.ndarray, int]:
    """The shingles of a set's adaptive prefix in order, and the number of matches l that it requires."""
    n = len(s)
    count = _count_of(s, sketch)
    order = np.argsort((count.astype(np.uint64) << np.uint64(40)) | (s & np.uint64((1 << 40) - 1)), kind="stable")
    least = _least_overlap(n, similarity)
    base = n - least + 1
    most = min(MOST_MATCHES, least)
    others = np.maximum(count[order[: base + most - 1]] - usual, 0).astype(float)
    run = np.cumsum(others)
    costs = [base + l - 1 + run[base + l - 2] * (1 + VERIFY_COST / l) for l in range(1, most + 1)]
    best = 1 + int(np.argmin(costs))
    return s[order[: base + best - 1]], best


_ROW = "pivot long, token long, cls long, n int, r int, l byte, place int"


def _prefixes(rows: DataFrame, width: int, shared, similarity: Fraction) -> DataFrame:
    """Rows _ROW without pivot, and `often`: each token of a class's prefix and its place there, the class's size and its l."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, usual = shared.value
        seen: set[int] = set()  # copies in one task give their rows once
        for batch in batches:
            for block in blocks(batch.column(0)):
                tokens, classes, ns, ls, places = [], [], [], [], []
                for s in shingle_sets(block, width):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    if len(seen) >= 1 << 17:
                        seen.clear()
                    seen.add(c)
                    prefix, best = prefix_of(s, sketch, usual, similarity)
                    k = len(prefix)
                    tokens.append(prefix)
                    places.append(np.arange(k, dtype=np.int32))
                    classes.append(np.full(k, c, np.int64))
                    ns.append(np.full(k, len(s), np.int32))
                    ls.append(np.full(k, best, np.int8))
                if tokens:
                    often = _count_of(np.concatenate(tokens), sketch) >= OFTEN + usual
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in tokens], classes, ns, ls, places)), pa.array(often)], ["token", "cls", "n", "l", "place", "often"])

    return rows.select("t").mapInArrow(run, "token long, cls long, n int, l byte, place int, often boolean")


def _members(rows: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """For the representatives in chosen (id, k, cls, copies): cls, n, parity bitmap and text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).to_pylist()
            ns, maps, keep, at = [], [], [], 0
            for block in blocks(batch.column(1)):
                for s in shingle_sets(block, width):
                    # an id may stand in rows of other texts too
                    if len(s) and class_of(s) == classes[at]:
                        odd = np.bincount((s & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
                        ns.append(len(s))
                        maps.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                        keep.append(at)
                    at += 1
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(ns, pa.int32()), pa.array(maps, pa.list_(pa.int64())), own.column(1), own.column(2)], ["cls", "n", "bits", "t", "copies"])

    same = rows["id"].eqNullSafe(chosen["id"]) & (rows["k"] == chosen["k"])
    found = rows.join(chosen, same).select("cls", "t", "copies").mapInArrow(run, "cls long, n int, bits array<bigint>, t string, copies long")
    once = found.filter("copies = 1").drop("copies")
    # rows that stand several times: few tables have any
    if chosen.filter("copies > 1").isEmpty():
        return once
    return once.unionByName(found.filter("copies > 1").drop("copies").dropDuplicates(["cls"]))


def _may_be_similar(a: Column, b: Column, an: Column, bn: Column, similarity: Fraction) -> Column:
    """Whether sizes and parity bitmaps allow the similarity: bits that differ count at most the shingles that only one side has."""
    p, q = similarity.numerator, similarity.denominator
    apart = F.lit(0)
    for k in range(BITMAP):
        apart = apart + F.bit_count(a[k].bitwiseXOR(b[k]))
    # overlap <= (an + bn - apart) / 2, and similarity needs q overlap >= p (an + bn - overlap)
    return (p * F.greatest(an, bn) <= q * F.least(an, bn)) & ((p + q) * (an + bn - apart) >= 2 * p * (an + bn))


def _links(pairs: DataFrame, members: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) of classes that are similar, from their texts."""
    slim = members.select("cls", "n", "bits")
    left, right = (slim.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    near = pairs.join(left, "a").join(right, "b").filter(_may_be_similar(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")
    near = materialize(near)
    text = members.select("cls", "t")
    both = near.join(text.select(F.col("cls").alias("a"), F.col("t").alias("ta")), "a").join(text.select(F.col("cls").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 256):
                ta, tb = batch.column(2).slice(lo, 256), batch.column(3).slice(lo, 256)
                sets_a = (s for block in blocks(ta) for s in shingle_sets(block, width))
                for i, (sa, sb) in enumerate(zip(sets_a, (s for block in blocks(tb) for s in shingle_sets(block, width)), strict=True), lo):
                    common = len(np.intersect1d(sa, sb, assume_unique=True))
                    if q * common >= p * (len(sa) + len(sb) - common):
                        keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def _differences(groups: DataFrame, members: DataFrame, width: int, shared, similarity: Fraction) -> DataFrame:
    """Rows _ROW of the prefixes of what each class of groups (cls, pivot, size) differs in from its pivot; `near` tells
    that it is similar to the pivot.

    A difference's order follows from the group and itself alone, from rare to common in the group: first what only one class
    has, then by how many of some OBSERVED classes differ in it too. Documents of the corpus do not tell that: most of a group
    hold a shingle of the text that they are copies of, yet those that lack it may be many. Among equals, a shingle that the
    pivot lacks comes the earlier the fewer documents have it, one that it has the earlier the more documents have it.
    """
    text = members.select("cls", "t")
    pivots = materialize(text.join(groups.select(F.col("pivot").alias("cls")).distinct(), "cls").select(F.col("cls").alias("pivot"), F.col("t").alias("tp")))
    p, q = similarity.numerator, similarity.denominator

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tokens = batch.column(0).to_numpy(), []
            sets_p = (s for block in blocks(batch.column(2)) for s in shingle_sets(block, width))
            for s, sp in zip((s for block in blocks(batch.column(1)) for s in shingle_sets(block, width)), sets_p, strict=True):
                tokens.append(np.setxor1d(s, sp, assume_unique=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(heads, [len(x) for x in tokens])), pa.array(np.concatenate(tokens).view(np.int64))], ["pivot", "token"])

    some = groups.filter(F.pmod(F.xxhash64("cls", "pivot"), F.col("size")) < OBSERVED).join(text, "cls").join(pivots, "pivot")
    often = some.select("pivot", "t", "tp").mapInArrow(observe, "pivot long, token long").groupBy("pivot", "token").agg(F.count("*").cast("int").alias("c"))
    often = often.filter("c > 1").groupBy("pivot").agg(F.array_sort(F.collect_list(F.struct("token", "c"))).alias("o"))
    pivots = materialize(pivots.join(often, "pivot", "left").select("pivot", "tp", F.col("o.token").alias("shared"), F.col("o.c").alias("holders")))
    both = groups.join(text, "cls").join(pivots, "pivot").select("pivot", "cls", "size", "t", "tp", "shared", "holders")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, usual = shared.value
        last: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            heads = [batch.column(i).to_pylist() for i in range(3)]
            at, out = 0, []
            for block in blocks(batch.column(3)):
                for s in shingle_sets(block, width):
                    pivot, cls, size = (h[at] for h in heads)
                    if last is None or last[0] != pivot:
                        told = [np.array(batch.column(i)[at].as_py() or [0], np.int64) for i in (5, 6)]
                        last = pivot, next(shingle_sets(next(blocks(batch.column(4).slice(at, 1))), width)), *told
                    at += 1
                    own, lacks = np.setdiff1d(s, last[1], assume_unique=True), np.setdiff1d(last[1], s, assume_unique=True)
                    n, r = len(s), len(own) + len(lacks)
                    if not r:
                        continue
                    near = (p + q) * r <= (q - p) * (n + len(last[1]))
                    diff = np.concatenate([own, lacks])
                    place = np.minimum(np.searchsorted(last[2], diff.view(np.int64)), len(last[2]) - 1)
                    seen = np.where(last[2][place] == diff.view(np.int64), last[3][place], 0)
                    seen[len(own) :] += 1
                    rank = np.concatenate([np.minimum(_count_of(own, sketch), size), size - np.minimum(_count_of(lacks, sketch), size)])
                    # need >= r - a (n + n'), for any n' <= n / s
                    most = min(r, (q - p) * n // p + 1)
                    order = np.lexsort((mix(diff), rank, seen))[:most]
                    out.append((pivot, diff[order], cls, n, r, near))
            if out:
                k = [len(o[1]) for o in out]
                flat = lambda i, kind: np.repeat(np.array([o[i] for o in out], kind), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (flat(0, np.int64), np.concatenate([o[1] for o in out]).view(np.int64), flat(2, np.int64), flat(3, np.int32), flat(4, np.int32), np.ones(sum(k), np.int8),
                     np.concatenate([np.arange(x, dtype=np.int32) for x in k]), flat(5, bool))], ["pivot", "token", "cls", "n", "r", "l", "place", "near"],
                )

    return both.mapInArrow(run, f"{_ROW}, near boolean")


@cache
def _band_edges() -> np.ndarray:
    """The smallest size of each band, up to the largest size there can be."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_GROWTH)))
    return np.array(edges)


def _band(n: int) -> int:
    return int(np.searchsorted(_band_edges(), n, "right")) - 1


def _allowance(band: int, similarity: Fraction) -> int:
    """The most shingles that two similar classes differ in, where the larger is of this band."""
    p, q = similarity.numerator, similarity.denominator
    return 2 * (q - p) * int(_band_edges()[band + 1] - 1) // (p + q)


def part_keys(units: np.ndarray, weights: np.ndarray, band: int, choice: int, similarity: Fraction) -> list[int]:
    """A key for each way to take k of the d + k parts of the heavy units; two similar classes have one in common."""
    d, k = CHOICES[choice]
    heavy = mix(units[weights * (d + 1) > _allowance(band, similarity)])
    part = (heavy % np.uint64(d + k)).astype(np.int64)
    content = [np.bitwise_xor.reduce(mix(heavy[part == i] + _K), initial=np.uint64(i)) for i in range(d + k)]
    keys = np.array([[content[i] for i in c] for c in combinations(range(d + k), k)], np.uint64)
    out = np.arange(len(keys), dtype=np.uint64)
    for column in keys.T:
        out = mix(out * _K + column)
    return out.view(np.int64).tolist()


def _units(crowd: DataFrame, members: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """The classes of crowd (cls, label) with their n and units: of shingles that exactly the same classes of crowd hold, the
    smallest and the number, if that can be heavy in any choice. A class has at most some 9 (1 + s) / (2 (1 - s)) of these."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, at = batch.column(0).to_numpy(), 0
            for block in blocks(batch.column(1)):
                sets = list(shingle_sets(block, width))
                ns = np.array([len(x) for x in sets])
                own, at = classes[at : at + len(sets)], at + len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, ns)), pa.array(np.concatenate(sets).view(np.int64))], ["cls", "token"])

    tokens = materialize(members.select("cls", "t").join(crowd.select("cls"), "cls").mapInArrow(shingles, "cls long, token long"))
    holders = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"h{k}") for k in range(2)]
    posted = tokens.groupBy("token").agg(*holders, F.count("*").alias("c")).groupBy("h0", "h1", "c").agg(F.min("token").alias("token"), F.count("*").alias("w"))
    # a unit that all classes hold parts none
    units = materialize(posted.filter(F.col("c") < crowd.count()).select("token", "w"))
    p, q = similarity.numerator, similarity.denominator
    most = max(d for d, _ in CHOICES) + 1
    sized = crowd.join(members.select("cls", "n"), "cls")
    held = tokens.join(units, "token").join(sized.select("cls", "n"), "cls").filter(F.expr(f"w * {most * (p + q)} > {2 * (q - p)} * n"))
    held = held.groupBy("cls").agg(F.collect_list("token").alias("units"), F.collect_list("w").alias("weights"))
    return materialize(sized.join(held, "cls", "left"))


def _keyed(classes: DataFrame, choices: dict[int, int] | range, similarity: Fraction) -> DataFrame:
    """Rows cls, label, n, larger, band, choice, key. With choices of each band a class has the keys of its own band, as the
    larger of a pair, and of each band of a larger partner; with a range, those of all its choices in its own band."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "label", "n", "larger", "band", "choice", "key"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                n, own = row["n"], _band(row["n"])
                units, weights = np.array(row["units"] or [], np.int64).view(np.uint64), np.array(row["weights"] or [], np.int64)
                if isinstance(choices, range):
                    wanted = [(own, True, c) for c in choices]
                else:
                    wanted = [(own, True, choices[own])] + [(b, False, choices[b]) for b in range(own, _band(n * q // p) + 1) if b in choices]
                out = [(row["cls"], row["label"], n, larger, b, c, key) for b, larger, c in wanted for key in part_keys(units, weights, b, c, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return classes.select("cls", "label", "n", "units", "weights").mapInArrow(run, "cls long, label long, n int, larger boolean, band int, choice int, key long")


def _by_passages(crowd: DataFrame, members: DataFrame, width: int, similarity: Fraction) -> tuple[DataFrame, int]:
    """Pairs (a, b) of classes of crowd (cls, label) with different labels, among them all similar ones; and about how many."""
    p, q = similarity.numerator, similarity.denominator
    classes = _units(crowd, members, width, similarity)
    # pairs of different labels under a key, for each choice; a key is a look-up
    best: dict[int, tuple[float, int]] = {}
    for choices in (range(FIRST_CHOICES), range(FIRST_CHOICES, len(CHOICES))):
        tried = _keyed(classes, choices, similarity).groupBy("band", "choice", "key", "label").agg(F.count("*").alias("m"))
        tried = tried.groupBy("band", "choice", "key").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("m")).alias("same"))
        cost = tried.groupBy("band", "choice").agg(F.sum(F.expr(f"{VERIFY_COST} * (c * c - same) / 2 + c")).alias("cost"))
        # one row a band, of which there are some 400 at most
        for r in cost.groupBy("band").agg(F.min(F.struct("cost", "choice")).alias("least")).collect():
            best[r["band"]] = min(best.get(r["band"], (float("inf"), 0)), tuple(r["least"]))
        if sum(c for c, _ in best.values()) <= FEW * VERIFY_COST * classes.count():
            break
    keyed = materialize(_keyed(classes, {band: choice for band, (_, choice) in best.items()}, similarity))
    met = keyed.groupBy("band", "key", "label").agg(F.sum(F.expr("int(larger)")).alias("l"), F.sum(F.expr("int(not larger)")).alias("s"))
    met = met.groupBy("band", "key").agg(F.expr("sum(l) * sum(s) - sum(l * s)").alias("apart")).filter("apart > 0")
    met = materialize(met)
    x, y = (keyed.filter(f"larger = {side}").join(met.select("band", "key"), ["band", "key"], "left_semi").alias(name) for side, name in (("true", "x"), ("false", "y")))
    pairs = x.join(y, F.expr(f"x.band = y.band and x.key = y.key and x.label <> y.label and x.n >= y.n and {p} * x.n <= {q} * y.n"))
    return pairs.select(F.expr("least(x.cls, y.cls)").alias("a"), F.expr("greatest(x.cls, y.cls)").alias("b")).distinct(), met.agg(F.sum("apart")).first()[0] or 0


def _similar_classes(found: DataFrame, members: DataFrame, width: int, shared, similarity: Fraction) -> DataFrame:
    """(cls, component) of each class with links, from the prefix rows found (_ROW), level by level.

    A token's classes are paired where at most FEW pairs for each of them lie between components, and all are, once the others
    make at most a pair for each LEFT of the first rows. Where pivots no longer halve the pairs, crowded ones are parted by passages.
    """
    p, q = similarity.numerator, similarity.denominator

    def inside(x: str, y: str) -> str:
        """SQL: whether x and y can be similar by size, and this token lies in the part of both prefixes that counts for the pair."""
        need = f"ceil(({x}.r + {y}.r - {q - p} * ({x}.n + {y}.n) / {p + q}) / 2)"
        matches = f"least({x}.l, {y}.l)"
        return f"{p} * greatest({x}.n, {y}.n) <= {q} * least({x}.n, {y}.n) and {x}.place + {need} < {x}.r + {matches} and {y}.place + {need} < {y}.r + {matches}"

    component: DataFrame | None = None
    rows, before = 0, float("inf")
    for level in range(LEVELS + 1):
        if component is None:
            found = found.withColumn("label", F.col("cls"))
        else:
            found = found.join(component, "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
        first = F.min(F.struct("place", F.xxhash64("cls").alias("h"), "cls"))
        keys = found.groupBy("pivot", "token", "label").agg(F.count("*").alias("m"), first.alias("first"))
        keys = keys.groupBy("pivot", "token").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count("*").alias("labels"), F.min("first").getField("cls").alias("first"))
        keys = materialize(keys.filter("labels > 1").select("pivot", "token", "first", F.expr("c * c - same").alias("apart"), "c"))
        rows, crowded = found.count() if level == 0 else rows, F.col("apart") > 2 * FEW * F.col("c")
        ahead = keys.filter(crowded).agg(F.sum("apart") / 2).first()[0] or 0
        # differences of pivots help while they leave fewer pairs, passages where those do not
        stuck = LEFT * ahead > rows and (level == LEVELS or 2 * ahead > before)
        done, before = stuck or LEFT * ahead <= rows, ahead
        passages: DataFrame | None = None
        if stuck:
            crowd = found.join(keys.filter(crowded).select("pivot", "token"), ["pivot", "token"], "left_semi").select("cls", "label").distinct()
            passages, left = _by_passages(materialize(crowd), members, width, similarity)
            passages = passages if left < ahead else None
        few = F.lit(True) if done and passages is None else ~crowded
        open_ = found.join(keys.filter(few).select("pivot", "token"), ["pivot", "token"], "left_semi")
        x, y = open_.alias("x"), open_.alias("y")
        matched = x.join(y, F.expr(f"x.pivot = y.pivot and x.token = y.token and x.cls < y.cls and x.label <> y.label and {inside('x', 'y')}"))
        pairs = matched.select(F.col("x.pivot").alias("pivot"), F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.least("x.l", "y.l").alias("l")).groupBy("pivot", "a", "b").agg(F.count("*").alias("c"), F.max("l").alias("l"))
        pairs = pairs.filter("c >= l").select("a", "b")
        pairs = (pairs if passages is None else pairs.unionByName(passages)).distinct()
        links = materialize(_links(pairs, members, width, similarity))
        if not done:
            many = keys.filter(crowded)
            # all classes of a crowded token go to its pivot; tokens with one pivot make one group
            groups = found.select("pivot", "token", "cls").join(many.select("pivot", "token", "first"), ["pivot", "token"]).filter("cls <> first")
            groups = materialize(groups.select("cls", F.col("first").alias("pivot")).distinct())
            sizes = groups.groupBy("pivot").agg(F.count("*").alias("size"))
            found = materialize(_differences(groups.join(sizes, "pivot"), members, width, shared, similarity))
            links = links.unionByName(found.filter("near and place = 0").select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
            found = found.drop("near")
        if component is not None:
            links = links.unionByName(component.select(F.col("cls").alias("a"), F.col("component").alias("b")))
        component = materialize(components(links).select(F.col("node").alias("cls"), "component"))
        free_shuffles(members.sparkSession)
        if done:
            break
    return component


def near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(4, 5), width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_shingles (distinct shingles of `width` words, A-Z lower-cased) and component_id.

    Two documents are linked when the Jaccard similarity of their sets is at least `similarity`; component_id is the smallest id
    that links lead to, the document's own included. Null texts, and texts without words, have no shingles and are linked
    with nothing. Rows without an id keep their row, with the component of their links, null if that has no id. Repeated rows
    are copies of each other; rows of one id with different texts are documents of their own. Very long texts are taken whole,
    each by one task. An empty table gives an empty result; columns other than the two named are not read. Sets and classes are
    told apart by 64-bit fingerprints.
    """
    spark, before = docs.sparkSession, written()
    small_batches(spark)
    rows = _texts(docs, id_col, text_col)
    bits = _sketch_bits(rows)
    survey = materialize(_survey(rows, width, bits))
    info = survey.filter("slice is null").select("id", "k", "n", "cls")
    # a class stands for its rows by the smallest id, or by a text where none has an id
    copies = info.filter("cls is not null").groupBy("cls", "id", "k").agg(F.count("*").alias("copies"))
    reps = copies.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "copies")).alias("s")).select("cls", "s.id", "s.k", "s.copies")
    reps = materialize(reps)
    sketch = _sketch(survey, bits)
    shared = spark.sparkContext.broadcast((sketch, int(_counts(np.median(sketch)[None])[0])))
    prefixes = _prefixes(rows, width, shared, similarity)
    # tokens of one class alone lead nowhere; those that very many documents hold are kept without looking, and dealt out
    dealt = prefixes.selectExpr("*", "if(often, pmod(cls, 4096), 0) as part")
    bounds = (f"{f}(cls) over (partition by token, part) as {x}" for f, x in (("min", "lo"), ("max", "hi")))
    found = dealt.selectExpr("*", *bounds).filter("often or lo <> hi").select("token", "cls", "n", "l", "place").distinct()
    found = materialize(found.select(F.lit(0).cast("long").alias("pivot"), "token", "cls", "n", F.col("n").alias("r"), "l", "place"))
    free_shuffles(spark)
    chosen = found.select("cls").distinct().join(reps, "cls").select("id", "k", "cls", "copies")
    members = materialize(_members(rows, materialize(chosen), width))
    free_shuffles(spark)
    component = _similar_classes(found, members, width, shared, similarity)
    # a component's id is the smallest id of all its classes
    own = reps.join(component, "cls", "left").select("cls", "id", F.coalesce("component", "cls").alias("component"))
    least = own.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = materialize(own.join(least, "component").select("cls", "component_id"))
    cleanup(spark, before, (survey, by_class))
    out = info.join(by_class, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Fraction(17, 20), 4)
