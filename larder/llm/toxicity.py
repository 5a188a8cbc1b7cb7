"""Toxicity by class-conditional Kneser-Ney models.

The models give each character of a word its likelihood after up to ORDER - 1 characters of that word, so that families of
words made from one expression are seen together. Each class discounts its own counts and backs off to the counts of both
classes together, and these to continuation counts of shorter histories: an expression that is rare in both says little, and
one that neither has seen says nothing. A word's ratio is its toxic less its ordinary log-likelihood, above what is usual in
the document (the median), so that a language or a subject that one class has more of tells nothing.

A toxic document is an ordinary one in which some words, a share EPSILON, are drawn from the toxic model; its log-likelihood
less that of an ordinary document, the sum of log(1 - EPSILON + EPSILON exp(ratio)) over its words, is normalised by its
number of words and SHORT more, and bounded to -1..1 as x / (1 + |x|), so that no single text tips the fit. One slope and one offset, fitted on labelled documents that the models leave out, map that to a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cleanup, free_shuffles, hash_spans, map_arrow, materialize, small_batches, table, written

ORDER, DISCOUNT = 7, 0.75
#: A quarter of the labelled documents fits the score instead of the models, at most so many: toxic and ordinary.
MOST_TOXIC, MOST_ORDINARY = 750, 1500
#: Ratios are whole numbers of millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: What both classes' counts together weigh in those of one class, in characters.
BACKOFF = 25.0
#: The share of toxic words in a toxic document, and the ratio from which a word adds no more than its excess.
EPSILON, STEEP = 0.02, 50.0
#: Words by which every text counts as longer than it is.
SHORT = 20
#: Entries of a model that is passed to the workers as two sorted arrays of 12 bytes an entry; a larger one is joined.
PASSED = 1 << 22
#: Labels that are passed to the workers to find their documents, at most: about 100 MB.
HELD_LABELS = 1 << 22
#: The share of any character after no history at all.
ALIKE = 1 / 1024
THRESHOLD = 0.3
#: The most common n-grams, and the most common words, whose ratios are passed to the workers, at most; all others are joined.
COMMON = 1 << 17
#: Words that a worker counts or remembers before it begins anew.
MEMORY = 1 << 18
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _count_words(rows: DataFrame) -> DataFrame:
    """(w, t, o): how often each word, without signs at its edges, stands in the texts t of rows with y = 1 and with y = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = regex.compile(_EDGE)
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for y, words in enumerate(seen):
                found = list(words.items())
                for lo in range(0, len(found), 1 << 13):
                    part = found[lo : lo + (1 << 13)]
                    yield pa.RecordBatch.from_arrays([pa.array([strip.sub("", w) for w, _ in part], pa.string()), pa.array([y] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], ["w", "y", "n"])
                words.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for text, y in zip(batch.column(0).slice(lo, 512).to_pylist(), batch.column(1).slice(lo, 512).to_pylist(), strict=True):
                    if text:
                        seen[y].update(text.lower().split())
                        if len(seen[0]) + len(seen[1]) > MEMORY:
                            yield from flush()
        yield from flush()

    counted = rows.select("t", "y").mapInArrow(run, "w string, y int, n bigint")
    return counted.groupBy("w").agg(F.sum(F.col("n") * F.col("y")).alias("t"), F.sum(F.col("n") * (1 - F.col("y"))).alias("o"))


def _grams(words: DataFrame) -> DataFrame:
    """(h, x, t, o): how often, in toxic and in ordinary texts, character x follows h in words (w, t, o)."""
    s = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    pairs = F.expr(f"transform(sequence(2, length(s)), i -> struct(substring(s, greatest(1, i - {ORDER - 1}), least({ORDER - 1}, i - 1)) as h, substring(s, i, 1) as x))")
    return words.select(s.alias("s"), "t", "o").select(F.explode(pairs).alias("g"), "t", "o").groupBy("g.h", "g.x").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _with_shared(top: DataFrame) -> DataFrame:
    """top with `low`: the probability of x after h without its first character, by continuation counts that the classes share.

    At each length of history s, x counts once for every character that comes before s and x; what is discounted goes to the
    history that is one character shorter, down to all characters alike.
    """
    at = lambda n: F.length("h") == n
    counts: dict[int, DataFrame] = {}
    pairs = top.filter(at(ORDER - 1)).select(F.col("h").alias("g"), "x")
    for n in range(ORDER - 2, -1, -1):
        counts[n] = materialize(pairs.groupBy(F.expr(f"right(g, {n})").alias("s"), "x").agg(F.count("*").alias("k")))
        pairs = counts[n].select(F.col("s").alias("g"), "x").union(top.filter(at(n)).select("h", "x")).distinct()
    by = Window.partitionBy("s")
    parts: list[DataFrame] = []
    for n in range(ORDER - 1):
        shares = counts[n].select("s", "x", ((F.col("k") - DISCOUNT) / F.sum("k").over(by)).alias("a"), (DISCOUNT * F.count("*").over(by) / F.sum("k").over(by)).alias("b"))
        if n:
            shares = shares.withColumn("z", F.expr(f"right(s, {n - 1})")).join(low.select(F.col("s").alias("z"), "x", "low"), ["z", "x"])
        else:
            shares = shares.withColumn("low", F.lit(ALIKE))
        low = materialize(shares.select("s", "x", (F.col("a") + F.col("b") * F.col("low")).alias("low")))
        parts.append(top.filter(at(n + 1)).withColumn("s", F.expr(f"right(h, {n})")).join(low, ["s", "x"]).select(*top.columns, "low"))
    return reduce(DataFrame.unionAll, parts)


@dataclass
class Lookup:
    """Names and their ratios as two Arrow arrays: the driver only passes them on, and a worker makes its dictionary when it first looks up."""

    keys: pa.Array
    values: pa.Array

    @cached_property
    def found(self) -> dict[str, int]:
        return dict(zip(self.keys.to_pylist(), self.values.to_pylist(), strict=True))


def _common(rows: DataFrame, key: str) -> Lookup:
    """The ratios r of the keys with the largest counts n, as many as COMMON permits: whole bins of counts, so that nothing is sorted."""
    place = F.floor(F.log2(F.col("n")) * 8)
    least, total = None, 0
    for b, size in sorted(((r["b"], r["size"]) for r in rows.groupBy(place.alias("b")).agg(F.count("*").alias("size")).collect()), reverse=True):
        total += size
        if total > COMMON:
            break
        least = b
    if least is None:
        return Lookup(pa.array([], pa.string()), pa.array([], pa.int64()))
    found = rows.filter(place >= least).select(key, "r").toArrow().combine_chunks()
    return Lookup(*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in found.columns))


@dataclass
class Model:
    """Tables of log-likelihood ratios: of n-grams g, met n times, and of a character never seen after the history h."""

    grams: DataFrame
    backs: DataFrame


def ratios(top: DataFrame) -> Model:
    """The ratios of all n-grams and histories of top."""
    by = Window.partitionBy("h")
    f = _with_shared(top).withColumns({"nt": F.sum("t").over(by), "no": F.sum("o").over(by), "kt": F.count_if(F.col("t") > 0).over(by), "ko": F.count_if(F.col("o") > 0).over(by)})
    n, seen, k = F.col("nt") + F.col("no"), F.col("t") + F.col("o"), F.count("*").over(by)
    f = f.withColumn("both", F.greatest(seen - DISCOUNT, F.lit(0.0)) / n + DISCOUNT * k / n * F.col("low"))
    rest = lambda k: BACKOFF + DISCOUNT * F.col(k)
    log_share = lambda c, n, k: F.log((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + rest(k) * F.col("both")) / (F.col(n) + BACKOFF))
    log_rest = lambda n, k: F.log(rest(k) / (F.col(n) + BACKOFF))
    whole = lambda r: F.round(r * UNIT).cast("long")
    f = f.select("h", "x", seen.alias("n"), whole(log_share("t", "nt", "kt") - log_share("o", "no", "ko")).alias("r"), whole(log_rest("nt", "kt") - log_rest("no", "ko")).alias("back"))
    f = materialize(f)
    return Model(f.select(F.concat("h", "x").alias("g"), "n", "r"), f.groupBy("h").agg(F.max("back").alias("back")))


def _rated(words: DataFrame, model: Model) -> DataFrame:
    """words (w, n) with r: the ratio of each, which is the sum over its n-grams, by the model's tables."""
    shared = words.sparkSession.sparkContext.broadcast(_common(model.grams, "g"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        get = shared.value.found.get
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            sums, rests = [], []
            for w in part.column(0).to_pylist():
                s, total, rest = f"^{w}$", 0, []
                for i in range(2, len(s) + 1):
                    g = s[max(0, i - ORDER) : i]
                    r = get(g)
                    if r is None:
                        rest.append(g)
                    else:
                        total += r
                sums.append(total)
                rests.append(rest)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums, pa.int64()), pa.array(rests, pa.list_(pa.string()))], ["w", "n", "s", "rest"])

    met = materialize(map_arrow(words.select("w", "n"), run, "w string, n bigint, s bigint, rest array<string>"))
    asked = met.select("w", F.explode("rest").alias("g")).join(model.grams.select("g", "r"), "g", "left")
    asked = asked.select("w", F.expr("left(g, length(g) - 1)").alias("h"), "r").join(model.backs, "h", "left")
    more = materialize(asked.groupBy("w").agg(F.sum(F.coalesce("r", "back", F.lit(0))).alias("more")))
    free_shuffles(words.sparkSession)
    total = F.col("s") + F.coalesce("more", F.lit(0))
    return materialize(met.select("w", "n", "s").join(more, "w", "left").select("w", "n", total.cast("long").alias("r")))


def _gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ^word$ for each word: fingerprints of the n-grams that end at each character but the first, those of their histories, and the words' numbers."""
    data = np.frombuffer(f"${''.join(f'^{w}$' for w in words)}".encode(), np.uint8)[1:]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.append(lead[1:], len(data))
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    start = np.repeat(np.cumsum(length) - length, length)  # of each character its word's first
    at = np.flatnonzero(np.arange(len(lead)) > start)
    first = lead[np.maximum(start[at], at - ORDER + 1)]
    return hash_spans(data, first, ends[at], lower=False), hash_spans(data, first, lead[at], lower=False), np.repeat(np.arange(len(words)), length)[at]


@dataclass
class Passed:
    """The whole model as sorted fingerprints of n-grams and histories, and their ratios."""

    grams: np.ndarray
    ratios: np.ndarray
    histories: np.ndarray
    backs: np.ndarray

    def rate(self, words: list[str]) -> list[int]:
        """The ratio of each word: the sum over its n-grams; one that is not in the model has its history's, or none."""
        grams, histories, owner = _gram_hashes(words)
        total = np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        met = self.grams[at] == grams
        np.add.at(total, owner[met], self.ratios[at[met]])
        histories, owner = histories[~met], owner[~met]
        at = np.minimum(np.searchsorted(self.histories, histories), len(self.histories) - 1)
        met = self.histories[at] == histories
        np.add.at(total, owner[met], self.backs[at[met]])
        return total.tolist()


def _pass(model: Model) -> Passed | None:
    """The model for the workers, if it has no more than PASSED entries."""
    if model.grams.count() + model.backs.count() > PASSED:
        return None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.column(0).cast(pa.large_string())
        ends = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1, names.offset * 8)
        keys = hash_spans(np.frombuffer(names.buffers()[2], np.uint8), ends[:-1], ends[1:], lower=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1)], ["k", "v"])

    # the driver sees fingerprints and ratios alone
    arrays: list[np.ndarray] = []
    for df, key, value in ((model.grams, "g", "r"), (model.backs, "h", "back")):
        found = map_arrow(df.select(key, F.col(value).cast("int").alias("v")), run, "k long, v int").toArrow()
        keys, values = found.column("k").to_numpy().view(np.uint64), found.column("v").to_numpy()
        order = np.argsort(keys)
        arrays += [keys[order], values[order]]
        del found, keys, values, order
    return Passed(*arrays)


def _local_evidence(rows: DataFrame, ids: str, passed: Passed) -> DataFrame:
    """evidence() of rows (key, id, t) by a model that the workers hold."""
    shared = rows.sparkSession.sparkContext.broadcast(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        strip = regex.compile(_EDGE)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t.lower().split() if t else [] for t in part.column(2).to_pylist()]
                new = [w for w in set(chain.from_iterable(texts)) if w not in known]
                if len(known) + len(new) > MEMORY:
                    known.clear()
                    new = list(set(chain.from_iterable(texts)))
                if new:
                    known.update(zip(new, shared.value.rate([strip.sub("", w) for w in new]), strict=True))
                sums = []
                for words in texts:
                    r = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    sums.append(int(_excess(r - int(np.median(r))).sum()) if len(r) else 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(w) for w in texts], pa.int64()), pa.array(sums, pa.int64())], ["key", "id", "n", "s"])

    return rows.mapInArrow(run, f"{ids}, n bigint, s bigint")


#: Stands for a ratio that has to be joined.
_ASK = 1 << 40


class Words(dict):
    """Word to its log-likelihood ratio, or _ASK, found on first use."""

    def __init__(self, known: Lookup) -> None:
        self.known = known.found
        self.strip = regex.compile(_EDGE)

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = r = self.known.get(self.strip.sub("", word), _ASK)
        return r


def _excess(r: np.ndarray) -> np.ndarray:
    """What words with these ratios (in whole units, above what is usual) add to the log-likelihood ratio of their document, in whole units."""
    x = r / UNIT
    return np.round(np.where(x > STEEP, x + np.log(EPSILON), np.log1p(EPSILON * np.expm1(np.minimum(x, STEEP)))) * UNIT).astype(np.int64)


def evidence(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Per row of docs: key (key_col's value, if there is one, else the id), id, its number of words n and the log-likelihood ratio s, in whole units.

    Where the model has at most PASSED entries, each worker holds it and rates the words that it meets. Beyond that the distinct
    words of docs get their ratios by joins with the model. Those of the most common words are looked up where the texts are
    read, the other words of each row are joined with theirs; the median and the sum are of all words of a row on both ways,
    so both give the same.
    """
    ids = f"key {docs.schema[key_col or id_col].dataType.simpleString()}, id {docs.schema[id_col].dataType.simpleString()}"
    rows = docs.select(F.col(key_col or id_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    if passed := _pass(model):
        return materialize(_local_evidence(rows, ids, passed))
    words = materialize(_count_words(rows.select("t", F.lit(0).alias("y"))).select("w", F.col("o").alias("n")))
    free_shuffles(docs.sparkSession)
    rated = _rated(words, model)
    free_shuffles(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_common(rated, "w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ns, known, rests = [], [], []
                for text in part.column(2).to_pylist():
                    words = text.lower().split() if text else []
                    met: Counter = Counter()
                    rest: Counter = Counter()
                    for w, c in Counter(words).items():
                        r = own[w]
                        if r == _ASK:
                            rest[own.strip.sub("", w)] += c
                        else:
                            met[r] += c
                    ns.append(len(words))
                    known.append([{"r": r, "c": c} for r, c in met.items()])
                    rests.append([{"w": w, "n": n} for w, n in rest.items()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.array(known, _RATED), pa.array(rests, _ASKED)], ["key", "id", "n", "known", "rest"])

    first = rows.mapInArrow(run, f"{ids}, n bigint, known array<struct<r:bigint,c:bigint>>, rest array<struct<w:string,n:bigint>>")
    # the row numbers are written, so every later attempt has them alike
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()))
    asked = first.select("row", F.explode("rest").alias("e")).select("row", "e.w", F.col("e.n").alias("c")).join(rated.select("w", "r"), "w")
    # a row's ratios are no more than its distinct words
    more = asked.groupBy("row", "r").agg(F.sum("c").alias("c")).groupBy("row").agg(F.collect_list(F.struct("r", "c")).alias("more"))
    whole = first.drop("rest").join(more, "row", "left")

    def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums = []
        for known, rest in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            pairs = [*known, *(rest or [])]
            sums.append(_above_usual(np.array([x["r"] for x in pairs], np.int64), np.array([x["c"] for x in pairs], np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["key", "id", "n", "s"])

    return materialize(map_arrow(whole.select("key", "id", "n", "known", "more"), add, f"{ids}, n bigint, s bigint"))


def _above_usual(r: np.ndarray, c: np.ndarray) -> int:
    """What words add that stand c times each with ratio r, above the median of them all."""
    if not len(r):
        return 0
    order = np.argsort(r, kind="stable")
    r, c = r[order], c[order]
    run = np.cumsum(c)
    middle = r[np.searchsorted(run, [(run[-1] - 1) // 2, run[-1] // 2], "right")]
    return int((_excess(r - int(middle.sum() / 2)) * c).sum())


_RATED = pa.list_(pa.struct([("r", pa.int64()), ("c", pa.int64())]))
_ASKED = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64())]))


def _normalised(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio for each hundred words, bounded."""
    x = 100 * s / UNIT / (n + SHORT)
    return x / (1 + np.abs(x))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Offset and slope, held a little to 0."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.1, x.T @ (weight * (y - p)) - 0.1 * w)
        # steep likelihoods overshoot
        w += step * min(1.0, 2.0 / max(abs(step).max(), 1e-9))
        if abs(step).max() < 1e-7:
            break
    return w


def _calibrates(id_col: Column, label: Column, sizes: dict[int, int]) -> Column:
    """Whether a labelled document fits the score: a quarter of them, at most MOST_TOXIC and MOST_ORDINARY, by their ids' hashes.

    A hash threshold needs no sort of texts; the documents may be a few more than the bound.
    """
    share = {y: min(0.25, most / max(1, sizes.get(y, 0))) for y, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY))}
    place = F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return place < F.when(label == 1, share[1]).otherwise(share[0])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model | None, dict[int, int]]:
    """The models from all labelled documents but those that fit the score, and the number of documents of each label."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), (F.col(label_col) == 1).cast("int").alias("y")).filter("y is not null and t is not null")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    top = materialize(_grams(_count_words(rows.filter(~_calibrates(F.col("id"), F.col("y"), sizes)))))
    free_shuffles(labelled.sparkSession)
    return (None if top.isEmpty() else ratios(top)), sizes


def calibrate(seen: DataFrame, labels: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """The score's offset and slope from rows of evidence() that have a label (label_id, y) and that fit() left out."""
    chosen = labels.filter(_calibrates(F.col("label_id"), F.col("y"), sizes))
    found = seen.filter("n > 0").join(chosen, F.col("id") == F.col("label_id")).select("s", "n", "y").toPandas()
    if not len(found):
        return np.zeros(2)
    found = found.sort_values(["y", "n", "s"], kind="stable")
    y = found.y.to_numpy(float)
    weight = np.where(y == 1, sizes.get(1, 0) / max(1, y.sum()), sizes.get(0, 0) / max(1, (1 - y).sum()))
    return _logistic(_normalised(found.s.to_numpy(float), found.n.to_numpy(float)), y, weight / weight.sum() * len(y))


def score(seen: DataFrame, calibration: np.ndarray) -> DataFrame:
    """Each row's key, id and `score` between 0 and 1, from the evidence of its whole text alone; null and empty texts have the score of no evidence."""
    offset, slope = map(float, calibration)
    x = 100 * F.col("s") / float(UNIT) / (F.col("n") + SHORT)
    x = x / (1 + F.abs(x))
    return seen.select("key", "id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), offset + slope * x))))).alias("score"))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(label_id, label) outside the held-out fold, once an id: toxic if any of its rows says so. Rows without an id or a label teach nothing."""
    own = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).filter("label_id is not null and label is not null")
    own = own.groupBy("label_id").agg(F.max("label").alias("label"))
    return own.filter(~held_out(F.col("label_id")))


def labelled_documents(docs: DataFrame, own: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Documents with labels of training_labels(), a written table. Up to HELD_LABELS labels of whole numbers go to all workers, so that no text is shuffled; more, or other ids, are joined by an exchange."""
    if own.schema["label_id"].dataType.simpleString() in ("bigint", "int") and own.count() <= HELD_LABELS:
        own = F.broadcast(own)
    return docs.select(F.col(id_col).alias("id"), F.col("text")).join(own, F.col("id") == F.col("label_id")).select(F.col("id").alias(id_col), "text", F.col("label").alias(label_col))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, key_col: str | None = None) -> DataFrame:
    """Per row of docs: its id (after it key_col, where that is given), whether it lies in the held-out fold, its score, and `predicted` (1 from the threshold on).

    Null and empty texts have the score of no evidence; without labels every score is one half. Rows without an id are scored
    like others and lie in no fold. Repeated rows and ids are scored each; an id whose labels differ counts as toxic. Very long
    texts are read whole. An empty table gives an empty result; other columns of either table are not read.
    """
    before = written()
    small_batches(docs.sparkSession)
    own = materialize(training_labels(labels, id_col))
    model, sizes = fit(labelled_documents(docs, own, id_col), id_col)
    if model is None:
        seen = docs.select(F.col(key_col or id_col).alias("key"), F.col(id_col).alias("id"), *(F.lit(0).cast("long").alias(c) for c in "sn"))
        calibration = np.zeros(2)
    else:
        free_shuffles(docs.sparkSession)
        seen = evidence(docs, model, id_col, key_col=key_col)
        calibration = calibrate(seen, own.select("label_id", (F.col("label") == 1).cast("int").alias("y")), sizes)
        cleanup(docs.sparkSession, before, (seen,))
    scored = score(seen, calibration)
    ids = [F.col("id").alias(id_col)] + ([F.col("key").alias(key_col)] if key_col else [])
    return scored.select(*ids, F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
