"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document's statistics are transformed to a vector of bounded or logarithmic values. Every language and source gets a
minimum-covariance-determinant estimate of the vectors' centre and spread, in the manner of FAST-MCD (Rousseeuw and Van
Driessen 1999): from many small random subsets of about SAMPLE of its rows concentration steps are taken on these rows, and
the STARTS estimates of least determinant go on over all rows: each step takes mean and covariance of the share of rows that
lie nearest by the last estimate, which never raises the determinant. Steps end when no determinant falls any more, and the
estimate of the least is kept. A step is one aggregation of all rows by group and narrow bin of distance, of which the last
counts in part, so that no group is ever gathered.

The estimates of a language, and of all rows, are made alike. A group's estimate is drawn to its language's by what PRIOR_ROWS
rows weigh, and that to the one of all rows, so that groups of few rows, or of one, are judged as well. A document is rejected
when its squared Mahalanobis distance is beyond the chi-square quantile of 1 - TAIL.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IS_WORD, Block, Words, blocks, cleanup, hash_spans, map_arrow, materialize, mix, table, words_of, written

SYMBOLS = b"#*$%&|<>"
#: The vector's statistics, each with the least standard deviation that an estimate may give it: most documents have no
#: symbols or repeated lines at all, and a spread of zero would reject any that has one. At their largest values each of them
#: alone is beyond the limit.
VECTOR = {
    "v_symbols": 0.02,
    "v_marks": 0.03,
    "v_upper": 0.05,
    "v_word_len": 0.10,
    "v_repeats": 0.07,
    "v_dup_lines": 0.15,
}
#: Share of rows in an estimate; share of Gaussian rows that are rejected.
SHARE, TAIL = 0.75, 1e-6
#: Rows of a group on which the first steps are taken, about; random subsets of them; estimates that go on over all rows.
SAMPLE, SUBSETS, STARTS = 500, 50, 2
#: Steps over all rows at most, and the fall of a logarithm of a determinant that is worth another.
MOST_STEPS, LEAST_FALL = 8, 0.01
#: Rows that the wider group's estimate weighs in a group's.
PRIOR_ROWS = 100.0
#: Bins of squared distance in a unit of its logarithm.
BINS = 32

_FLAGS = np.zeros((6, 256), bool)
_FLAGS[0] = IS_WORD
_FLAGS[1, list(range(0x80, 0xC0))] = True  # continuation bytes
_FLAGS[2, list(SYMBOLS)] = True
_FLAGS[3, [b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS]] = True
_FLAGS[4, list(range(65, 91))] = True
_FLAGS[5, list(range(65, 91)) + list(range(97, 123))] = True


def _count(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated_words(block: Block, words: Words, width: int = 5) -> np.ndarray:
    """Per row: words that lie in a window of so many words which the text holds twice or more."""
    n_words = len(words.starts)
    rows = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    covered = np.zeros(n_words, bool)
    n = n_words - width + 1
    if n > 0:
        h = hash_spans(block.data, words.starts, words.ends, lower=False)
        key = np.zeros(n, np.uint64)
        for k in range(width):
            key = mix(key * np.uint64(3) + h[k : k + n])
        at = np.flatnonzero(rows[:n] == rows[width - 1 :])
        key = mix(key[at] ^ mix(rows[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for k in range(width):
            covered[at[twice] + k] = True
    return _count(covered, words.bounds)


def _repeated_lines(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word that equal an earlier line of the text, and all lines with a word."""
    n = len(block.offsets) - 1
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]))
    row = np.searchsorted(block.offsets, starts, "right") - 1
    # a line feed at a text's end begins an empty line, which holds no word; it must not pass for the next text's first
    ends = np.minimum(np.append(starts[1:], len(block.data)), block.offsets[np.minimum(row, n - 1) + 1])
    ends = np.where(np.isin(ends - 1, breaks), ends - 1, ends)
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    keep = has & (ends > starts)
    starts, ends, row = starts[keep], ends[keep], row[keep]
    key = mix(hash_spans(block.data, starts, ends, lower=False) ^ mix(row.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    lines = np.bincount(row, minlength=n)
    return lines - np.bincount(row[first], minlength=n), lines


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters", "n_seen")


def _stats(block: Block) -> list[np.ndarray]:
    data, offsets = block.data, block.offsets
    words = words_of(block)
    n_words = np.diff(words.bounds)
    inside, follow, symbol, mark, upper, letter = (_FLAGS[k][data] for k in range(6))
    dup, lines = _repeated_lines(block, words)
    return [
        n_words, _count(inside & ~follow, offsets), _count(symbol, offsets), dup, _repeated_words(block, words), lines,
        _count(mark, offsets), _count(upper, offsets), _count(letter, offsets), _count(~follow, offsets),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Each row's id, its groups (as strings, null as empty) and counts over its whole text; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"g{i}" for i in range(len(groups))]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [_stats(block) for block in blocks(batch.column(1))]
        found = [pa.array(np.concatenate([p[k] for p in parts]), pa.int64()) for k in range(len(_STATS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *found], ["id", *names, *_STATS])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), *(F.coalesce(F.col(g).cast("string"), F.lit("")).alias(n) for g, n in zip(groups, names, strict=True)))
    return map_arrow(chosen, run, f"id {kind}, " + ", ".join(f"{n} string" for n in names) + ", " + ", ".join(f"{n} bigint" for n in _STATS))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics: roots of shares, which spread small shares, and the logarithm of the mean word length."""
    share = lambda x, of: F.sqrt(F.least(F.lit(1.0), F.col(x) / F.greatest(F.col(of), F.lit(1)).cast("double")))
    return stats.withColumns(
        {
            "v_symbols": share("n_symbols", "n_seen"),
            "v_marks": share("n_marks", "n_seen"),
            "v_upper": share("n_upper", "n_letters"),
            "v_word_len": F.log((F.col("word_chars") + 5) / (F.col("n_words") + 1).cast("double")),
            "v_repeats": share("n_repeat_words", "n_words"),
            "v_dup_lines": share("n_dup_lines", "n_lines"),
        }
    )


def _square(center: str = "center", inverse: str = "inverse") -> F.Column:
    """The squared Mahalanobis distance, written out so that it runs inside generated code."""
    names, p = list(VECTOR), len(VECTOR)
    d = [F.col(v) - F.col(center)[i] for i, v in enumerate(names)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col(inverse)[i * p + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _floor() -> np.ndarray:
    return np.diag(np.array(list(VECTOR.values())) ** 2)


def _spread(covariance: np.ndarray) -> np.ndarray:
    """A trimmed covariance made as large as a Gaussian's (Croux and Haesbroeck), and no spread below the least."""
    p = len(VECTOR)
    return covariance * (SHARE / _chi2_cdf(_chi2_quantile(SHARE, p), p + 2)) + _floor()


def _distances(x: np.ndarray, center: np.ndarray, spread: np.ndarray) -> np.ndarray:
    d = x - center
    return np.einsum("ij,ij->i", d @ np.linalg.inv(spread), d)


def mcd(x: np.ndarray, seed: int, subsets: int = SUBSETS, starts: int = STARTS) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best `starts` estimates of the rows of x: logarithm of the determinant, centre, spread; least determinant first."""
    n, p = x.shape
    h = max(1, math.ceil(SHARE * n))
    rng = np.random.default_rng(seed)

    def step(center: np.ndarray, spread: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        near = x[np.argpartition(_distances(x, center, spread), h - 1)[:h]]
        spread = _spread(np.cov(near.T, bias=True) if h > 1 else np.zeros((p, p)))
        return float(np.linalg.slogdet(spread)[1]), near.mean(axis=0), spread

    found = []
    for _ in range(subsets):
        some = x[rng.choice(n, min(n, p + 1), replace=False)]
        now = step(some.mean(axis=0), _spread(np.cov(some.T, bias=True) if len(some) > 1 else np.zeros((p, p))))
        found.append(step(*now[1:]))
    found.sort(key=lambda e: e[0])
    best: list[tuple[float, np.ndarray, np.ndarray]] = []
    for now in found[:10]:
        for _ in range(50):
            then = step(*now[1:])
            if then[0] >= now[0] - 1e-9:
                break
            now = then
        best.append(now)
    best.sort(key=lambda e: e[0])
    kept: list[tuple[float, np.ndarray, np.ndarray]] = []
    for now in best:
        if all(abs(now[0] - k[0]) > 1e-6 for k in kept):
            kept.append(now)
    return kept[:starts]


def _chi2_cdf(x: float, k: int) -> float:
    """For even k."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < share else (lo, mid)
    return lo


_ESTIMATE = "a string, b string, start int, rows bigint, log_det double, center array<double>, spread array<double>, inverse array<double>"


def _record(a: str, b: str, start: int, rows: int, estimate: tuple[float, np.ndarray, np.ndarray]) -> dict:
    log_det, center, spread = estimate
    return {"a": a, "b": b, "start": start, "rows": rows, "log_det": log_det, "center": center, "spread": spread.ravel(), "inverse": np.linalg.inv(spread).ravel()}


_COLUMNS = ["a", "b", "start", "rows", "log_det", "center", "spread", "inverse"]


def _starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """STARTS estimates of each group from about SAMPLE of its rows, chosen by a hash threshold from the group's size (a, b, rows)."""
    place = F.pmod(F.xxhash64("key", *VECTOR), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(sizes, ["a", "b"]).filter(place * F.col("rows") < SAMPLE)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # in an order of its own, so that every attempt has the same
        x = frame[list(VECTOR)].to_numpy(float)
        x = x[np.lexsort(x.T)]
        found = mcd(x, zlib.crc32("\0".join(key).encode()))
        return pd.DataFrame([_record(*key, k, int(frame.rows.iloc[0]), e) for k, e in enumerate(found)], columns=_COLUMNS)

    return chosen.select("a", "b", "rows", *VECTOR).groupBy("a", "b").applyInPandas(run, _ESTIMATE)


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimates now after a concentration step over all rows."""
    names, p = list(VECTOR), len(VECTOR)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    near = rows.join(now.select("a", "b", "start", "center", "inverse"), ["a", "b"]).withColumn("bin", F.floor(F.log(_square() + 1e-9) * BINS))
    binned = near.groupBy("a", "b", "start", "bin").agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs))
    by = Window.partitionBy("a", "b", "start")
    ranked = binned.withColumns({"below": F.sum("n").over(by.orderBy("bin")) - F.col("n"), "rows": F.sum("n").over(by)})
    # the bin in which the share is reached counts in part
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ceil(SHARE * F.col("rows")) - F.col("below")) / F.col("n")))
    sums = ranked.withColumn("part", part).filter("part > 0").groupBy("a", "b", "start").agg(
        F.max("rows").alias("rows"), F.sum(F.col("n") * F.col("part")).alias("n"),
        F.array(*(F.sum(F.col(f"s{i}") * F.col("part")) for i in range(p))).alias("sums"), F.array(*(F.sum(F.col(f"q{i}_{j}") * F.col("part")) for i, j in pairs)).alias("squares"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(p)
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mean, square = np.array(r.sums) / r.n, np.zeros((p, p))
                square[upper] = np.array(r.squares) / r.n
                square = square + np.triu(square, 1).T
                spread = _spread(square - np.outer(mean, mean))
                out.append(_record(r.a, r.b, r.start, r.rows, (float(np.linalg.slogdet(spread)[1]), mean, spread)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return sums.mapInPandas(run, _ESTIMATE)


def estimates(rows: DataFrame) -> DataFrame:
    """Per group (a, b) of rows (key, a, b and VECTOR): its rows, and centre and spread of the least determinant found."""
    sizes = materialize(rows.groupBy("a", "b").agg(F.count("*").alias("rows")))
    now = materialize(_starts(rows, sizes))
    for k in range(MOST_STEPS):
        then = materialize(_step(rows, now))
        before = now.select("a", "b", "start", F.col("log_det").alias("before"))
        fall = then.join(before, ["a", "b", "start"]).agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        # the first step over all rows may raise what a sample had made too small
        now = then
        if fall is None or (k and fall < LEAST_FALL):
            break
    return now.groupBy("a", "b").agg(F.min_by(F.struct("rows", "center", "spread"), F.struct("log_det", "start")).alias("e")).select("a", "b", "e.*")


#: Stands for any language and source: no name of one can be it, as it holds a zero character.
_EVERY = "\0every"


def _drawn(found: DataFrame) -> DataFrame:
    """(a, b, center, inverse) of each group, drawn to its language's estimate and that to the one of all rows."""
    p = len(VECTOR)
    level = lambda df, k: df.select(*("a", "b")[: 2 - k], *(F.col(c).alias(f"{c}{k}") for c in ("rows", "center", "spread")))
    own = level(found.filter(F.col("b") != _EVERY), 0)
    language = level(found.filter((F.col("a") != _EVERY) & (F.col("b") == _EVERY)), 1)
    every = level(found.filter(F.col("a") == _EVERY), 2)
    joined = own.join(language, "a").crossJoin(F.broadcast(every))  # every is one row

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                center, spread = np.array(r["center2"]), np.array(r["spread2"]).reshape(p, p)
                for k in (1, 0):
                    w = r[f"rows{k}"] / (r[f"rows{k}"] + PRIOR_ROWS)
                    apart = np.array(r[f"center{k}"]) - center
                    spread = w * np.array(r[f"spread{k}"]).reshape(p, p) + (1 - w) * spread + w * (1 - w) * np.outer(apart, apart)
                    center = center + w * apart
                out.append({"a": r["a"], "b": r["b"], "center": center, "inverse": np.linalg.inv(spread).ravel()})
            yield pd.DataFrame(out, columns=["a", "b", "center", "inverse"])

    return joined.mapInPandas(run, "a string, b string, center array<double>, inverse array<double>")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Per row of docs: its counts, `base_failed`, `distance` (Mahalanobis, by its group's estimate) and `kept`.

    Null texts count as empty and fail the base rules; null languages and sources are groups of their own, the same as empty
    names; repeated rows are judged each. Very long texts are read whole. Rows at equal distances count alike in an estimate,
    and statistics that are the same in all rows have their least spread. An empty table gives an empty result. Rows that fail
    the base rules take no part in the estimates; where no row passes, there is no distance. Other columns are not read.
    """
    before = written()
    rows = materialize(vectors(statistics(docs, id_col, text_col, (lang_col, source_col))).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    # each row counts for its group, its language and all rows
    every = F.lit(_EVERY)
    sound = rows.filter("not base_failed").select(
        F.explode(F.array(F.struct(F.col("g0").alias("a"), F.col("g1").alias("b")), F.struct(F.col("g0").alias("a"), every.alias("b")), F.struct(every.alias("a"), every.alias("b")))).alias("g"), F.col("id").alias("key"), *VECTOR
    ).select("g.*", "key", *VECTOR)
    level = materialize(_drawn(estimates(sound)))
    cleanup(docs.sparkSession, before, (rows, level))
    out = rows.join(level, (F.col("g0") == F.col("a")) & (F.col("g1") == F.col("b")), "left").withColumn("distance", F.sqrt(_square()))
    limit = math.sqrt(_chi2_quantile(1 - tail, len(VECTOR)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
