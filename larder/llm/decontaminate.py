"""Benchmark decontamination: one Aho-Corasick automaton over the words of test questions and answers, each text scanned once."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, blocks, hash_spans, map_arrow, materialize, numbered, table, words_of

#: Words of a window.
WINDOW = 10
#: Windows of an automaton, at most about: some 55 MB. A benchmark of more is dealt to several automata, whose hits are united.
PART_WINDOWS = 1 << 18
#: Words that a lane of a scan has of its own.
LANE = 256

#: What normalising makes of a byte: A to Z become small, letters, digits and all bytes beyond ASCII stay, others part words.
NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58] = np.arange(48, 58)
NORMAL[65:91] = NORMAL[97:123] = np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)


def _normalised(block: Block) -> Block:
    """Bytes keep their places, so the places of words are those in the original text."""
    return Block(block.lo, block.hi, NORMAL[block.data], block.offsets)


@dataclass
class Automaton:
    """States are numbered by depth, the children of a state follow each other: child number i + 1 has the i-th key state * words + word."""

    words: np.ndarray  # sorted fingerprints of the words
    keys: np.ndarray
    first: np.ndarray  # a state's first child
    first_word: np.ndarray  # and the word that leads there, -1 without one
    several: np.ndarray
    root: np.ndarray  # the root's child by word, 0 without one
    fail: np.ndarray  # the longest proper suffix of a state that is a state
    emits: np.ndarray  # the longest suffix, itself included, that is a pattern, 0 without one
    depth: np.ndarray
    bounds: np.ndarray  # items[bounds[s]:bounds[s + 1]]: the items of pattern s
    items: np.ndarray
    names: list[str]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next states: the child by word of the longest suffix of each state that has one, else the root."""
        out = np.zeros(len(state), np.int32)
        todo = np.arange(len(state))
        while len(todo):
            at_root = state == 0
            found = np.where(at_root, self.root[word], np.where(self.first_word[state] == word, self.first[state], 0)).astype(np.int32)
            look = np.flatnonzero((found == 0) & self.several[state] & ~at_root)
            if len(look):
                key = state[look].astype(np.int64) * len(self.words) + word[look]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found[look] = np.where(self.keys[at] == key, at + 1, 0)
            out[todo] = found
            on = (found == 0) & ~at_root
            todo, state, word = todo[on], self.fail[state[on]], word[on]
        return out


def build(patterns: np.ndarray, items: np.ndarray, names: list[str]) -> Automaton:
    """patterns: a row of word fingerprints per pattern, 0 after the end of a shorter one; items: the number of each row's item."""
    words = np.unique(patterns)
    words = words[words != 0]
    numbers = np.where(patterns == 0, -1, np.searchsorted(words, patterns)).astype(np.int64)
    n_words, node = len(words), np.zeros(len(patterns), np.int64)
    auto = Automaton(
        words, np.zeros(0, np.int64), np.zeros(1, np.int32), np.full(1, -1, np.int32), np.zeros(1, bool), np.zeros(n_words, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int16),
        np.zeros(0, np.int64), np.zeros(0, np.int32), names,
    )
    for depth in range(patterns.shape[1]):
        on = np.flatnonzero(numbers[:, depth] >= 0)
        if not len(on):
            break
        keys, inverse = np.unique(node[on] * n_words + numbers[on, depth], return_inverse=True)
        start = len(auto.fail)
        parent, word = keys // n_words, (keys % n_words).astype(np.int32)
        if depth == 0:
            auto.root[word] = np.arange(start, start + len(keys))
            fail = np.zeros(len(keys), np.int32)
        else:
            fail = auto.step(auto.fail[parent], word)
        node[on] = start + inverse
        begins = np.flatnonzero(np.diff(parent, prepend=-1))
        auto.first[parent[begins]], auto.first_word[parent[begins]] = start + begins, word[begins]
        auto.several[parent[begins]] = np.diff(np.append(begins, len(keys))) > 1
        more = lambda have, value: np.concatenate([have, np.full(len(keys), value, have.dtype)])
        auto.keys = np.concatenate([auto.keys, keys])
        auto.first, auto.first_word, auto.several, auto.depth = more(auto.first, 0), more(auto.first_word, -1), more(auto.several, False), more(auto.depth, depth + 1)
        auto.fail, auto.emits = np.concatenate([auto.fail, fail]), more(auto.emits, 0)
    pairs = np.unique(np.stack([node, items.astype(np.int64)], 1), axis=0) if len(node) else np.zeros((0, 2), np.int64)
    auto.items, auto.bounds = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(auto.fail) + 1))
    # suffixes are less deep, so they have their answer by the time that a level asks for it
    ends = np.diff(auto.bounds) > 0
    own = np.where(ends, np.arange(len(ends)), 0).astype(np.int32)
    for depth in range(1, int(auto.depth.max()) + 1):
        level = np.flatnonzero(auto.depth == depth)
        auto.emits[level] = np.where(ends[level], own[level], auto.emits[auto.fail[level]])
    return auto


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item, place, pattern): every window of consecutive words, as fingerprints; an item of fewer words is one window of all of them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            block = _normalised(block)
            words = words_of(block)
            marks = hash_spans(block.data, words.starts, words.ends, lower=False).view(np.int64)
            for r in range(block.hi - block.lo):
                own = marks[words.bounds[r] : words.bounds[r + 1]]
                if len(own):
                    rows = np.lib.stride_tricks.sliding_window_view(own, min(width, len(own)))
                    flat, cuts = pa.array(rows.ravel(), pa.int64()), pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([names[block.lo + r]] * len(rows), pa.string()), pa.array(np.arange(len(rows)), pa.int64()), pa.ListArray.from_arrays(cuts, flat)], ["item", "place", "pattern"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(rows, run, "item string, place bigint, pattern array<bigint>")


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW, part_windows: int = PART_WINDOWS) -> DataFrame:
    """(part, automaton): windows dealt by item and place, so that parts are of bounded size however often a window or an item comes; each part is built by a task of its own and written."""
    found = materialize(windows(benchmark, item_col, text_col, width))
    parts = max(1, -(-found.count() // part_windows))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        longest = int(frame["pattern"].str.len().max())
        patterns = np.zeros((len(frame), longest), np.uint64)
        for i, row in enumerate(frame["pattern"]):
            patterns[i, : len(row)] = np.asarray(row, np.int64).view(np.uint64)
        names, items = np.unique(frame["item"].to_numpy(str), return_inverse=True)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "automaton": [pickle.dumps(build(patterns, items, names.tolist()), 5)]})

    dealt = found.select(F.pmod(F.xxhash64("item", "place"), F.lit(parts)).alias("part"), "item", "pattern")
    return materialize(dealt.groupBy("part").applyInPandas(run, "part bigint, automaton binary"))


def _scan(auto: Automaton, numbers: np.ndarray, fresh: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """All lanes step together: the places of words after which a pattern ends, and the longest such pattern of each.

    numbers: the number of each word, -1 for one of no pattern; fresh: whether a text begins with it. A lane reads the words
    before its own that the longest pattern may need, which brings it to the state that it would have had from the start on.
    """
    n, before = len(numbers), int(auto.depth.max()) - 1
    own = np.arange(0, n, lane)
    at, stop = np.maximum(own - before, 0), np.minimum(own + lane, n)
    state, found_at, found = np.zeros(len(own), np.int32), [], []
    for _ in range(lane + before):
        word = numbers[at]
        state[fresh[at] | (word < 0)] = 0
        on = np.flatnonzero(word >= 0)
        state[on] = auto.step(state[on], word[on])
        hit = np.flatnonzero((auto.emits[state] > 0) & (at >= own))
        if len(hit):
            found_at.append(at[hit])
            found.append(auto.emits[state[hit]])
        at = at + 1
        left = at < stop
        if not left.all():
            at, stop, own, state = at[left], stop[left], own[left], state[left]
            if not len(at):
                break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    where, what = np.concatenate(found_at), np.concatenate(found)
    order = np.argsort(where, kind="stable")
    return where[order], what[order]


def _hits(auto: Automaton, block: Block) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int, int, int]], list[str]]]]:
    """Words of each row; for rows that are hit, spans (first and last word + 1, first byte and last + 1) and items."""
    normal = _normalised(block)
    words = words_of(normal)
    n, counts = len(words.starts), np.diff(words.bounds)
    if not n or not len(auto.words):
        return counts, {}
    marks = hash_spans(normal.data, words.starts, words.ends, lower=False)
    at = np.minimum(np.searchsorted(auto.words, marks), len(auto.words) - 1)
    numbers = np.where(auto.words[at] == marks, at, -1)
    fresh = np.zeros(n, bool)
    fresh[words.bounds[:-1][counts > 0]] = True
    where, what = _scan(auto, numbers, fresh)
    if not len(where):
        return counts, {}
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, where - auto.depth[what] + 1, 1)
    np.add.at(edge, where + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    begin = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | fresh))
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | np.concatenate([fresh[1:], [True]]))) + 1
    row_of = lambda x: np.searchsorted(words.bounds, x, "right") - 1
    # shorter patterns that end at the same places
    rows, states = row_of(where), what
    pairs = [np.stack([rows, states], 1)]
    while len(states):
        states = auto.emits[auto.fail[states]]
        rows, states = rows[states > 0], states[states > 0]
        pairs.append(np.stack([rows, states], 1))
    seen = np.unique(np.concatenate(pairs), axis=0)
    out: dict[int, tuple[list, list]] = {}
    for a, b, r in zip(begin.tolist(), end.tolist(), row_of(begin).tolist(), strict=True):
        first, origin = int(words.bounds[r]), int(block.offsets[r])
        out.setdefault(r, ([], []))[0].append((a - first, b - first, int(words.starts[a]) - origin, int(words.ends[b - 1]) - origin))
    cut = np.flatnonzero(np.diff(seen[:, 0], prepend=-1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(seen)], strict=True):
        every = np.unique(np.concatenate([auto.items[auto.bounds[s] : auto.bounds[s + 1]] for s in seen[lo:hi, 1].tolist()]))
        out[int(seen[lo, 0])][1].extend(auto.names[i] for i in every.tolist())
    return counts, out


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("start_char", pa.int64()), ("stop_char", pa.int64())]))
_SCHEMA = "n_words bigint, spans array<struct<first:bigint,stop:bigint,start_char:bigint,stop_char:bigint>>, items array<string>"


def _scanned(docs: DataFrame, key: str, text_col: str, automaton: bytes) -> DataFrame:
    """(key, n_words, spans, items) of each row by one automaton, which workers receive once."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(automaton)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = pickle.loads(held.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                counts, found = _hits(auto, block)
                spans, items = [[]] * len(counts), [[]] * len(counts)
                for r, (own, names) in found.items():
                    lead = np.concatenate([[0], np.cumsum(block.data[block.offsets[r] : block.offsets[r + 1]] & 0xC0 != 0x80)])
                    spans[r] = [{"first": a, "stop": b, "start_char": int(lead[x]), "stop_char": int(lead[y])} for a, b, x, y in own]
                    items[r] = names
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(counts)), pa.array(counts, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))], ["key", "n_words", "spans", "items"])

    return docs.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"key {kind}, {_SCHEMA}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, part_windows: int = PART_WINDOWS
) -> DataFrame:
    """Per row of docs its id, n_words, `spans` of hit words (first word and last + 1, the same in code points of the original text), n_hit and the `items` hit, sorted.

    A word is hit inside any occurrence of a window of `width` consecutive words of an item; an item of fewer words, but not
    none, is one window. Null texts have no words; an item without an id counts as one of empty name, items of one id as one
    item. Very long texts are read whole, repeated rows are judged each, columns other than those named are not read; an empty
    table gives an empty result, an empty benchmark hits nothing. Words are compared by fingerprints of 64 bits.
    """
    parts = automata(benchmark, item_col, item_text_col, width, part_windows)
    numbers = [r.part for r in parts.select("part").sort("part").collect()]
    one = lambda part: parts.filter(F.col("part") == part).first().automaton
    if len(numbers) < 2:
        # one automaton: each text is scanned once and its row is whole
        only = one(numbers[0]) if numbers else pickle.dumps(build(np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), []), 5)
        out = _scanned(docs, id_col, text_col, only).withColumnRenamed("key", id_col)
    else:
        rows, row = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
        # one automaton at a time goes through the driver; only hit rows are kept of each
        found = [materialize(_scanned(rows, row, "t", one(part)).select("key", "n_words", "spans", "items", F.lit(part).alias("part")).filter(f"part = {numbers[0]} or size(spans) > 0")) for part in numbers]
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        united = every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        kind = "array<struct<first:bigint,stop:bigint,start_char:bigint,stop_char:bigint>>"
        # sorted spans: one that begins inside the last lengthens it, another follows; spans that only touch are one
        merged = F.expr(
            f"aggregate(s, cast(array() as {kind}), (a, x) -> case when size(a) > 0 and x.first <= element_at(a, -1).stop then concat(slice(a, 1, size(a) - 1), array(named_struct("
            "'first', element_at(a, -1).first, 'stop', greatest(element_at(a, -1).stop, x.stop), 'start_char', element_at(a, -1).start_char, 'stop_char', greatest(element_at(a, -1).stop_char, x.stop_char)))) "
            "else concat(a, array(x)) end)"
        )
        ids = rows.select(F.col(row).alias("key"), F.col("id").alias(id_col))
        out = united.select("key", "n_words", merged.alias("spans"), "items").join(ids, "key").drop("key")
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["first"])).select(id_col, "n_words", "n_hit", "spans", "items")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The window of k words that begins with a word, null where the text ends before.
_LEADS = "".join(f", case when last >= i + {k - 1} then " + " || ' ' || ".join(["w", *(f"lead(w, {j}) over r" for j in range(1, k))]) + f" end s{k}" for k in range(1, WINDOW + 1))
ORACLE_SQL = {
    "op12_decontamination": f"""with d as (select row_number() over () r, doc_id, {_WORDS} l from documents), b as (select row_number() over () r, coalesce(cast(item_id as varchar), '') item, {_WORDS} l from benchmark),
dw as (select r, unnest(l) w, unnest(range(1, len(l) + 1)) i, len(l) last from d), bw as (select r, item, unnest(l) w, unnest(range(1, len(l) + 1)) i, len(l) last from b),
dl as (select *{_LEADS} from dw window r as (partition by r order by i)), bl as (select *{_LEADS} from bw window r as (partition by r order by i)),
p as ({" union ".join(f"select item, {k} k, s{k} s from bl where least(last, {WINDOW}) = {k} and s{k} is not null" for k in range(1, WINDOW + 1))}),
h as ({" union all ".join(f"select dl.r, i, k, item from dl join p on k = {k} and s = s{k}" for k in range(1, WINDOW + 1))}),
hit as (select r, count(distinct j) n_hit from (select r, unnest(range(i, i + k)) j from (select distinct r, i, k from h)) group by 1),
it as (select r, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct r, item from h) group by 1)
select doc_id, cast(len(l) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join hit using (r) left join it using (r)"""
}
