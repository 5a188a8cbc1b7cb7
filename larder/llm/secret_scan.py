"""Secrets in texts, found by one automaton for all rules.

The rules' expressions are compiled together (automaton.py) and every text is read once, byte by byte, whatever the number
of rules. Least lengths are no part of the expressions, as in the contract: leftmost, non-overlapping matches that are too
short are dropped after they have taken their bytes; so no counters run side by side in the automaton. Only where a match is a
plain run of bytes is its least length compiled in. Where the automaton accepts for a rule, the spans in the stretch of bytes
around that the rule can use at all come from two small automata of the rule: one that reads the stretch backwards marks where
matches start, the other goes from the first of these to the longest end, and on behind it. Stretches without an accepting
state hold no secret and are not looked at again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import PART, Automaton, alphabet, compile_rules, scan
from .common import Block, blocks, map_arrow, table


@dataclass(frozen=True)
class Rule:
    """exact: the expression whose matches are found, leftmost, longest, one after the other; least: characters that a match must
    have behind what `head` matches of it; coarse: what the automaton of all rules looks for, where that is not exact: an
    expression that matches inside every long enough match of exact."""

    kind: str
    exact: bytes
    head: bytes = b""
    least: int = 0
    coarse: bytes = b""


_ASSIGN = rb"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""

# The rules of the contract, then the further kinds that this method adds.
BASE_RULES = (
    Rule("assign", _ASSIGN + rb"[A-Za-z0-9+/_.=-]+", head=_ASSIGN, least=8),
    Rule("access", rb"AKIA[A-Z0-9]+", least=16),
    Rule("hex", rb"[0-9a-f]+", least=32, coarse=rb"[0-9a-f]{32,}"),
)
# A key runs to its END line; where that is missing, over its head lines and base64 lines, of which the last may be short.
# Line feeds may be written as backslash n.
_BEGIN = rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_FEED = rb"""(?:[\s"'>|#*]|\\[nr])+"""
_TO_END = rb"""(?:-?[A-Za-z0-9+/=\s\\:,."'>|#*;()_])*-----END [A-Z ]*PRIVATE KEY-----"""
_LINES = rb"(?:%s(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]+)*(?:%s[A-Za-z0-9+/]{40,}={0,2})*(?:%s[A-Za-z0-9+/]{2,}={1,2}|(?:\r?\n|\\n)[A-Za-z0-9+/]{20,})?" % (_FEED, _FEED, _FEED)
MORE_RULES = (
    Rule("private_key", rb"%s(?:%s|%s)" % (_BEGIN, _TO_END, _LINES), coarse=_BEGIN),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=36),
    Rule("forge_token", rb"gh[pousr]_[A-Za-z0-9]+", least=24),
    Rule("chat_token", rb"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("cloud_key", rb"AIza[A-Za-z0-9_-]+", least=24),
    Rule("pay_key", rb"[rs]k_(?:live|test)_[A-Za-z0-9]+", least=24),
    Rule("url_login", rb"[a-z]+://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+-]+@"),
)
RULES = BASE_RULES + MORE_RULES


@lru_cache
def usable(rule: Rule) -> np.ndarray:
    """Which bytes a match of the rule can hold at all."""
    return alphabet(rule.exact)


def compiled(rules: tuple[Rule, ...] = RULES) -> Automaton:
    # a run at an expression's end is known by its first byte
    return compile_rules([r.coarse or (r.exact[:-1] if r.exact.endswith(b"]+") else r.exact) for r in rules])


@lru_cache
def spans_of(rule: Rule) -> tuple[Automaton, Automaton, Automaton | None]:
    """The rule's own automata: backwards for starts, forwards for ends, and for the end of its head."""
    return compile_rules([rule.exact], backwards=True), compile_rules([rule.exact], anywhere=False), compile_rules([rule.head], anywhere=False) if rule.head else None


def _block_spans(block: Block, rules: tuple[Rule, ...], auto: Automaton) -> dict[int, list[tuple[int, int, int]]]:
    """For each row with a secret: (start, end, rule) in bytes of its text."""
    n = len(block.offsets) - 1
    data = np.full(len(block.data) + n, PART, np.uint8)  # a parting byte after each text
    begins = block.offsets[:-1] + np.arange(n)
    data[np.arange(len(block.data)) + np.repeat(np.arange(n), np.diff(block.offsets))] = block.data
    places, masks = scan(auto, data)
    found: dict[int, list[tuple[int, int, int]]] = {}
    content = data.tobytes() if len(places) else b""
    for k, rule in enumerate(rules):
        ends = places[(masks >> k) & 1 == 1]
        if not len(ends):
            continue
        backwards, forwards, head = spans_of(rule)
        foreign = np.flatnonzero(~usable(rule)[data])
        at = 0
        while at < len(ends):
            right = int(np.searchsorted(foreign, ends[at]))
            lo = int(foreign[right - 1]) + 1 if right else 0
            hi = int(foreign[right]) if right < len(foreign) else len(data)
            row = int(np.searchsorted(begins, lo, "right")) - 1
            done = lo
            for start in reversed(backwards.starts(content, lo, hi)):
                if start < done:
                    continue
                done = forwards.longest(content, start, hi)
                if done - (head.longest(content, start, done) if head else start) >= rule.least:
                    found.setdefault(row, []).append((start - int(begins[row]), done - int(begins[row]), k))
            at = int(np.searchsorted(ends, hi, "right"))
    return found


def _text_spans(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte places to code points, in order of start, then rule."""
    lead = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))
    return [(int(lead[a]), int(lead[b]), k) for a, b, k in sorted(spans, key=lambda x: (x[0], x[2]))]


def _each_block(column: pa.Array, rules: tuple[Rule, ...], auto: Automaton) -> Iterator[tuple[Block, dict[int, list[tuple[int, int, int]]]]]:
    for block in blocks(column):
        yield block, _block_spans(block, rules, auto)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs its id and `spans`, an array of (kind, start, stop) in code points, by start, then rule order.

    Null and empty texts have no spans. Very long texts are read whole, however long the runs in them. Repeated rows and ids are
    kept as they are; columns other than the two named are not read. Spans of several kinds that start alike stand in the order
    of the rules. An empty table gives an empty result.
    """
    auto = compiled(rules)
    kind = docs.schema[id_col].dataType.simpleString()
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[list[dict]] = []
        for block, found in _each_block(batch.column(1), rules, auto):
            for r in range(block.hi - block.lo):
                spans = _text_spans(block.text(r), found[r]) if r in found else []
                rows.append([{"kind": rules[k].kind, "start": a, "stop": b} for a, b, k in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, out)], ["id", "spans"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")), run, f"id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with each secret in its texts, overlapping ones as one, replaced by mask. Null texts stay null; all other columns are kept."""
    auto = compiled(rules)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            column = part.column(at)
            changed: dict[int, str] = {}
            for block, found in _each_block(column, rules, auto):
                for r, spans in found.items():
                    text, out, done = block.text(r), [], 0
                    for a, b, _ in sorted(spans):
                        if a >= done:
                            out += [text[done:a], mask.encode()]
                        done = max(done, b)
                    changed[block.lo + r] = b"".join([*out, text[done:]]).decode()
            if changed:
                values = column.to_pylist()
                for r, text in changed.items():
                    values[r] = text
                part = part.set_column(at, part.schema.field(at), pa.array(values, column.type))
            yield part

    return map_arrow(docs, run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of secret_spans() as counts and digest columns of the base kinds, and all spans as one string."""
    base = {r.kind: i for i, r in enumerate(BASE_RULES)}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, shas, alls = [], [], []
        for row in batch.column(1).to_pylist():
            said = [f"{x['kind']}:{x['start']}:{x['stop']}" for x in row]
            own = [s for s, x in zip(said, row, strict=True) if x["kind"] in base]
            counts.append([sum(x["kind"] == k for x in row) for k in base])
            shas.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            alls.append(",".join(said))
        n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array(shas), pa.array(alls)], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(secret_spans(docs, id_col, text_col), run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
