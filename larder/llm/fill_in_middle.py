"""Fill-in-the-middle: a text is cut between units at two ranks, found in an indexable skip list, and its parts change places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, map_arrow, mix, table

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, so many are transformed, and of these so many have their suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = "7"
#: A unit is in the next express lane with a chance of one in 2**FEWER.
FEWER = 2


class SkipList:
    """The units of a text in express lanes: each link carries how many units and how many code points it passes.

    Lane 0 links every unit to the next; a unit's height comes from a hash of its rank, so the same text always has the same
    lanes. The first unit is in every lane.
    """

    def __init__(self, ends: np.ndarray) -> None:
        """ends: for each unit the number of code points up to its end."""
        n, points = len(ends), np.concatenate([[0], ends])
        chance = mix(np.arange(n, dtype=np.uint64)) if n > 1 << FEWER else None
        nodes = np.arange(n)
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        below = nodes
        while True:
            stops = np.append(nodes, n)
            self.lanes.append((np.diff(stops).tolist(), np.diff(points[stops]).tolist(), np.searchsorted(below, nodes).tolist()))
            if chance is None or len(nodes) <= 1 << FEWER:
                break
            below = nodes
            tall = chance[nodes] & np.uint64((1 << FEWER * len(self.lanes)) - 1) == 0
            tall[0] = True
            if tall.all():
                break
            nodes = nodes[tall]

    def points_before(self, rank: int) -> int:
        """The code points of the first `rank` units: down the lanes, along each as far as its widths allow."""
        units = points = at = 0
        for passed, wide, down in reversed(self.lanes):
            while at < len(passed) and units + passed[at] <= rank:
                units += passed[at]
                points += wide[at]
                at += 1
            if units == rank:
                break
            at = down[at]
        return points


def transform(text: str, ends: np.ndarray, draws: tuple[int, int, int, int], rate: int, suffix_first: int, marks: tuple[str, str, str]) -> tuple[str, int | None, int | None, str]:
    """(form, prefix's and middle's code points, output) of a text whose units end at `ends`."""
    n = len(ends)
    if not text or draws[2] % 100 >= rate or any(m in text for m in marks):
        return "plain", None, None, text
    units = SkipList(ends)
    a, b = (units.points_before(r) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    p, s, m = marks
    if draws[3] % 100 < suffix_first:
        return "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """Per row of docs its id, n_units (lines), form, prefix_chars, middle_chars and the transformed text `output`.

    Where and how a text is cut follows from sha256 of `seed:id` alone, so every attempt cuts alike. Null texts count as empty;
    empty texts, those that hold a mark and those beyond the rate stay as they are, in form plain with null chars. An id of null
    counts as an empty one. Very long texts are cut whole. Repeated rows give equal rows; an empty table gives an empty result;
    columns other than the two named are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        drawn = batch.column(2).to_pylist()
        for block in blocks(batch.column(1)):
            points = np.concatenate([[0], np.cumsum(block.data & 0xC0 != 0x80)])
            # a unit ends after each line feed, and at the end of a text that has something after its last one
            last = block.offsets[1:][np.diff(block.offsets) > 0]
            ends = np.union1d(np.flatnonzero(block.data == 10) + 1, last)
            first = np.searchsorted(ends, block.offsets, "right")
            rows = []
            for r in range(block.hi - block.lo):
                h = drawn[block.lo + r]
                own = points[ends[first[r] : first[r + 1]]] - points[block.offsets[r]]
                draws = tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
                rows.append((len(own), *transform(block.text(r).decode(), own, draws, rate, suffix_first, marks)))
            n, form, prefix, middle, output = zip(*rows, strict=True)
            values = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), *values], ["id", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), drawn.alias("h"))
    return map_arrow(rows, run, f"id {kind}, n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("id", id_col)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which fill_in_middle() made output: no part holds a mark, so each mark stands where it was put."""
    p, s, m = marks
    before, after = lambda mark: F.substring_index(output, mark, 1), lambda mark: F.substring_index(output, mark, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(F.substr(before(s), F.lit(len(p) + 1)), after(m), F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), after(m), F.substr(before(p), F.lit(len(s) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


ORACLE_SQL = {
    "op13_fill_in_middle": r"""with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
l as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u from d),
r as (select *, len(u) n, [cast('0x' || substr(h, k, 8) as ubigint) for k in [1, 9, 17, 25]] x from l),
c as (select *, least(x[1] % (n + 1), x[2] % (n + 1)) i, greatest(x[1] % (n + 1), x[2] % (n + 1)) j, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 100 then 'plain' when x[4] % 100 < 50 then 'spm' else 'psm' end form from r),
p as (select *, coalesce(array_to_string(u[1:i], ''), '') a, coalesce(array_to_string(u[i + 1:j], ''), '') m, coalesce(array_to_string(u[j + 1:], ''), '') s from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(a) as bigint) end prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || a || '<M>' || m end) output_sha256, sha256(a || m || s) restored_sha256 from p"""
}
