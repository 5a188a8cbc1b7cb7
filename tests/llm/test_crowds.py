"""op2 on crowds of near copies: links as by brute force, and pairs that are no square of the crowd."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from larder.llm import ngram_join
from larder.llm.common import BATCH_BYTES, blocks, map_arrow

WIDTH, SIMILARITY = 5, Fraction(4, 5)


def _texts(crowd: int, twins: int, most: int) -> list[str]:
    """Copies of one text of 150 words, each with 1 to most words changed, and pairs of copies of other texts."""
    rng = np.random.default_rng(crowd)
    base = [f"w{i}" for i in range(150)]
    out = []
    for k in range(crowd):
        text = list(base)
        for at in rng.choice(150, rng.integers(1, most + 1), replace=False):
            text[at] = f"e{k}x{at}"
        out.append(text)
    for k in range(twins):
        text = [f"t{k}x{i}" for i in range(150)]
        out += [text, [*text[:70], "other", *text[71:]]]
    return [" ".join(t) for t in out]


def _components(texts: list[str]) -> list[int]:
    sets = [s for block in blocks(pa.array(texts)) for s in ngram_join.shingle_sets(block, WIDTH)]
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * (c := len(np.intersect1d(a, sets[j], assume_unique=True))) >= 4 * (len(a) + len(sets[j]) - c):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("crowd, twins, most", [(80, 240, 2), (300, 0, 14)])
def test_pairs_of_a_crowd(spark, monkeypatch, crowd, twins, most):
    """A small crowd among many rows is not paired as a whole, and copies with many edits are not paired by edits at one place."""
    made, plain = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))
    texts = _texts(crowd, twins, most)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SIMILARITY, WIDTH).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(_components(texts)))
    assert sum(made) - twins < 6 * crowd


def test_batches_are_small(spark):
    """Rows go to Python in batches of bounded bytes, whatever their number."""
    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) as t")
    sizes = [r.n for r in map_arrow(rows, lambda b: iter([pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})]), "n long").collect()]
    assert len(sizes) > 1 and max(sizes) <= BATCH_BYTES + 2_000_000
