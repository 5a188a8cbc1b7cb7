"""op2 on texts put together from shared passages: links as by brute force, candidates in proportion to documents."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from larder.llm import ngram_join
from larder.llm.common import blocks, materialize

SIMILARITY, WIDTH = Fraction(17, 20), 4


def _texts(n: int, passages: int = 40, each: int = 24, words: int = 20, edits: int = 0) -> list[str]:
    """Texts of `each` of the passages, in their order; every twentieth has a copy with one word changed and one with another passage."""
    rng = np.random.default_rng(n)
    parts = [[f"p{i}x{x}" for x in rng.integers(0, 500, words)] for i in range(passages)]
    out = []
    for k in range(n):
        pick = np.sort(rng.choice(passages, each, replace=False))
        text = [w for i in pick for w in parts[i]]
        for at in rng.integers(0, len(text), edits):
            text[at] = f"e{k}x{at}"
        out.append(text)
        if k % 20 == 0:
            out.append([*text[:100], "other", *text[101:]])
            other = np.setdiff1d(np.arange(passages), pick)[0]
            out.append([w for i in np.sort([*pick[:-1], other]) for w in parts[i]])
    return [" ".join(t) for t in out]


def _sets(texts: list[str]) -> list[np.ndarray]:
    return [s for block in blocks(pa.array(texts)) for s in ngram_join.shingle_sets(block, WIDTH)]


def _similar(sets: list[np.ndarray]) -> set[tuple[int, int]]:
    common = lambda a, b: len(np.intersect1d(a, b, assume_unique=True))
    return {(i, j) for (i, a), (j, b) in combinations(enumerate(sets), 2) if min(len(a), len(b)) * 20 >= max(len(a), len(b)) * 17 and 37 * common(a, b) >= 17 * (len(a) + len(b))}


def _pairs(spark, texts: list[str]) -> tuple[set[tuple[int, int]], int]:
    """The candidates of _by_passages among all the texts as numbers of texts, and the number it tells."""
    rows = [(k, k, len(s), t) for k, (s, t) in enumerate(zip(_sets(texts), texts, strict=True))]
    table = materialize(spark.createDataFrame(rows, "cls long, label long, n int, t string"))
    pairs, about = ngram_join._by_passages(table.select("cls", "label"), table.select("cls", "n", "t"), WIDTH, SIMILARITY)
    return {(r.a, r.b) for r in pairs.collect()}, about


@pytest.mark.parametrize("edits", [0, 1])
def test_passages_lose_no_pair(spark, edits):
    texts = _texts(100, edits=edits)
    wanted, (got, about) = _similar(_sets(texts)), _pairs(spark, texts)
    assert len(wanted) >= 5 and wanted <= got and len(got) <= about


def test_passages_of_other_sizes_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(t.split()[: rng.integers(3, 480)]) for t in _texts(60)] + [" ".join(t.split()[:k]) for t in _texts(20)[:3] for k in (420, 450, 480)] + ["one", "one two"]
    wanted, (got, _) = _similar(_sets(texts)), _pairs(spark, texts)
    assert len(wanted) >= 5 and wanted <= got


def test_candidates_grow_with_documents(spark):
    few, many = (len(_pairs(spark, _texts(n))[0]) / n for n in (200, 1000))
    assert many < 2 * few + 5 and many < 20


def test_links_of_shared_passages(spark, monkeypatch):
    """The whole operator, with every crowded token sent to the passages at once."""
    monkeypatch.setattr(ngram_join, "LEVELS", 0)
    monkeypatch.setattr(ngram_join, "FEW", 1)
    called, plain = [], ngram_join._by_passages
    monkeypatch.setattr(ngram_join, "_by_passages", lambda *a: called.append(1) or plain(*a))
    texts = _texts(160)
    root = list(range(len(texts)))
    similar = _similar(_sets(texts))
    for _ in range(10):
        for i, j in similar:
            root[i] = root[j] = min(root[i], root[j])
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SIMILARITY, WIDTH).collect()
    assert called and {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
