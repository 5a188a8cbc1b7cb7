"""The pipeline's stages, each on its own input, against plain versions."""

import re

import numpy as np
import pytest
from larder.llm import quality_rules

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, row long, gone string, key int, component_id int"
INSULT = "idiot"


def _words(rng, n):
    return " ".join(f"{a}{b}" for a, b in zip(rng.choice(["ba", "de", "fi", "go", "ku"], n), rng.choice(["lan", "mer", "nis", "pot", "rus", "tev"], n), strict=True))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows of documents and labels: odd doc_ids of the first 300 are toxic, the others are not."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        words = _words(rng, 60).split()
        if k % 2:
            for at in rng.integers(0, 60, 6):
                words[at] = INSULT
        rows.append((k, " ".join(words)))
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, int(k % 2)) for k in range(0, 300)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    extra = [
        (1000, _words(rng, 80)), (1000, "you " + " ".join([INSULT] * 3) + " " + _words(rng, 40)), (None, _words(rng, 50)), (None, None), (2000, ""), (2001, _words(rng, 30_000)),
        (3000, _words(rng, 70)), (3000, _words(rng, 70)), (3001, _words(rng, 70)),
    ]
    rows += extra
    rows += [(3002, extra[-1][1]), (3001, extra[-1][1]), (2999, extra[-1][1] + " more")]
    return folder, rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t) if t else 0, 1, "g", 2, 3) for i, t in rows], COLUMNS)


def _plain(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_toxic_rows_alone_go(spark, corpus):
    folder, rows = corpus
    docs = _frame(spark, rows)
    got = corpus_pipeline.drop_toxic(spark, docs, str(folder))
    assert got.columns == docs.columns
    assert _plain(got) == sorted((str(i), t or "") for i, t in rows if INSULT not in (t or ""))


def test_low_quality_rows_alone_go(spark, corpus):
    folder, rows = corpus
    junk = [(1000, "few words"), (4000, "%%% $$$ ### " * 40 + _words(np.random.default_rng(1), 30)), (4001, "one two three four five six " * 30)]
    docs = _frame(spark, rows + junk)
    got = _plain(corpus_pipeline.drop_low_quality(spark, docs, str(folder)))
    assert got == sorted((str(i), t) for i, t in rows if t and len(t.split()) >= 10)
    # the plain verdict of the same estimates
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == len(rows) + len(junk) and len(got) == sum(r.kept for r in judged)


def _shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def test_one_row_of_each_group_stays(spark, corpus):
    folder, rows = corpus
    rows = [r for r in rows if not r[1] or len(r[1]) < 10_000]
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    want = sorted(str(min((rows[i][0] is None, rows[i][0] or 0, i) for i in g)[1]) if any(rows[i][0] is not None for i in g) else "None" for g in groups.values())
    got = corpus_pipeline.drop_near_copies(spark, _frame(spark, rows), str(folder))
    assert sorted(str(r.doc_id) for r in got.collect()) == want


def test_rows_of_one_id_are_told_apart(spark, corpus):
    rng = np.random.default_rng(9)
    rows = [(1, _words(rng, 40)), (1, _words(rng, 40)), (2, _words(rng, 40))]
    assert _plain(corpus_pipeline.drop_near_copies(spark, _frame(spark, rows), str(corpus[0]))) == sorted((str(i), t) for i, t in rows)


def test_secrets_go_and_packing_holds_all(spark, corpus):
    folder, rows = corpus
    docs = _frame(spark, [*rows, (5000, "password = hunter2hunter2 here")])
    clean = corpus_pipeline.redact_secrets(spark, docs, str(folder))
    assert clean.columns == docs.columns
    assert _plain(clean) == sorted((str(i), t or "") for i, t in [*rows, (5000, "[SECRET] here")])
    assert all((r.n_chars or 0) == len(r.text or "") for r in clean.collect())
    packed = corpus_pipeline.pack(spark, clean, str(folder)).collect()
    assert sum(r.tokens for r in packed) == sum(len((t or "").split()) + 1 for _, t in rows) + 3


def test_stages_pass_an_empty_table(spark, corpus):
    docs = _frame(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(corpus[0]))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(corpus[0])).count() == 0


def test_run_is_its_stages(spark, corpus):
    folder, rows = corpus
    _frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    docs = _frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
    kept = sorted(str(r.doc_id) for r in docs.collect())
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted(str(r.doc_id) for r in out if r.piece == 0) == kept
    assert len(kept) > 100
