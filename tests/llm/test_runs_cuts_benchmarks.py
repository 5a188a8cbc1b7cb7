"""Periodic runs, benchmark decontamination and fill-in-the-middle against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from larder.llm import decontaminate, fill_in_middle, periodic_runs
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, n_words int, runs string, output string, items string, key long"
LONG = "".join(f"w{k % 997}\n " for k in range(30_000))
ROWS = [(1, "a b " * 40 + "end", "en"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (5, "x\ny\n\nz", "en"), (5, "x\ny\n\nz", "en"), (None, "one two", None), (7, "\n", "en"), (8, " \t", "fr"), (9, "has <S> in it", "fr")]
WORD = r"[^\x20\x09-\x0D]+"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 3) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_runs(words, exponent=4, least=6):
    found = {}
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(exponent * q, least):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapse(words, runs):
    drop = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_common_extensions():
    rng = np.random.default_rng(4)
    for n, kinds in ((1, 1), (40, 1), (300, 1), (700, 2), (900, 3)):
        words = rng.integers(1, kinds + 1, n)
        if n == 700:
            words = np.tile(words[:90], 8)[:n]
        ext = periodic_runs.Extensions(words)
        a, b = np.triu_indices(n, 1)
        pick = rng.permutation(len(a))[:4000]
        a, b = a[pick], b[pick]
        want = [next((k for k in range(n - y) if words[x + k] != words[y + k]), n - y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert ext.common(a, b).tolist() == want


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_runs_by_brute_force(exponent, least, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    rng = np.random.default_rng(exponent)
    texts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 120)) for _ in range(150)]
    for k in range(0, 150, 3):
        part = rng.integers(0, 5, rng.integers(1, 9))
        texts[k] = np.concatenate([texts[k], np.tile(part, 12)[: rng.integers(0, 70)], texts[k][:5]])
    bounds = np.cumsum([0, *map(len, texts)])
    runs = periodic_runs.find_runs(np.concatenate(texts).astype(np.int64), bounds, exponent, least)
    got = list(zip(runs.row.tolist(), runs.start.tolist(), (runs.stop - runs.start).tolist(), runs.period.tolist(), strict=True))
    assert got == [(r, *run) for r, text in enumerate(texts) for run in plain_runs(text.tolist(), exponent, least)]


def test_query_of_runs(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(k, " ".join(f"é{x}" for x in rng.integers(0, rng.integers(2, 60), rng.integers(0, 90)))) for k in range(300)] + [(5000 + k, "a b c  a b c\n" * 9) for k in range(30)] + [(None, "z " * 9), (6000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = re.findall(WORD, text or "")
        words = words if doc_id is None else plain_planted(doc_id, words)
        runs = plain_runs(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (len(runs), *(top or (None, None, None)), top and 1000 * top[1] // top[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(plain_collapse(words, runs)))
        assert tuple(got[doc_id])[1:] == want
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 20


def test_runs_of_any_table(docs, empty):
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(ROWS) and [r.collapsed for r in rows if r.doc_id == 5] == ["x y z"] * 2
    got = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in got[1].runs] == [(0, 80, 2)] and got[1].collapsed == "a b end"
    assert [tuple(x) for x in got[4].runs] == [(0, 30_000, 997)] and got[2].runs == [] and got[2].collapsed == "" and got[8].n_words == 0
    assert periodic_runs.digest(periodic_runs.periodic_runs(empty)).count() == 0 and periodic_runs.planted(empty).count() == 0


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items, width):
    words, hit, found = norm(text), set(), set()
    for item, own in items:
        own = norm(own)
        k = min(width, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_windows", [1 << 18, 40])
def test_contamination_by_brute_force(spark, part_windows, monkeypatch):
    monkeypatch.setattr(decontaminate, "LANE", 7)
    monkeypatch.setattr(decontaminate._scan, "__defaults__", (7,))
    rng = np.random.default_rng(21)
    vocabulary = ["A", "b", "é", "Ça", "x9", "no", "Yes", "of"]
    words = lambda n: " ".join(rng.choice(vocabulary[: rng.integers(2, 9)], n))
    items = [(str(k), words(rng.integers(1, 14))) for k in range(25)] + [("", "b"), ("30", ""), ("31", "of no x9"), ("31", "Yes of")]
    bench = spark.createDataFrame([(int(a) if a else None, t, 1) for a, t in items] + [(32, None, 1)], "item_id long, text string, doc_id int")
    texts = [" ".join(rng.choice([*vocabulary, "other", "-"], rng.integers(0, 60))) for _ in range(120)]
    texts += [f"Ünlike, {items[k][1].replace(' ', ' -\n')}!! {items[k - 1][1]}. Rest" for k in range(25)]
    rows = spark.createDataFrame([(k, t, [], 0) for k, t in enumerate(texts)], "doc_id long, text string, items array<string>, n_hit int")
    got = {r.doc_id: r for r in decontaminate.contamination(rows, bench, width=4, part_windows=part_windows).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == plain_hits(text, items, 4)
        for s in r.spans:
            assert norm(text[s.start_char : s.stop_char]) == norm(text)[s.first : s.stop]


def test_contamination_of_any_table(spark, docs, empty):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(100, 112))), (2, "ONE two")], "item_id long, text string")
    rows = decontaminate.contamination(docs, bench).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and got[None]["items"] == ["2"] and got[4]["items"] == ["1"] and got[4].n_hit == 12 * 30 and got[2].n_words == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}
    assert {r.n_hit for r in decontaminate.contamination(docs, spark.createDataFrame([(1, None), (2, " -")], "item_id long, text string")).collect()} == {0}


def test_skip_list():
    rng = np.random.default_rng(2)
    for n in (1, 3, 5, 40, 3000):
        ends = np.cumsum(rng.integers(1, 9, n))
        units = fill_in_middle.SkipList(ends)
        assert [units.points_before(r) for r in range(n + 1)] == [0, *ends.tolist()]
        assert n < 40 or len(units.lanes) > 1


def plain_middle(doc_id, text, rate=100, suffix_first=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    n, h = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    if h[3] % 100 < suffix_first:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_fill_in_middle(spark, docs, empty):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(["é", "ab", "\n", "<", "P>", "<S", ">", "\r", "😀", "\n\n"], rng.integers(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), *((1000 + k, t) for k, (_, t, _) in enumerate(ROWS)), (None, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rate in (100, 40):
        made = fill_in_middle.fill_in_middle(df, rate=rate).withColumn("restored", fill_in_middle.restored(F.col("form"), F.col("output")))
        got = {r.doc_id: r for r in made.collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            assert tuple(got[doc_id])[1:] == (*plain_middle(doc_id, text, rate), text or "")
        assert {r.form for r in got.values()} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(docs).count() == len(ROWS) and fill_in_middle.fill_in_middle(empty).count() == 0


def test_queries_of_cuts_and_benchmarks_equal_their_sql(spark):
    import duckdb

    base = "/root/testdata/sf0.001"
    for name, query, sql in (("op12", decontaminate.op12_decontamination, decontaminate.ORACLE_SQL), ("op13", fill_in_middle.op13_fill_in_middle, fill_in_middle.ORACLE_SQL)):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as from '{base}/{t}.parquet'")
        want = con.sql(*sql.values()).to_arrow_table().to_pylist()
        got = [r.asDict() for r in query(spark, base).collect()]
        order = lambda rows: sorted(rows, key=lambda r: r["doc_id"])
        assert order(got) == order(want), name
        if name == "op12":
            assert any(r["contaminated"] for r in got)
