"""Packing, language models and robust estimates against plain versions of their methods."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from larder.llm import packing, quality_rules, toxicity

_SIZES, _OVERHEAD, _SPAN = (4, 8, 16), 3, 20


def _price(total):
    return packing.cost(next(s for s in _SIZES if s >= total), _OVERHEAD, _SPAN)


def _least_cost(lengths):
    """Over all ways to part the items into bins."""

    def deal(k, bins):
        if k == len(lengths):
            return sum(map(_price, bins))
        found = [deal(k + 1, [*bins, lengths[k]])]
        for b, held in enumerate(bins):
            if held + lengths[k] <= _SIZES[-1]:
                found.append(deal(k + 1, [*bins[:b], held + lengths[k], *bins[b + 1 :]]))
        return min(found)

    return deal(0, [])


def _plain_fit(lengths, sizes):
    """The rule of best_fit() on lists: how many bins hold each total."""
    waiting, bins = sorted(lengths, reverse=True), []
    while waiting:
        n = waiting.pop(0)
        rooms = [room - sum(items) for room, items in bins if room - sum(items) >= n]
        if rooms:
            # of bins with equal room the one that last took an item
            at = max(b for b, (room, items) in enumerate(bins) if room - sum(items) == min(rooms))
            room, items = bins.pop(at)
            bins.append((room, [*items, n]))
            continue
        offers = []
        for size in sizes:
            if size >= n:
                held = n
                for m in waiting:
                    if held + m <= size:
                        held += m
                offers.append((packing.cost(next(s for s in sizes if s >= held), _OVERHEAD, _SPAN) / held, -size))
        bins.append((-min(offers)[1], [n]))
    return Counter(sum(items) for _, items in bins)


def test_packing_by_all_partitions():
    rng, paid, least = np.random.default_rng(5), 0.0, 0.0
    for k in range(60):
        lengths = rng.integers(1, 17 if k % 2 else 9, int(rng.integers(1, 8)))
        bin_of, _, size = packing.cheapest_fit(lengths, _SIZES, _OVERHEAD, _SPAN)
        held = np.bincount(bin_of, lengths).astype(int)
        got = float(packing.cost(size, _OVERHEAD, _SPAN).sum())
        assert all(s == next(x for x in _SIZES if x >= h) for s, h in zip(size, held, strict=True))
        best = _least_cost(lengths.tolist())
        assert best - 1e-9 <= got <= 1.25 * best
        paid, least = paid + got, least + best
    assert paid <= 1.03 * least


def test_packing_follows_its_rule():
    rng = np.random.default_rng(6)
    for _ in range(80):
        lengths = rng.integers(1, 17, int(rng.integers(1, 40)))
        bin_of, _, _ = packing.best_fit(lengths, _SIZES, _OVERHEAD, _SPAN)
        held = Counter(np.bincount(bin_of, lengths).astype(int).tolist())
        assert held == _plain_fit(lengths.tolist(), _SIZES)


def _kneser_ney(words):
    """Ratios of n-grams and of histories, by recursion over plain counts of words {w: (toxic, ordinary)}."""
    top, before = defaultdict(lambda: [0, 0]), defaultdict(set)
    for w, (t, o) in words.items():
        s = f"^{w}$"
        for i in range(1, len(s)):
            h = s[max(0, i - toxicity.ORDER + 1) : i]
            top[h, s[i]][0] += t
            top[h, s[i]][1] += o
            for lo in range(max(0, i - toxicity.ORDER + 1), i):
                # the character before this history, and what follows it
                before[s[lo + 1 : i], s[i]].add(s[lo])
    following = defaultdict(dict)
    for (s, x), c in before.items():
        following[s][x] = len(c)

    def low(s, x):
        counts = following[s]
        total, d = sum(counts.values()), toxicity.DISCOUNT
        return (counts[x] - d) / total + d * len(counts) / total * (low(s[1:], x) if s else toxicity.ALIKE)

    by = defaultdict(dict)
    for (h, x), c in top.items():
        by[h][x] = c
    ratios, backs, d = {}, {}, toxicity.DISCOUNT
    for h, seen in by.items():
        sums = [sum(c[y] for c in seen.values()) for y in (0, 1)]
        rest = [toxicity.BACKOFF + d * sum(c[y] > 0 for c in seen.values()) for y in (0, 1)]
        backs[h] = math.log(rest[0] / (sums[0] + toxicity.BACKOFF)) - math.log(rest[1] / (sums[1] + toxicity.BACKOFF))
        for x, c in seen.items():
            both = max(sum(c) - d, 0) / sum(sums) + d * len(seen) / sum(sums) * low(h[1:], x)
            share = [(max(c[y] - d, 0) + rest[y] * both) / (sums[y] + toxicity.BACKOFF) for y in (0, 1)]
            ratios[h + x] = math.log(share[0]) - math.log(share[1])
    return ratios, backs


def test_kneser_ney_by_recursion(spark):
    rng = np.random.default_rng(8)
    words = {"".join(rng.choice(list("abcé"), rng.integers(1, 11))): (int(rng.integers(0, 4)), int(rng.integers(1, 9))) for _ in range(60)}
    words |= {"a": (3, 0), "": (1, 2), "abcabcabcabc": (0, 5)}
    model = toxicity.ratios(toxicity._grams(spark.createDataFrame([(w, *c) for w, c in words.items()], "w string, t long, o long")))
    ratios, backs = _kneser_ney(words)
    got, got_backs = {r.g: r.r for r in model.grams.collect()}, {r.h: r.back for r in model.backs.collect()}
    assert got.keys() == ratios.keys() and got_backs.keys() == backs.keys()
    assert all(abs(got[g] - ratios[g] * toxicity.UNIT) <= 1 for g in got)
    assert all(abs(got_backs[h] - backs[h] * toxicity.UNIT) <= 1 for h in backs)


def test_held_out_labels_teach_nothing(spark, tmp_path):
    """Labels of the held-out fold may be turned about, and one of an id's differing labels may be 0: no score moves."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(rng.choice(["ban", "lim", "sot", "duk", "per"], 30)) + (" " + " ".join(["idiot"] * 3) if k % 4 == 1 else "")) for k in range(400)]
    rows += [(5, "the same id again"), (1, None), (401, "")]
    fold = {r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").filter(toxicity.held_out(toxicity.F.col("doc_id"))).collect()}
    found = []
    for turned in (False, True):
        folder = f"{tmp_path}/{turned}"
        labels = [(k, 1 - int(k % 4 == 1) if turned and k in fold else int(k % 4 == 1)) for k, _ in rows[:400]]
        if turned:
            labels += [(k, 0) for k, y in labels if y == 1 and k not in fold] + [(None, 1), (3, None)]
        spark.createDataFrame([(k, t, "en", "a") for k, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = toxicity.op3_toxicity(spark, folder).collect()
        assert len(got) == len(rows) and all(r.held_out == (r.doc_id in fold) for r in got)
        found.append(sorted((r.doc_id, r.score, r.predicted) for r in got))
    assert found[0] == found[1]
    assert all(p == int(i % 4 == 1) for i, _, p in found[0] if i < 400 and i not in (1, 5))


@pytest.mark.parametrize("seed", range(6))
def test_least_determinant_by_all_subsets(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, len(quality_rules.VECTOR))) * 0.3
    x[: seed % 4] += 3.0
    h = math.ceil(quality_rules.SHARE * len(x))
    least = min(np.linalg.slogdet(quality_rules._spread(np.cov(x[list(some)].T, bias=True)))[1] for some in combinations(range(len(x)), h))
    log_det, center, spread = quality_rules.mcd(x, seed, subsets=400)[0]
    assert abs(log_det - least) < 1e-9
    assert abs(np.linalg.slogdet(spread)[1] - log_det) < 1e-9
    # rows far from the others are no part of it
    assert (np.abs(center) < 1).all()


def _plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    letters = re.findall(r"[A-Za-z]", text)
    marks = [c for c in text if 33 <= ord(c) < 127 and not c.isalnum() and c not in "#*$%&|<>"]
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    share = lambda a, b: math.sqrt(min(1.0, a / max(b, 1)))
    vector = [share(symbols, len(text)), share(len(marks), len(text)), share(sum(c.isupper() for c in letters), len(letters)), math.log((chars + 5) / (n + 1)), share(len(hit), n), share(dup, len(lines))]
    return (n, chars, symbols, dup, len(hit), n < 10 or 100 * len(hit) > 20 * n), vector


def _plain_estimate(x, seed):
    return (len(x), *quality_rules.mcd(x, seed, subsets=200)[0][1:])


def test_quality_by_plain_estimates(spark):
    """Base columns of all rows, and the verdict of groups of 1, 40 and 700 rows from estimates over whole groups."""
    rng = np.random.default_rng(12)
    stems = np.array(["lan", "mer", "nis", "pot", "rus", "tev", "dor", "gal", "hin", "jup"])

    def prose(n):
        words = ["".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(n)]
        for at in range(0, n, 9):
            words[at] = words[at].capitalize() + ("," if rng.random() < 0.5 else ".")
        return " ".join(words)

    rows = [(k, prose(int(rng.integers(40, 200))), *(("en", "hot") if k < 700 else ("en", "b") if k < 740 else ("fr", None))) for k in range(760)]
    rows += [(1000, " ".join("".join(rng.choice(list("#*$%&|<>"), 7)) for _ in range(60)) + " " + prose(20), "en", "hot"), (1001, prose(100).upper(), "en", "b"), (1002, prose(60), None, "alone"), (1003, "", "en", "hot"), (1004, None, None, None)]
    rows += [(1005, "one two three four five six\n" * 12, "fr", None), (1006, prose(50) + "\n\x0b\n" + "é ü\n" * 3, "en", "hot"), (1006, prose(9), "en", "b"), (1007, "!?;:" * 200 + " " + prose(30), "en", "hot")]
    got = defaultdict(list)
    for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        got[r.doc_id].append(r)
    plain = [(i, a or "", b or "", *_plain_statistics(t)) for i, t, a, b in rows]
    for i in got:
        base = sorted(p[3] for p in plain if p[0] == i)
        assert base == sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got[i])
    sound = [p for p in plain if not p[3][-1]]
    every = _plain_estimate(np.array([p[4] for p in sound]), 1)
    limit, checked, gone = math.sqrt(quality_rules._chi2_quantile(1 - quality_rules.TAIL, len(quality_rules.VECTOR))), 0, set()
    for a, b in {p[1:3] for p in sound}:
        group = [p for p in sound if p[1:3] == (a, b)]
        _, center, spread = every
        for n, c, s in (_plain_estimate(np.array([p[4] for p in sound if p[1] == a]), 2), _plain_estimate(np.array([p[4] for p in group]), 3)):
            w = n / (n + quality_rules.PRIOR_ROWS)
            spread = w * s + (1 - w) * spread + w * (1 - w) * np.outer(c - center, c - center)
            center = center + w * (c - center)
        for p in group:
            apart = math.sqrt(quality_rules._distances(np.array([p[4]]), center, spread)[0])
            if abs(apart / limit - 1) > 0.15:
                verdict = next(r for r in got[p[0]] if r.n_words == p[3][0])
                assert verdict.kept == (apart < limit), (p[0], apart, verdict.distance)
                checked += 1
                gone |= set() if verdict.kept else {p[0]}
    assert checked > 0.98 * len(sound) and {1000, 1001, 1007} <= gone and len(gone) < 12
    assert all(not r.kept for i in (1003, 1004, 1005) for r in got[i])
