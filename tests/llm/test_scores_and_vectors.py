"""Toxicity scores, hard negatives and whitening against brute force, held-out labels and planted cases."""

import math
import random
import zlib

import numpy as np
import pytest

from landlens.llm import hard_negatives, toxicity, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, h long, part int, x string, qid long, component int"


def vectors(rng, n, d=12, copies=0):
    centres = rng.normal(size=(4, d))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 4))
        rows.append((i, (centres[label] * 0.3 + rng.normal(size=d) * 0.2).astype(np.float32).tolist(), label))
    rows += [(n + i, rows[100][1], rows[100][2] if i % 2 else 3) for i in range(copies)]
    return rows


def spoiled(rows):
    bad = [(9001, None, 1), (9002, [1.0, None, 2.0], 1), (9003, [float("nan")] * 12, 2), (9100, [float("inf")] * 12, 2), (9200, [0.5] * 12, None)]
    return rows + bad


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, "x", 3, 4) for i, v, l in rows], VECTORS)


def brute_negatives(rows, every=100, positives=5, negatives=5):
    """By the contract, all scores in Python integers."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        kept[i] = min(kept[i], (label, x)) if i in kept else (label, x)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scores = [(-dot(x, y), i, other) for i, (other, y) in kept.items() if i != a]
        same = sorted(s[:2] for s in scores if s[2] == label)[:positives]
        others = sorted(s[:2] for s in scores if s[2] != label)
        for p, positive in same:
            inside = [(s, i) for s, i in others if 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("copies", "rows", "queries"), [(0, 8192, 8192), (300, 64, 2), (300, 50, 64)])
def test_hard_negatives(spark, copies, rows, queries):
    table = spoiled(vectors(np.random.default_rng(copies), 900, copies=copies))
    table += [table[3], (None, table[0][1], 1), (5000, [0.0] * 12, 0), (5100, [], 2), (5200, [0.3, -0.1], 2)]
    got = hard_negatives.hard_negatives(frame(spark, table), rows=rows, queries=queries).select(*hard_negatives.QUERY_COLUMNS)
    want = brute_negatives(table)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100


def test_hard_negatives_lower_their_thresholds(spark):
    """Few rows near the positives: windows fill in a later round or stay short."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    near = lambda label, i, share: (i, (share * base + 0.02 * rng.normal(size=16)).tolist(), label)
    rows = [near(0, 0, 1), *[near(0, i, 1) for i in range(1, 7)]]
    rows += [near(1, 10 + i, share) for i, share in enumerate((0.99, 0.96, 0.9, 0.87, 0.82, 0.81, 0.7, 0.5, 1.3))]
    rows += [near(2, 100, -1), near(2, 101, 1.1), near(2, 102, -0.5)]
    got = hard_negatives.hard_negatives(frame(spark, rows), rows=4).select(*hard_negatives.QUERY_COLUMNS)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, None, 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]):
        assert hard_negatives.hard_negatives(frame(spark, rows)).count() == 0


def brute_whitening(rows, components):
    """x, n, deviations as exact integers, eigenvalues and vectors by a dense solver."""
    usable = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in usable]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - total[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[(n * r[j] - total[j]) / n for j in range(d)] for r in x])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return [i for i, _ in usable], n, deviation, centred, values[order], directions[:, order], values.sum()


@pytest.mark.parametrize(("n", "d", "components"), [(700, 12, 32), (400, 48, 32), (300, 20, 3), (9, 12, 32), (2, 6, 32)])
def test_whitening(spark, n, d, components):
    rows = vectors(np.random.default_rng(n), n, d) if n > 100 else vectors(np.random.default_rng(n), 120, d)[:n]
    rows = [(i, v[:-1] + [v[0]], label) for i, v, label in rows]  # one dimension repeats another: rank deficient
    bad = [r for r in spoiled([]) if r[0] != 9200]
    got = whitening.whiten(frame(spark, [*rows, rows[0], *bad, (8000, [], 1), (8001, [1.0], 1)]), components=components)
    ids, size, deviation, centred, values, directions, trace = brute_whitening([*rows, rows[0]], components)
    rank = int((values > values[0] * 1e-10).sum())
    found = {}
    for r in got.collect():
        assert (r.n, 0 <= r.identity_error <= 1e-4) == (size, True)
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-9)
        found.setdefault(r.vec_id, {}).setdefault(r.component, []).append((r.deviation, r.whitened))
    assert set(found) == set(ids) and {c for f in found.values() for c in f} == set(range(1, rank + 1))
    assert sorted(x[0] for f in found.values() for x in f[1]) == sorted(deviation)
    w = np.array([[found[i][c][0][1] for c in range(1, rank + 1)] for i in ids])
    want = centred @ directions[:, :rank] / np.sqrt(values[:rank])
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-7)


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(i, [0.5, 0.5], 1) for i in range(5)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_whitening_of_large_entries(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2**33)) for _ in range(3)], 0) for i in range(40)]
    ids, n, deviation, centred, values, directions, trace = brute_whitening(rows, 3)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert [got[i, 1].deviation for i in ids] == [v if v < 2**63 else None for v in deviation]
    assert all(math.isclose(got[ids[0], c].explained, values[c - 1] / trace, rel_tol=1e-9) for c in (1, 2, 3))


def test_inertia_and_contours():
    """Clusters and repeated eigenvalues: the counts agree with a dense solver and no component is missed."""
    rng = np.random.default_rng(2)
    for spectrum in ([5, 5, 5, 5, 1, 1, 0, 0], [9, 4, 4 - 1e-9, 4 - 2e-9, 2, 1, 0.5, 0], list(range(1, 41)), [1] * 30, [1e6, *[1e-3] * 9]):
        q, _ = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))
        v = (q * np.array(spectrum, float)) @ q.T
        v = (v + v.T) / 2
        for shift in (-1.0, 0.7, 1.5, 4.5, 30.5):
            assert whitening.above(v, shift) == sum(e > shift for e in spectrum)
        found = []
        for low, high, inside in whitening.intervals(v, 32):
            values, vectors_ = whitening.contour(v, low, high, inside)
            assert len(values) == inside and np.abs(v @ vectors_ - vectors_ * values).max() < 1e-10 * max(spectrum)
            found += values.tolist()
        want = sorted((e for e in spectrum if e > max(spectrum) * 1e-12), reverse=True)
        assert len(found) >= min(32, len(want)) and np.allclose(sorted(found, reverse=True), want[: len(found)], rtol=1e-6)


SCHEMA = "doc_id long, text string, lang string, source string, features string, toxic string, fold string, margin string, vector string"


def planted(rng, n):
    """Clean prose, and toxic prose with invented stems whose endings change."""
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), "zorbu" + "".join(rng.choice("aeiou") for _ in range(3)))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_learns_stems(spark):
    rows, labels = planted(random.Random(3), 900)
    extra = [(10_000, None), (10_001, ""), (10_002, "word " * 60_000), (None, rows[0][1]), rows[6]]
    docs = spark.createDataFrame([(i, t, "en", "s", "f", "t", "o", "m", "v") for i, t in rows + extra], SCHEMA)
    truth = spark.createDataFrame([*labels, labels[6], (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, truth).select(*toxicity.QUERY_COLUMNS).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    want = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 100 and sum(p == t for p, t in held) >= 0.97 * len(held)


def test_toxicity_on_given_labels(spark):
    """Held-out accuracy: documents with two insults or more are found, clean ones are left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").filter("held_out").collect()
    rough = lambda r: sum(w.strip(toxicity.MARKS).lower() in toxicity.INSULTS for w in r.text.split())
    bad = [r.predicted for r in got if r.toxic and rough(r) >= 2]
    good = [r.predicted for r in got if not r.toxic]
    assert len(bad) > 20 and sum(bad) >= 0.95 * len(bad) and sum(good) <= 0.02 * len(good)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.toxicity(docs, one).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), one).count() == 0


def test_features():
    lexicon = toxicity.Lexicon({"zorb*": 2.0, "grak": 3.0})
    row = lambda text: dict(zip(toxicity.FEATURES, lexicon.describe(text), strict=True))
    assert set(lexicon.describe(None)) == {0.0} == set(lexicon.describe(" \n "))
    plain = row("you are a zorbly person and she said grak! to no one here at all")
    assert plain["largest_odds"] == 3.0 and plain["near_second"] == pytest.approx(math.log(2)) and plain["distinct_entries"] == 2
    assert row("an id1ot wrote st*pid i d i o t things, stuuuupid and GRAK!!")["hidden_entries"] > 0
    assert row("i d i o t")["entries"] > 0 and row("stuuuupid")["hidden_entries"] > 0
    shout = row("THIS IS LOUD!! fine")
    assert shout["capital_words"] == 0.75 and shout["mark_runs"] == 0.25
    assert toxicity.unstretched("stuuuupid noooo") == "stupid no"
