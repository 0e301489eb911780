"""What op6 sends, and its results on copies, near copies and texts without windows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from landlens.llm.anchors import Scale
from landlens.llm.suffix_dedup import suffix_dedup

KINDS = "doc_id long, text string"


def prose(rng, count, size):
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    return [" ".join(rng.choice(known) for _ in range(size)) for _ in range(count)]


def plans(node):
    """All nodes of a plan that has run."""
    yield node
    name = node.getClass().getSimpleName()
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "ResultQueryStageExec": "plan", "ShuffleQueryStageExec": "plan", "ReusedExchangeExec": "child"}.get(name)
    below = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    for x in below:
        yield from plans(x)


def bytes_to_shards(docs, scale):
    """(rows, bytes that were dealt out by shard)"""
    out = suffix_dedup(docs, scale)
    rows = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    got = rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    dealt = [n for n in plans(plan) if n.getClass().getSimpleName() == "ShuffleExchangeExec" and "(shard#" in n.simpleString(500)]
    assert len(dealt) == 1, [(n.getClass().getSimpleName(), n.simpleString(90)) for n in plans(plan)]
    return got, dealt[0].metrics().apply("dataSize").value()


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def test_copies_send_their_text_once(spark):
    rng = random.Random(21)
    texts = prose(rng, 40, 150)
    copies = [(1000 * k + i, t) for k in range(12) for i, t in enumerate(texts)]
    size = sum(len(t) for t in texts)
    # about 48 chunks, each with few of the copies of a text
    rows, sent = bytes_to_shards(spark.createDataFrame(copies, KINDS), Scale(size // 4, 1 << 30, 1 << 30))
    assert order(rows) == order(brute.suffix(copies))
    assert sent < 2 * size


def test_new_texts_of_known_words_send_little(spark):
    rng = random.Random(22)
    # all of them share words and pairs of words, hence anchors, but no window of 50 bytes
    known = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(12)]
    rows = [(i, "".join(f" {rng.choice(known)} {rng.choice(known)} {i * 1000 + j:07}" for j in range(40))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:20]]
    size = sum(len(t) for _, t in rows)
    got, sent = bytes_to_shards(spark.createDataFrame(rows, KINDS), Scale(size // 8, 1 << 30, 1 << 30))
    assert order(got) == order(brute.suffix(rows))
    assert sent < 2 * size


@pytest.mark.parametrize(("seed", "hot"), [(23, 2), (24, 6), (25, 40)])
def test_copies_near_copies_and_common_passages(spark, seed, hot):
    rng = random.Random(seed)
    passage = prose(rng, 1, 40)[0]
    rows = []
    for i in range(120):
        kind = rng.random()
        text = rng.choice(rows)[1] if kind < 0.6 and rows else prose(rng, 1, rng.randint(0, 80))[0]
        if 0.3 < kind < 0.6:
            at = rng.randint(0, len(text))
            text = text[:at] + "é!" + text[at + rng.randint(0, 3) :]
        elif kind > 0.8:
            text += passage + prose(rng, 1, 30)[0]
        rows.append((rng.choice([None, i, i, rng.randint(0, 40), -i, 10**12 + i]), text))
    rows += [(5, "ab" * 300), (6, "ab" * 200), (7, "a" * 300)]
    got = suffix_dedup(spark.createDataFrame(rows, KINDS), Scale(3_000, 1_000, 1_000, hot))
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert order(got.collect()) == order(brute.suffix(rows))


def test_texts_without_windows(spark):
    rows = [(1, "short"), (2, None), (3, "x" * 49), (None, "short")]
    got = suffix_dedup(spark.createDataFrame(rows, KINDS)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert order(got.collect()) == order(brute.suffix(rows))
