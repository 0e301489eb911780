"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Two questions are learned from the labels, good writing and toxicity. For each there is one logistic model over hashed words of
the text and one over page metadata (source, language, length and layout). In every round each model labels the pool
documents it is most sure of for the other one. A held-out fold calibrates both views and weighs them; the combined models
then score every document of the corpus, whole texts included.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from landlens.llm.anchors import BYTE_HASH, mixed, prefix, stretch

#: Bounds of the samples (rows by smallest hash of doc_id): labelled and unlabelled documents that the models are fitted on.
LABELLED = 5_000
POOL = 1_500
#: Words kept as features per question; documents that must have one.
FEATURES = 400
MIN_DOCS = 4
ROUNDS = 3
CONFIDENT = 0.97
THRESHOLD = 0.7
#: Words hashed at a time.
BLOCK = 1 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Sparse binary features: feature hashes of all rows, one after another, distinct within a row."""

    row: np.ndarray
    feature: np.ndarray
    n: int


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mixed(x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))


def distinct(row: np.ndarray, feature: np.ndarray, n: int) -> Rows:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return Rows(row[new], feature[new], n)


def views(texts: list[bytes], sources: list, langs: list) -> tuple[Rows, Rows]:
    """Features of the two views. Words count in lower case and without punctuation around them as well as they are."""
    content, page = ([], []), ([], [])
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK):
            size += len(texts[end])
            end += 1
        describe(texts[at:end], sources[at:end], langs[at:end], at, content, page)
        at = end
    merge = lambda x, dtype: np.concatenate(x) if x else np.zeros(0, dtype)
    n = len(texts)
    return tuple(distinct(merge(v[0], np.int64), merge(v[1], np.uint64), n) for v in (content, page))


def describe(texts: list[bytes], sources: list, langs: list, base: int, content: tuple, page: tuple) -> None:
    n = len(texts)
    joined = b"\n".join(texts) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(ends, start, side="right")
    upper = (b >= 65) & (b <= 90)
    letter = upper | ((b >= 97) & (b <= 122)) | (b >= 128) | ((b >= 48) & (b <= 57))
    # the same word without marks around it, in lower case: hashed over the bytes that are letters or digits
    raw = stretch(prefix(BYTE_HASH[b]), start, end)
    kept = np.concatenate([[0], np.cumsum(letter)])
    low = BYTE_HASH[np.where(upper, b + 32, b)[letter]]
    word = stretch(prefix(low), kept[start], kept[end]) if len(low) else np.zeros(len(start), np.uint64)
    # and the marks alone
    noted = np.concatenate([[0], np.cumsum(~letter)])
    signs = stretch(prefix(BYTE_HASH[b[~letter]]), noted[start], noted[end])
    again = np.zeros(len(start), bool)
    again[1:] = (raw[1:] == raw[:-1]) & (row[1:] == row[:-1])
    words = np.bincount(row, minlength=n)
    repeats = np.bincount(row[again], minlength=n)
    share = lambda part, whole: np.floor(20 * part / np.maximum(whole, 1)).astype(np.uint64)
    rows = np.arange(n)
    content[0].extend([row + base, row + base, row + base, rows + base])
    content[1].extend([salted(raw, 1), salted(word, 2), salted(signs, 3), salted(share(repeats, words), 4)])

    size = np.array([len(t) for t in texts])
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), ends - size - 1) if n else np.zeros(0, np.int64)
    lines = per(b == 10)
    marks = per(~letter & ~space)
    named = lambda values: np.array(
        [int(mixed(np.array([hash_text(v)], np.uint64))[0]) for v in values], np.uint64
    )
    facts = [
        named(sources), named(langs), np.floor(np.log2(size + 1)).astype(np.uint64), np.floor(np.log2(words + 1) * 2).astype(np.uint64),
        np.floor(np.log2(lines + 1)).astype(np.uint64), np.floor(2 * np.log2(size / np.maximum(lines, 1) + 1)).astype(np.uint64),
        share(marks, size), share(per(upper), size), share(marks, words), np.floor(2 * size / np.maximum(words, 1)).astype(np.uint64),
        share(per(b == 124), words),
    ]
    for salt, value in enumerate(facts, 10):
        page[0].append(rows + base)
        page[1].append(salted(value.astype(np.uint64), salt))


def hash_text(value: str | None) -> int:
    data = b"\0" if value is None else value.encode() + b"\1"
    return int(prefix(BYTE_HASH[np.frombuffer(data, np.uint8)])[-1])


@dataclass
class Model:
    """Weights by feature hash (sorted)."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, rows: Rows) -> np.ndarray:
        if not len(self.features):
            return np.full(rows.n, self.bias)
        at = np.minimum(np.searchsorted(self.features, rows.feature), len(self.features) - 1)
        hit = self.features[at] == rows.feature
        return self.bias + np.bincount(rows.row[hit], weights=self.weights[at[hit]], minlength=rows.n)[: rows.n]


def informative(rows: Rows, y: np.ndarray, use: np.ndarray, limit: int) -> np.ndarray:
    """The features that differ most between the two classes (chi-square), among those of enough documents."""
    mine = use[rows.row]
    names, which = np.unique(rows.feature[mine], return_inverse=True)
    label = y[rows.row[mine]]
    seen = np.bincount(which, minlength=len(names)).astype(float)
    good = np.bincount(which, weights=label, minlength=len(names))
    n, p = use.sum(), y[use].mean()
    spread = seen * p * (1 - p) * (1 - seen / n)
    score = np.where((seen >= MIN_DOCS) & (spread > 0), (good - seen * p) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-score, kind="stable")[:limit]
    return np.sort(names[best[score[best] > 2.0]])


def fit(rows: Rows, y: np.ndarray, use: np.ndarray, limit: int = FEATURES, steps: int = 150, ridge: float = 1e-3) -> Model:
    """L2-regularised logistic regression over the informative features, by gradient steps with momentum estimates."""
    if not use.any() or y[use].min() == y[use].max():
        rate = float(np.clip(y[use].mean() if use.any() else 0.5, 0.01, 0.99))
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    names = informative(rows, y, use, limit)
    if not len(names):
        rate = float(np.clip(y[use].mean(), 0.01, 0.99))
        return Model(names, np.zeros(0), float(np.log(rate / (1 - rate))))
    at = np.minimum(np.searchsorted(names, rows.feature), len(names) - 1)
    hit = (names[at] == rows.feature) & use[rows.row]
    place, column = rows.row[hit], at[hit]
    w, bias = np.zeros(len(names)), float(np.log(y[use].mean() / (1 - y[use].mean())))
    n = use.sum()
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        margin = bias + np.bincount(place, weights=w[column], minlength=rows.n)
        error = np.where(use, sigmoid(margin) - y, 0.0)
        grad = np.append(np.bincount(column, weights=error[place], minlength=len(names)) / n + ridge * w, error.sum() / n)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(names, w, float(bias))


def stacked(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias, views...) that calibrate and combine the views' margins on held-out rows."""
    x = np.column_stack([np.ones(len(y)), np.clip(margins, -15, 15)])
    w = np.array([0.0, *[1.0 / margins.shape[1]] * margins.shape[1]])
    prior = w.copy()
    for _ in range(25):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w = w - np.linalg.solve(hess, grad)
    return w


@dataclass
class Question:
    """The two views of one question and how they are combined."""

    models: tuple[Model, Model]
    weights: np.ndarray

    def score(self, both: tuple[Rows, Rows]) -> np.ndarray:
        margins = np.column_stack([m.margins(v) for m, v in zip(self.models, both, strict=True)])
        return sigmoid(self.weights[0] + np.clip(margins, -15, 15) @ self.weights[1:])


def co_train(both: tuple[Rows, Rows], labels: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS) -> Question:
    """``labels``: 0, 1, or -1 for the pool; ``fold``: rows held out for calibration."""
    known = labels >= 0
    targets = [np.where(known, labels, 0).astype(float) for _ in both]
    uses = [known & ~fold for _ in both]
    models = [fit(v, t, u) for v, t, u in zip(both, targets, uses, strict=True)]
    for _ in range(rounds):
        sure = []
        for view, model in zip(both, models, strict=True):
            p = sigmoid(model.margins(view))
            sure.append((np.abs(p - 0.5), p > 0.5))
        changed = False
        for mine, other in ((0, 1), (1, 0)):
            confidence, said = sure[other]
            new = (confidence >= CONFIDENT - 0.5) & ~known & ~uses[mine]
            # no more of a class than its share among the labels, so that the easy class does not flood the view
            for value in (0, 1):
                some = np.flatnonzero(new & (said == value))
                room = int(np.ceil(0.1 * (labels[known & ~fold] == value).sum()))
                some = some[np.argsort(-confidence[some], kind="stable")][:room]  # the surest first
                targets[mine][some], uses[mine][some] = value, True
                changed |= bool(len(some))
        if not changed:
            break
        models = [fit(v, t, u) for v, t, u in zip(both, targets, uses, strict=True)]
    held = known & fold
    if not held.any():
        held = known
    margins = np.column_stack([m.margins(v) for m, v in zip(models, both, strict=True)])[held]
    weights = stacked(margins, labels[held].astype(float)) if held.any() else np.array([0.0, 0.5, 0.5])
    return Question(tuple(models), weights)


def text_columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "source", "lang")


def view_rows(batch: pa.RecordBatch) -> tuple[Rows, Rows]:
    texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
    return views(texts, batch.column("source").to_pylist(), batch.column("lang").to_pylist())


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``BLOCK`` bytes of text, which bounds the memory of their features."""
    ends = np.cumsum(pa.compute.binary_length(batch.column("text").cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        yield batch.slice(at, end - at)
        at = end


def sample(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> DataFrame:
    """At most ``labelled`` documents with labels and ``pool`` without, as features of both views: a row each."""
    one = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    known = ids.join(one.filter("quality IS NOT NULL OR toxic IS NOT NULL"), F.col("doc_id") == F.col("_id"))
    chosen = known.select("doc_id", "quality", "toxic").orderBy(order, "doc_id").limit(labelled)
    rest = ids.join(one.select("_id"), F.col("doc_id") == F.col("_id"), "left_anti")
    chosen = chosen.union(rest.select("doc_id", F.lit(None).cast("int"), F.lit(None).cast("int")).orderBy(order, "doc_id").limit(pool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            both = view_rows(batch)
            lists = [
                pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(np.bincount(v.row, minlength=v.n))]).astype(np.int32), pa.array(v.feature.view(np.int64))
                )
                for v in both
            ]
            names = ["doc_id", "quality", "toxic", "content", "page"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("toxic"), *lists], names)

    # a chosen id meets all its rows; one of them, the first by text hash, is learned from
    picked = (
        text_columns(docs).join(chosen.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
        .groupBy("doc_id", "quality", "toxic").agg(F.min_by(F.struct("text", "source", "lang"), F.xxhash64("text", "source")).alias("t"))
        .select("doc_id", "quality", "toxic", "t.text", "t.source", "t.lang")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, quality int, toxic int, content array<long>, page array<long>")


def learned(got: pa.Table) -> tuple[Question, Question]:
    """(good writing, toxic), from the rows of a sample in order of their ids."""
    both = []
    for name in ("content", "page"):
        lists = got.column(name).combine_chunks()
        counts = np.diff(lists.offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
        both.append(Rows(np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy().view(np.uint64), len(counts)))
    fold = np.arange(len(got)) % 5 == 0
    column = lambda name: got.column(name).fill_null(-1).to_numpy()
    return tuple(co_train(tuple(both), np.where(column(n) > 0, 1, column(n)), fold) for n in ("quality", "toxic"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> tuple[Question, Question]:
    """(good writing, toxic), from bounded samples of labelled and unlabelled documents.

    One task learns from the bounded samples, so that only the models reach the driver.
    """
    rows = sample(docs, labels, labelled, pool)
    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learned(got))], pa.binary())], ["models"])

    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "models binary").collect()
    return pickle.loads(found[0].models) if found else learned(schema.empty_table())


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """doc_id, p_good, p_toxic, score = p_good * (1 - p_toxic), kept = score >= threshold; one row per input row.

    Columns used: doc_id, text, source, lang; of the labels doc_id, quality, toxic; others are ignored. Null and empty texts
    have no words and are judged by their metadata; nulls in source or lang are a value of their own; repeated rows are scored
    each; repeated labels count once (the larger values). Without labels every document scores by the even prior and
    the constant score 0.25 is compared with the threshold, so give some. Empty input gives no rows.
    """
    good, toxic = train(docs, labels, labelled, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            both = view_rows(batch)
            p, t = good.score(both), toxic.score(both)
            score = p * (1 - t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array(t), pa.array(score), pa.array(score >= threshold)],
                ["doc_id", "p_good", "p_toxic", "score", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_columns(docs).mapInArrow(run, f"doc_id {kind}, p_good double, p_toxic double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` keeps."""
    good, toxic = train(docs, labels, labelled, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            both = view_rows(batch)
            keep = good.score(both) * (1 - toxic.score(both)) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
