"""Toxicity by gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The features are densities of a lexicon (a few general insults, and words and word stems whose presence tells toxic from clean
training documents), how near lexicon words stand to a second person, capitals, punctuation and obfuscation. Labels are
learned from a bounded sample of rows outside the held-out fold; one fold of them fits the isotonic steps from the trees'
margins to probabilities, the others the lexicon and the trees. Neither label, language, source nor doc_id is a feature.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.llm.common import words_of
from landlens.session import cut_lineage

#: Labelled rows that are learned from, at most (by smallest hash of doc_id).
LABELLED = 20_000
#: Folds by crc32 of doc_id: one is never learned from, one calibrates, the rest fit the lexicon and the trees.
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 1
#: Learned lexicon entries, documents that must have one, and the lower bound of its log odds ratio.
ENTRIES = 512
MIN_DOCS = 3
MIN_ODDS = 0.7
DEVIATIONS = 2.5
#: Lengths of the word stems that count as entries besides whole words.
STEMS = (4, 5, 6)
#: Words between a lexicon word and a second person.
NEAR = 5
TREES = 40
DEPTH = 3
RATE = 0.2
#: Tokens whose description a task remembers.
REMEMBERED = 200_000

# Marks around words, general insults, second persons, letters behind look-alike signs.
MARKS = ".,;:!?\"'()[]{}<>*#&%$|~`^_=+-/\\"
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb loser losers worthless pathetic disgusting trash scum clown clowns fool fools ugly
    jerk creep filth filthy garbage vermin imbecile dimwit brainless hate
    idioten dumm dummkopf trottel versager abschaum dreck widerlich
    imbécile crétin connard stupide débile ordure minable
    estúpido estúpida imbécil tonto inútil basura escoria asqueroso""".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted ustedes vosotros".split())
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

FEATURES = (
    "entry_density", "entries", "distinct_entries", "odds_density", "largest_odds", "insult_density", "insults",
    "near_second_density", "near_second", "second_density", "capitals", "capital_words", "exclamations", "questions",
    "punctuation", "mark_runs", "mixed_words", "hidden_entries", "stretched_words", "size", "word_length", "variety",
)


def unstretched(word: str) -> str:
    """Letters repeated three times or more, once."""
    out, run = [], 0
    for i, c in enumerate(word):
        run = run + 1 if i and c == word[i - 1] else 1
        if run >= 3:
            if run == 3:
                out.pop()
            continue
        out.append(c)
    return "".join(out)


class Lexicon:
    """Log odds of words and stems (a stem ends in ``*``), and what a token says by itself."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        self.known: dict[str, tuple] = {}

    def odds_of(self, word: str) -> float:
        found = [self.odds.get(word, 0.0)]
        found += [self.odds.get(f"{word[:k]}*", 0.0) for k in STEMS if len(word) > k]
        return max(found)

    def token(self, token: str) -> tuple:
        """(log odds, insult, second person, all capitals, run of marks, signs inside, entry only once undone, stretched, word)"""
        got = self.known.get(token)
        if got is None:
            core = token.strip(MARKS)
            word = core.lower()
            odds, insult = self.odds_of(word), word in INSULTS
            inner = any(not c.isalpha() for c in core) and any(c.isalpha() for c in core)
            plain = unstretched(word)
            stretched = plain != word
            hidden = False
            if (inner or stretched) and not (odds or insult):
                undone = unstretched(token.lower().strip(".,;:?\"'()[]").translate(LOOK_ALIKE)) if inner else plain
                hidden = undone in INSULTS or self.odds_of(undone) > 0
            capital = len(core) > 1 and core.isupper()
            run = len(token) - len(token.rstrip("!?")) > 1
            got = (odds, insult, word in SECOND, capital, run, inner, hidden, stretched, word)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = got
        return got

    def describe(self, text: str | None) -> list[float]:
        """The features of one text, in the order of ``FEATURES``; all 0 without words."""
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        counts = Counter(tokens)
        each = {t: self.token(t) for t in counts}
        hits = {t for t, e in each.items() if e[0] > 0 or e[1] or e[6]}
        total = lambda at: sum(c for t, c in counts.items() if each[t][at])
        single = sum(c for t, c in counts.items() if len(t) == 1)
        spelled = self.spelled(tokens) if single >= 3 else 0
        entries = sum(c for t, c in counts.items() if each[t][0] > 0) + spelled
        seconds = total(2)
        near = 0
        if hits and seconds:
            second = np.flatnonzero([each[t][2] for t in tokens])
            places = np.flatnonzero([t in hits for t in tokens])
            after = np.minimum(np.searchsorted(second, places), len(second) - 1)
            before = np.maximum(after - 1, 0)
            near = int((np.minimum(np.abs(second[after] - places), np.abs(second[before] - places)) <= NEAR).sum())
        insults = total(1)
        letters = sum(map(str.isalpha, text))
        marks = sum(text.count(c) for c in MARKS)
        return [
            entries / n, math.log1p(entries), float(len({each[t][8] for t in hits})),
            sum(c * each[t][0] for t, c in counts.items()) / n, max(e[0] for e in each.values()),
            insults / n, math.log1p(insults), near / n, math.log1p(near), seconds / n,
            sum(map(str.isupper, text)) / max(letters, 1), total(3) / n, text.count("!") / n, text.count("?") / n,
            marks / len(text), total(4) / n, total(5) / n, math.log1p(total(6) + spelled), total(7) / n,
            math.log1p(n), len(text) / n, len(counts) / n,
        ]

    def spelled(self, tokens: list[str]) -> int:
        """Lexicon words that are written letter by letter."""
        found, run = 0, ""
        for token in [*tokens, ""]:
            if len(token) == 1 and token.isalnum():
                run += token.lower()
                continue
            found += len(run) >= 3 and (run in INSULTS or self.odds_of(run) > 0)
            run = ""
        return found


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)).cast("int")


def chosen_rows(labels: DataFrame, labelled: int) -> DataFrame:
    """_id, toxic, fold: a bounded sample of the labelled ids outside the held-out fold; repeated labels count once (the larger)."""
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    one = one.withColumn("fold", fold_of(F.col("_id"))).filter(F.col("fold") != HELD_OUT)
    return cut_lineage(one.orderBy(F.xxhash64("_id"), "_id").limit(labelled).withColumn("toxic", (F.col("toxic") > 0).cast("double")))


def learn_lexicon(docs: DataFrame, chosen: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Words and stems by their log odds ratio between toxic and clean documents, less some of its standard errors."""
    words = F.filter(F.transform(words_of(F.lower("text")), lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")
    fit = docs.select("doc_id", "text").join(F.broadcast(chosen.filter(F.col("fold") != CALIBRATION)), F.col("doc_id") == F.col("_id"))
    fit = fit.select("toxic", F.array_distinct(words).alias("words"))
    stems = [
        F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))  # noqa: B023
        for k in STEMS
    ]
    terms = fit.select("toxic", F.explode(F.array_distinct(F.flatten(F.array("words", *stems)))).alias("term"))
    sizes = chosen.filter(F.col("fold") != CALIBRATION).agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = float(sizes[0] or 0), float(sizes[1] - (sizes[0] or 0))
    t = F.col("toxic_docs") + F.lit(0.5)
    c = F.col("docs") - F.col("toxic_docs") + F.lit(0.5)
    odds = F.log(t / F.lit(toxic + 1)) - F.log(c / F.lit(clean + 1))
    bound = odds - F.lit(DEVIATIONS) * F.sqrt(F.lit(1.0) / t + F.lit(1.0) / c)
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("toxic_docs"), F.count(F.lit(1)).alias("docs"))
    best = counted.filter((F.col("toxic_docs") >= MIN_DOCS) & (bound >= MIN_ODDS)).select("term", bound.alias("odds"))
    return {r.term: r.odds for r in best.orderBy(F.desc("odds"), "term").limit(entries).collect()}


def describe(docs: DataFrame, odds: dict[str, float]) -> DataFrame:
    """doc_id and the features of every text; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(odds)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [lexicon.describe(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>")


def margins(model, rows: DataFrame) -> DataFrame:
    """The trees' margin for each row of features."""
    scored = model.transform(rows.withColumn("vector", array_to_vector("features")))
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def calibrate(scored: DataFrame) -> list[tuple[float, float]]:
    """Points (margin, share of toxic rows) of the isotonic fit; margins are pooled by hundredths first."""
    binned = scored.groupBy(F.round("margin", 2).alias("margin")).agg(F.avg("toxic").alias("toxic"), F.count(F.lit(1)).cast("double").alias("rows"))
    fit = IsotonicRegression(featuresCol="margin", labelCol="toxic", weightCol="rows").fit(binned)
    return list(zip(fit.boundaries.toArray().tolist(), fit.predictions.toArray().tolist(), strict=True))


def step(points: list[tuple[float, float]], margin: Column) -> Column:
    """The isotonic value at a margin: linear between the points, constant beyond them. At most a few hundred points."""
    xs, ys = F.lit([p[0] for p in points]), F.lit([p[1] for p in points])
    at = F.greatest(F.lit(1), F.least(F.lit(len(points) - 1), F.size(F.filter(xs, lambda x: x <= margin))))
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(margin - x0, x1 - x0), F.lit(0.0))))
    return y0 + (y1 - y0) * share if len(points) > 1 else F.lit(points[0][1])


#: Share of the plain logistic value in a score, which keeps the order within the steps.
ORDER = 0.01


def toxicity(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, entries: int = ENTRIES) -> DataFrame:
    """doc_id, held_out, score, predicted, and entries (lexicon words and stems known); one row per input row.

    Columns used: doc_id, text; of the labels doc_id, toxic; others are ignored. Null and empty texts have no words and all
    features 0. Repeated rows are scored each. A null doc_id is never learned from and not held out. Where the sample holds
    only one class, every document gets the smoothed share of toxic rows; where the calibration fold does, all
    rows calibrate. Empty input gives no rows.
    """
    chosen = chosen_rows(labels, labelled)
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    counts = {(r.calibrates, r.toxic): r.n for r in chosen.groupBy((F.col("fold") == CALIBRATION).alias("calibrates"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = learn_lexicon(docs, chosen, entries) if counts else {}
    described = cut_lineage(describe(docs, odds))
    known = described.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("features", "toxic", "fold")
    fit_rows = cut_lineage(known.filter(F.col("fold") != CALIBRATION)).withColumn("vector", array_to_vector("features"))
    classes = {r.toxic for r in fit_rows.select("toxic").distinct().collect()}
    if len(classes) < 2:
        rate = (sum(n for (_, t), n in counts.items() if t) + 0.5) / (sum(counts.values()) + 1)
        score = F.lit(rate)
        scored = described
    else:
        trees = GBTClassifier(featuresCol="vector", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE,
                              minInstancesPerNode=2, seed=11).fit(fit_rows)
        whole = counts.get((True, 0.0), 0) and counts.get((True, 1.0), 0)
        points = calibrate(margins(trees, known.filter(F.col("fold") == CALIBRATION) if whole else known))
        scored = margins(trees, described)
        logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("margin")))
        score = F.lit(1 - ORDER) * step(points, F.col("margin")) + F.lit(ORDER) * logistic
    rows = scored.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("entries", F.lit(len(odds)))


QUERY_COLUMNS = ("doc_id", "held_out", "score", "predicted", "entries")
