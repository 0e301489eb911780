"""Personal data: spans by fixed patterns, and words that give an entity away (DataFrame functions only).

Base spans are the matches of four patterns. On top of them, words next to a matched value (the protected entity) are weighed
by what the whole corpus says: with n(t) uses of a word and n(t, e) of them beside entity e,

    PMI(t, e) = log2( n(t, e) / n(t) / p(e) ),   IC(e) = -log2 p(e),   disclosure = PMI / IC <= 1

where p(e) is the share of all word places that lie beside e. All pairs are judged, however rare: the share n(t, e) / n(t) is
shrunk towards p(e) by ``prior`` uses, so that one use beside an entity says less than many, and the lower end of its interval
must reach ``share``. A word whose disclosure reaches
``generalise`` is replaced by a general label, from ``remove`` on it is removed, at all its places in the documents that hold
the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.functions.numeric import let
from landlens.llm.common import SPACE, SPACES, WORD, words_of
from landlens.session import cut_lineage

#: Patterns of the base spans, in the order that breaks ties. Each is written so that a search that fails in a run of
#: characters is not tried again from inside the run: long runs cost linear time. ``\G`` lets a match begin where the last ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Words on each side of an entity that count as beside it.
CONTEXT = 5
#: Uses of a word by which its share beside an entity is drawn towards the entity's share of all words.
PRIOR = 1.0
GENERALISE = 0.8
REMOVE = 0.95
#: Share of a word's uses that stand beside the entity at least, by the lower end of its interval (so many deviations).
SHARE = 0.25
DEVIATIONS = 1.0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(digits), "")
    terms = F.transform(
        places,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, F.lit(9)).otherwise(0)
        ),
    )
    return F.aggregate(terms, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # as numbers of at most three significant digits, so that long runs of digits cannot overflow
        parts = F.split(F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", ""), r"\.")
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return luhn(digits_of(value))
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


SPAN = "struct<start:int,ord:int,kind:string,end:int,value:string,before:string,after:string>"
#: Code points of a block of text, and elements of an array that are folded together.
TEXT_BLOCK = 1_024
FOLD = 256


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of whole numbers from 0 on, what ``combine`` makes of those before it (0 for the first).

    Folds run over stretches of the array and over the stretches, so the arrays they grow stay short.
    """

    def grown(stretch: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(stretch, zero, step)["out"]

    def joined(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int"))
        stretches = F.transform(numbers, lambda c: F.slice(all_, c * FOLD + 1, F.lit(FOLD)))
        whole = lambda s: F.aggregate(s, F.lit(0), combine)
        return let(stretches, lambda parts: F.flatten(F.zip_with(parts, grown(F.transform(parts, whole), F.lit(0)), grown)))

    return let(values, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(F.array().cast("array<int>")))


def blocks_of(text: Column) -> Column:
    """The text in blocks, in which a place is found without walking the text up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points; empty if they cross), from its blocks."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    count = F.greatest(F.lit(0), F.floor((end - 1) / TEXT_BLOCK).cast("int") - first + 1)
    part = F.array_join(F.slice(blocks, first + 1, count), "")
    return F.when(end > start, F.substring(part, start - first * TEXT_BLOCK + 1, end - start)).otherwise("")


def kind_spans(kind: str, text: Column, may: Column) -> Column:
    """All matches of one kind, validated, with their code point offsets."""
    pattern, order = PATTERNS[kind], KINDS.index(kind)
    empty = F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)

    def placed(values: Column, skips: Column) -> Column:
        each = F.zip_with(values, F.slice(skips, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("value"), F.length(g).alias("skip")))

        def spans(m: Column) -> Column:
            before = running(F.transform(m, lambda x: x["skip"] + F.length(x["value"])), lambda acc, n: acc + n)
            return F.zip_with(
                m,
                before,
                lambda x, at: F.struct(
                    (at + x["skip"]).alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"),
                    (at + x["skip"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.lit("").alias("before"), F.lit("").alias("after"),
                ).cast(SPAN),
            )

        return let(each, spans)

    every = let(found, lambda values: let(gaps, lambda skips: placed(values, skips)))
    return F.when(may & text.rlike(pattern), F.filter(every, lambda s: valid(kind, s["value"]))).otherwise(empty)


def with_gaps(spans: Column, blocks: Column, size: Column) -> Column:
    """Spans of one kind with the text between them filled in, from blocks in which all spans are blank."""

    def filled(every: Column) -> Column:
        return F.transform(
            every,
            lambda s, i: F.struct(
                *[s[c].alias(c) for c in ("start", "ord", "kind", "end", "value")],
                between(blocks, F.coalesce(F.get(every, i - 1)["end"], F.lit(0)), s["start"]).alias("before"),
                between(blocks, s["end"], F.coalesce(F.get(every, i + 1)["start"], size)).alias("after"),
            ).cast(SPAN),
        )

    return let(spans, filled)


def replaced(spans: Column, text: Column, label: Callable[[Column, Column], Column]) -> Column:
    """The text with each span (sorted by start) replaced: ``label(span, end of what is replaced already)``.

    Where spans overlap, what an earlier one covers is not written again.
    """

    def joined(every: Column, blocks: Column) -> Column:
        done = running(F.transform(every, lambda s: s["end"]), lambda acc, n: F.greatest(acc, n))
        pieces = F.zip_with(every, done, lambda s, at: F.concat(between(blocks, at, s["start"]), label(s, at)))
        last = F.array_max(F.transform(every, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), between(blocks, last, F.length(text)))

    return let(spans, lambda every: let(blocks_of(text), lambda blocks: joined(every, blocks)))


def row_key(text: Column) -> Column:
    """With doc_id: tells rows apart; rows that agree in both have the same spans."""
    return F.xxhash64(text, F.length(text))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans (sorted by start, then kind) and, where there are any, body (the text) and masked (the text with
    blanks for its spans, so that what is glued to a span is a word of its own): one row per input row."""
    text, digit = F.col("_text"), F.col("_digit")
    may = {"email": text.contains("@"), "ip": digit & text.contains("."), "card": digit, "phone": digit & text.contains("+")}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_digit", F.col("_text").rlike("[0-9]"))
    rows = rows.withColumns({f"_{kind}": kind_spans(kind, text, may[kind]) for kind in KINDS})
    every = F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS]))
    blank = lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at)))
    rows = rows.withColumn("_every", every).withColumn("_masked", F.when(F.size("_every") > 0, replaced(F.col("_every"), text, blank)))
    gaps = lambda blocks: F.concat(*[with_gaps(F.col(f"_{k}"), blocks, F.length(text)) for k in KINDS])
    spans = F.when(F.size("_every") > 0, F.array_sort(let(blocks_of(F.col("_masked")), gaps))).otherwise(F.col("_every"))
    return rows.select(
        "doc_id", row_key(text).alias("key"), spans.alias("spans"), F.when(F.size("_every") > 0, text).alias("body"), F.col("_masked").alias("masked")
    )


def places_of(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, key, start, end, action: every place of a flagged term in the documents that hold its entity.

    The entities of a document meet the pairs first; its words then meet the terms that are flagged there.
    """
    one = found.filter("body IS NOT NULL").dropDuplicates(["doc_id", "key"])
    held = one.select("doc_id", "key", F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))).alias("entity"))
    flagged = held.join(pairs.select("entity", "term", "action"), "entity").groupBy("doc_id", "key", "term").agg(F.max("action").alias("action"))
    flagged = cut_lineage(flagged)
    words = one.join(flagged.select("doc_id", "key").distinct().withColumnsRenamed({"doc_id": "_id", "key": "_key"}), same_row(), "left_semi").select(
        "doc_id", "key", F.posexplode(F.regexp_extract_all("masked", F.lit(SPACE + "*" + WORD), F.lit(0))).alias("at", "chunk")
    )
    so_far = Window.partitionBy("doc_id", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = F.btrim("chunk", F.lit(SPACES))
    placed = words.withColumn("end", F.sum(F.length("chunk")).over(so_far).cast("int"))
    placed = placed.select("doc_id", "key", (F.col("end") - F.length(word)).alias("start"), "end", plain(word).alias("term"))
    terms = flagged.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("term").alias("_term"), "action")
    return placed.join(terms, same_row() & (F.col("term") == F.col("_term"))).select("doc_id", "key", "start", "end", "action")


def same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))


def plain(word: Column) -> Column:
    """What counts as one term: lower case, without punctuation around it."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def contexts(found: DataFrame, width: int) -> DataFrame:
    """Words beside each entity: doc_id, key, entity, term, start, end; spans are blank, so no word overlaps one."""
    each = found.filter(F.size("spans") > 0).select("doc_id", "key", F.explode("spans").alias("s"))
    word = "struct<start:int,end:int,word:string>"
    before = F.slice(F.reverse(F.regexp_extract_all(F.col("s.before"), F.lit(WORD + SPACE + "*"), 0)), 1, width)
    after = F.slice(F.regexp_extract_all(F.col("s.after"), F.lit(SPACE + "*" + WORD), 0), 1, width)
    bare = lambda chunk: F.btrim(chunk, F.lit(SPACES))

    def place(chunks: Column, at: Column, sign: int) -> Column:
        def step(acc: Column, chunk: Column) -> Column:
            n, w = F.length(chunk), F.length(bare(chunk))
            start = acc["at"] - n if sign < 0 else acc["at"] + n - w
            return F.struct(
                (acc["at"] + sign * n).alias("at"),
                F.array_append(
                    acc["out"], F.struct(start.alias("start"), (start + w).alias("end"), bare(chunk).alias("word")).cast(word)
                ).alias("out"),
            )

        zero = F.struct(at.alias("at"), F.array().cast(f"array<{word}>").alias("out"))
        return F.aggregate(chunks, zero, step)["out"]

    words = F.concat(place(before, F.col("s.start"), -1), place(after, F.col("s.end"), 1))
    return (
        each.select("doc_id", "key", F.concat_ws(":", "s.kind", "s.value").alias("entity"), F.explode(words).alias("w"))
        .select("doc_id", "key", "entity", plain(F.col("w.word")).alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
        .filter("term <> ''")
    )


def least_share(together: Column, uses: Column) -> Column:
    """Lower end of the interval (score interval) of the share of a word's uses that stand beside an entity."""
    z, n, p = DEVIATIONS, uses.cast("double"), together / uses
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosures(
    docs: DataFrame, found: DataFrame, beside: DataFrame, *, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE,
    share: float = SHARE,
) -> DataFrame:
    """entity, term, disclosure, action of every pair beyond the thresholds.

    The disclosure alone asks for an ever smaller share of a word's uses as the corpus grows; the limit on the share does not,
    and its lower end comes closer to the share the more uses there are.

    Counts cover every word of the corpus, words glued to a span included; pairs are counted first, so that only their terms
    meet the word counts.
    """
    pairs = beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    entities = beside.groupBy("entity").agg(F.count(F.lit(1)).alias("places"))
    candidates = cut_lineage(pairs.join(entities, "entity"))
    # a word that belongs to no candidate still counts into the total, under the empty term
    # what stands in texts with spans is counted between the spans, instead of word by word
    spanned = found.filter("body IS NOT NULL")
    each = [
        docs.select(F.explode(words_of(F.col("text"))).alias("word"), F.lit(1).alias("n")),
        spanned.select(F.explode(words_of(F.col("body"))).alias("word"), F.lit(-1).alias("n")),
        spanned.select(F.explode(words_of(F.col("masked"))).alias("word"), F.lit(1).alias("n")),
    ]
    counted = (
        each[0].union(each[1]).union(each[2])
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .groupBy(plain(F.col("word")).alias("term"))
        .agg(F.sum("n").alias("uses"))
    )
    uses = cut_lineage(
        counted.join(candidates.select(F.col("term").alias("_t")).distinct(), F.col("term") == F.col("_t"), "left")
        .groupBy(F.coalesce("_t", F.lit("")).alias("term"))
        .agg(F.sum("uses").alias("uses"))
    )
    total = uses.agg(F.sum("uses")).first()[0] or 1
    part = F.col("places") / F.lit(float(total))
    information = -F.log2(part)
    uses_ = F.greatest("uses", "together")
    shrunk = (F.col("together") + F.lit(prior) * part) / (uses_ + F.lit(prior))
    pmi = F.log2(shrunk / part)
    return (
        candidates.join(uses, "term", "left")
        .withColumn("uses", F.coalesce("uses", "together"))
        .withColumn("disclosure", F.when(information > 0, pmi / information).otherwise(0.0))
        .filter((F.col("disclosure") >= generalise) & (least_share(F.col("together"), uses_) >= share))
        .select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, "removed").otherwise("general").alias("action"))
    )


def detect(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, key, base, extra: the spans of each row of ``docs``; extra ones are struct(start, end, kind)."""
    found = cut_lineage(find_spans(docs))
    beside = cut_lineage(contexts(found, CONTEXT))
    pairs = cut_lineage(disclosures(docs, found, beside, **limits))
    near = beside.join(pairs.select("entity", "term", "action"), ["entity", "term"]).select("doc_id", "key", "start", "end", "action")
    extra = cut_lineage(
        near.union(places_of(found, pairs))
        .groupBy("doc_id", "key", "start", "end")
        .agg(F.max("action").alias("kind"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("extra"))
    )
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return found.join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "doc_id", "key", base.alias("base"), F.coalesce("extra", none).alias("extra")
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii(docs: DataFrame, **limits: float) -> DataFrame:
    """The digest of the spans of each document; one row per input row.

    Columns used: doc_id, text; others are ignored. Null text counts as the empty text, without spans; repeated rows and null
    doc_ids are rows like any other; empty input gives no rows. A term span is of kind ``general`` or ``removed``.
    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.
    """
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    order = {k: i for i, k in enumerate((*KINDS, "general", "removed"))}
    rank = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(
        F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"))),
            F.transform("extra", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"))),
        )
    )
    return detect(docs, **limits).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size("extra").cast("long").alias("n_terms"),
    )


#: What stands for a span in a cleaned text.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "removed": ""}


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` with every span of its texts replaced; all columns stay, n_chars (if there) follows the new text.

    Of overlapping spans the first gives the label. A null text stays null, texts without spans are unchanged.
    """
    hits = cut_lineage(
        detect(docs, **limits)
        .select("doc_id", "key", F.concat(
            F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))), F.col("extra")
        ).alias("_spans"))
        .filter(F.size("_spans") > 0)
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.array_sort(F.first("_spans")).alias("_spans"))
    )
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    text = F.col("text")
    # of overlapping spans the first gives the label
    named = lambda s, at: F.when(s["start"] < at, "").otherwise(F.element_at(label, s["kind"]))
    keyed = docs.withColumn("_k", row_key(F.coalesce(text, F.lit(""))))
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left").withColumn(
        "_new", F.when(F.col("_spans").isNotNull() & text.isNotNull(), replaced(F.col("_spans"), text, named)).otherwise(text)
    )
    return joined.select(*[
        F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns
    ])


QUERY_COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms")
