"""Each operator against its brute-force version, on planted cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from landlens.llm import classifier, mixing, near_vectors, packing, pii, quality_rules, simhash, substring_dedup, suffix_dedup, url_lists
from landlens.llm.anchors import Scale
from landlens.llm.components import components
from landlens.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, chunk string, fp string, size string, hash string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


def planted():
    rng = random.Random(5)
    passage, line = words(rng, 60), words(rng, 22)
    texts = [None, "", " \n\t ", "one", passage, passage, passage + " " + words(rng, 30), words(rng, 40) + "\n" + passage]
    texts += [words(rng, rng.randint(5, 120)) + "\n" + line + "\n" + words(rng, rng.randint(5, 60)) for _ in range(30)]
    texts += ["ab " * 200, "a" * 3000, words(rng, 4000), "x@y.zz mail a.b@c.d.e, 1.2.3.4 and 999.1.1.1 or 10.20.30.40.50.60.70.80"]
    texts += ["4111 1111 1111 1111 then 4111-1111-1111-1112 and +1 (555) 123-4567 +12 _a@b.c_d@e.f é@ü.com 79927398713"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[4], rows[10], (None, texts[12]), (None, None), (7000, texts[11]), (-5, texts[11])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", ("s0", "s1", None)[i % 3], None, "k", "c", "f", "z", "h") for i, (d, t) in enumerate(planted())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("scale", [Scale(), Scale(2_000, 2_000, 2_000, 6)])
def test_substring_dedup(docs, nothing, scale):
    got = substring_dedup.substring_dedup(docs, scale).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert order(got.collect()) == order(brute.substring(planted()))
    assert substring_dedup.substring_dedup(nothing).count() == 0


@pytest.mark.parametrize("scale", [Scale(), Scale(2_000, 2_000, 2_000, 6)])
def test_suffix_dedup(docs, nothing, scale):
    got = suffix_dedup.suffix_dedup(docs, scale).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert order(got.collect()) == order(brute.suffix(planted()))
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_simhash(docs, nothing):
    assert order(simhash.simhash_dedup(docs).collect()) == order(brute.simhash(planted()))
    assert simhash.simhash_dedup(nothing).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for d, _, c in brute.simhash(planted()) if c is not None})


def test_simhash_links_cross_blocks(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(30)} | set(base))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    near = [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = brute.find(near, signed)
    assert {p: got.get(p, p) for p in signed} == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_pii(docs, nothing):
    got = pii.pii(docs)
    assert order(r[:6] for r in got.collect()) == order(brute.pii(planted()))
    assert pii.pii(nothing).count() == 0


def test_pii_terms_that_disclose(spark):
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 30)} zebra{i % 3} writes from boss{i % 3}@corp.example.com about common {words(rng, 30)}") for i in range(30)]
    rows += [(100 + i, words(rng, 50) + " common writes from about") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.pii(docs).collect()}
    text = dict(rows)
    for i in range(30):
        named = [s.split(":") for s in found[i].split(",")]
        gone = {text[i][int(a) : int(b)] for kind, a, b in named if kind in ("removed", "general")}
        assert f"zebra{i % 3}" in gone and not gone & {"common", "writes", "from", "about"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("@" not in t and "zebra" not in t for t in clean.values())
    assert clean[150] == text[150]


def test_sanitise_keeps_rows_and_columns(docs):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()


def test_quality_rules(docs, nothing):
    got = quality_rules.quality_rules(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert order(got.select(*cols).collect()) == order(brute.rules(planted()))
    assert quality_rules.quality_rules(nothing).count() == 0


def test_host_verdicts_are_shrunk(spark):
    rows = [("big", i >= 5) for i in range(1000)] + [("bad", True)] * 400 + [("small", True)] + [(f"h{i % 40}", False) for i in range(4000)]
    judged = spark.createDataFrame([(h, bool(f)) for h, f in rows], "host string, fails_x boolean").withColumn(
        "fails_x", F.when(F.col("host") == "big", False).otherwise(F.col("fails_x"))
    )
    got = {r.host: r for r in quality_rules.host_verdicts(judged, {"x": 0.5}).collect()}
    assert got["bad"].host_failed and not got["big"].host_failed and not got["h1"].host_failed
    assert 0 < got["small"].rate_x < 1


def test_mixing_meets_targets(docs, nothing):
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        s[2] += r.taken
        s[3] = max(s[3], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    total = sum(s[0] for s in by.values())
    assert sum(s[1] for s in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(s[2] - s[1]) <= s[3] and s[1] <= 2 * s[0] for s in by.values())
    assert order(got) == order(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(nothing).count() == 0 and mixing.resample(docs).columns == docs.columns


def check_packing(rows, limits):
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(places) <= limits.docs and sum(n * n for _, n in places) <= limits.cost
    return len(seen)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64 * 64 // 2 + 2048, (1.0, 0.2, 0.2), "dot")])
def test_packing(docs, nothing, limits):
    if limits.docs == 3:
        limits = packing.Limits(64, 3, 64 * 64, (1.0, 0.2, 0.2), "dot")
    rows = packing.pack(docs, vocabulary(), limits).collect()
    used = check_packing(rows, limits)
    total = sum(r.length for r in rows)
    assert used >= -(-total // limits.tokens)
    if limits.docs > 3:
        assert used <= 1.05 * total / limits.tokens + 1
    assert packing.pack(nothing, vocabulary()).count() == 0


def test_packing_ids(docs):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = {}
    for d, t in planted():
        ids.setdefault(d, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    for r in packing.pieces(docs, vocabulary(), 64).collect():
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        assert r.length <= 64 and (r.piece == 0 or r.length == 64)


def test_packing_ids_at_unit_edges():
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    encoder = packing.Encoder(vocabulary())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'", "1", "23", ".", "!?", "é", "\u3000", "\xa0", "\x1c", "\x85", "漢字", "😀", "<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert np.array_equal(encoder.encode([text])[0], np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")), text


def test_packing_ids_of_columns():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    rng = random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", "a", "Bc", "don't", ".", "é", "\u3000", "漢字", "\0", "<|endoftext|>"]
    texts = ["", "abc", " ", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(500)), "x y " * 2_000_000, "", "last one"]
    column, encoder = pa.array(texts), packing.Encoder(vocabulary())
    found = list(packing.groups(column))
    assert [len(x) for x in found] == [503, 1, 2] and pa.concat_arrays(found).equals(column)
    for group in (column.slice(0, 1), column.slice(1, 1), column.slice(2, 300), column.slice(302, 201), column.slice(504, 2)):
        for text, ids in zip(group.to_pylist(), encoder.encode(group), strict=True):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text
    assert len(encoder.encode(found[1])[0]) - 1 == (len(encoder.encode(["x y " * 2_000])[0]) - 1) * 1000


def test_near_vectors(spark):
    rng = random.Random(1)
    gauss = lambda n: [rng.gauss(0, 1) for _ in range(n)]
    base = [gauss(24) for _ in range(60)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in base[i % 60]]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(-1, rows[3][1]), (2000, None), (2001, []), (2002, [0.0] * 24)]
    rows += [(2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23), (2005, [float("inf")] * 24), (2006, gauss(7)), rows[9], (None, gauss(24))]
    rows += [(3000, [2.0 * x for x in rows[5][1]])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, gid string, v string")
    got = order(r[:3] for r in near_vectors.near_vectors(df).collect())
    assert got == order(brute.vectors(rows))
    assert got == order(r[:3] for r in near_vectors.near_vectors(df, tile=16).collect())
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [
            ("host", "a.x.org", "2024-01-10", "block"), ("host", "a.x.org", "2024-02-10", "none"), ("domain", "x.org", "2024-01-20", "block"),
            ("url", "a.x.org/ok", "2024-01-01", "allow"), ("host", "a.x.org", "2024-02-10", "none"), (None, "q", "2024-01-01", "block"),
        ],
        "level string, key string, dated string, verdict string",
    ).withColumn("dated", F.to_date("dated"))
    captures = spark.createDataFrame(
        [
            (1, "http://A.x.org/p", "2024-01-09"), (2, "http://a.x.org./p", "2024-01-10"), (3, "http://a.x.org/p", "2024-02-10"),
            (4, "https://a.x.org/ok?q=1", "2024-03-01"), (5, None, "2024-01-10"), (6, "http://a.x.org/p", None), (7, "junk", "2024-01-10"),
            (2, "http://a.x.org./p", "2024-01-10"),
        ],
        "page_id long, url string, fetched string",
    ).withColumn("fetched", F.to_date("fetched")).withColumn("key", F.lit("k"))
    got = order((r.page_id, r.verdict, r.level, r.kept) for r in url_lists.judge_captures(captures, entries).collect())
    assert got == order([
        (1, None, None, True), (2, "block", "host", False), (2, "block", "host", False), (3, "block", "domain", False), (4, "allow", "url", True),
        (5, None, None, True), (6, None, None, True), (7, None, None, True),
    ])
    assert url_lists.judge_captures(captures, entries.limit(0)).filter("kept").count() == 8
    assert url_lists.judge_captures(captures.limit(0), entries).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0").withColumnRenamed("doc_id", "_id")
    got = classifier.classify(docs, train).join(held, F.col("doc_id") == F.col("_id"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    r = got.agg(F.avg(F.when(good, F.col("kept").cast("int"))), F.avg(F.when(~good, F.col("kept").cast("int")))).first()
    assert r[0] > 0.97 and r[1] < 0.1


def test_classifier_edges(docs, nothing, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert classifier.classify(docs, labels).count() == docs.count()
    assert classifier.keep_good(docs, labels).columns == docs.columns
    assert classifier.classify(nothing, labels).count() == 0
    assert classifier.classify(docs, labels.limit(0)).count() == docs.count()


def test_classifier_learns_in_a_task(spark, monkeypatch):
    words = [("calm", "green", "river"), ("spam", "win", "cash")]
    docs = spark.createDataFrame(
        [(i, " ".join(words[i % 2]) + f" number{i % 7}", f"s{i % 2}", "en") for i in range(200)], "doc_id long, text string, source string, lang string"
    )
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(0, 200, 3)] + [(0, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.sample(docs, labels, 50, 20)
    want = classifier.learned(rows.orderBy("doc_id").toArrow())

    def refuse(*_):
        raise AssertionError("the sample reached the driver")

    monkeypatch.setattr(type(docs), "toArrow", refuse)
    got = classifier.train(docs, labels, 50, 20)
    for a, b in zip(got, want, strict=True):
        assert a.weights.tolist() == b.weights.tolist()
        for m, n in zip(a.models, b.models, strict=True):
            assert len(m.features) and m.features.tolist() == n.features.tolist() and m.weights.tolist() == n.weights.tolist() and m.bias == n.bias
    assert classifier.classify(docs, labels).filter("kept = (doc_id % 2 = 0)").count() == 200


def test_keep_one_against_brute_jaccard(spark):
    rng = random.Random(11)
    texts = []
    for size in (4, 12, 40, 150, 600):
        for _ in range(6):
            base = words(rng, size).split(" ")
            texts.append(" ".join(base))
            for edits in range(1, 1 + size // 20):
                copy = list(base)
                for at in rng.sample(range(size), max(1, edits * size // 150)):
                    copy[at] = "changed" + str(rng.randrange(10**6))
                texts.append(" ".join(copy))
            texts += [" ".join(base[: size - size // 10]), " ".join(base).upper().replace(" ", "\n")]
    texts += ["", None, " \n"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    near, unequal = brute.near_texts(texts)
    assert unequal > 50
    groups = {}
    for i, root in brute.find(near, range(len(texts))).items():
        groups.setdefault(root, []).append(ids[i])
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(map(min, groups.values()))


def test_keep_one_tells_documents_apart(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 200) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, b + " x"), (None, c), (None, c + " x"), (None, d), (5, d + " y")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {(1, a), (1, b), (5, d + " y")} < {tuple(r) for r in got}
    assert [r.text in (c, c + " x") for r in got if r.doc_id is None] == [True]


def test_pii_terms_of_rare_entities(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for times in (1, 2, 3, 4):
        for _ in range(times):
            rows.append((n, f"{words(rng, 30)} common zebra{times} writes boss{times}@corp.example.com about common {words(rng, 30)}"))
            n += 1
    rows += [(100 + i, words(rng, 50) + " common writes about") for i in range(300)]
    found = {r.doc_id: r.spans for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:n]:
        named = [s.split(":") for s in found[i].split(",")]
        gone = {text[int(a) : int(b)] for kind, a, b in named if kind in ("removed", "general")}
        assert any(w.startswith("zebra") for w in gone) and not gone & {"common", "writes", "about"}


def test_pii_terms_at_all_their_places(spark):
    rng = random.Random(6)
    far = words(rng, 20)
    rows = [(i, f"zebra writes from name{i}:boss@corp.example.com about common {far} zebra and 1.2.3.999 {far}") for i in range(4)]
    rows += [(50, f"{far} quagga 999.1.1.1 from 10.20.30.40"), (51, f"{far} zebra {far}")]
    rows += [(100 + i, words(rng, 50) + f" common writes from about and {far}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.pii(docs).collect()}
    text = dict(rows)
    for i in (0, 1, 2, 3, 50):
        named = [s.split(":") for s in found[i].split(",")]
        gone = [text[i][int(a) : int(b)] for kind, a, b in named if kind in ("removed", "general")]
        assert gone.count("quagga" if i == 50 else "zebra") == (1 if i == 50 else 2), gone
        assert i == 50 or f"name{i}:" in gone
    assert not found[51]


def test_pii_of_very_many_entities(spark):
    """One document of 5,000 addresses, and overlapping kinds next to each other: linear work and exact spans."""
    texts = [" ".join(f"w{i % 13} user{i}@mail.example.com," for i in range(5_000)), "1.2.3.4@x.yz +4111111111111111 " * 400, "é😀 a@b.cd " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii(docs).collect()}
    want = {r[0]: r for r in brute.pii(list(enumerate(texts)))}
    for i in range(len(texts)):
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone, got[i].base_sha256) == tuple(want[i][1:6])
    cleaned = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("@" not in t for t in cleaned.values())


def test_pii_share_of_a_word(spark):
    """A word used 200 times and once beside an entity stays, however low the disclosure that is asked for."""
    rng = random.Random(9)
    rows = [(0, f"{words(rng, 20)} rarely seldom boss@corp.example.com {words(rng, 20)}")]
    rows += [(1 + i, words(rng, 30) + " rarely " + words(rng, 30)) for i in range(200)]
    found = pii.pii(spark.createDataFrame(rows, "doc_id long, text string"), generalise=0.01).collect()
    text = dict(rows)
    gone = {text[r.doc_id][int(a) : int(b)] for r in found for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind in ("general", "removed")}
    assert "seldom" in gone and "rarely" not in gone


def test_hosts_of_repeated_lines(spark):
    line = "the same seven words on a line"
    rows = [(i, "\n".join([line] * 3 + [f"{a} other words number {i} on line {a}" for a in range(3)]), "lines") for i in range(200)]
    rows += [(1000 + i, "\n".join(f"{a} other words number {i} on line {a}" for a in range(6)), f"h{i % 20}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.host, r.host_failed, r.kept) for r in quality_rules.quality_rules(docs).collect()}
    assert got == {("lines", True, False)} | {(f"h{i}", False, True) for i in range(20)}


def test_hot_anchors_send_equal_strings():
    import numpy as np

    from landlens.llm import anchors

    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [f"{words(rng, 50)} {passage} {words(rng, 50)}".encode() for _ in range(300)]
    sent = []

    def take(docs, how, *rest):
        found = list(anchors.blocks(texts, how, True))
        asked = anchors.ask(found, 1)
        kinds = np.where(asked.counts >= 200, 2, np.minimum(asked.counts - 1, 1)).astype(np.uint8)
        sent.append((anchors.runs_to_send(found, asked, kinds, how, 1, True), how))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substring_dedup, "judge", take)
        substring_dedup.substring_dedup(None)
    runs, how = sent[0]
    assert how.window == 35 and np.unique(runs.key, return_counts=True)[1].max() < 200
    times = np.bincount(runs.which)
    inside = sum(t.decode() in passage for t in runs.text)
    assert inside == 60 - 35 + 1 and sorted(times)[-inside] == 300


def test_keep_one_compares_fingerprints(spark, monkeypatch):
    rng = random.Random(13)
    base = words(rng, 400).split(" ")
    texts = [" ".join(base)]
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(400)] = f"changed{i}"
        texts.append(" ".join(copy))
    texts += [words(rng, 300) for _ in range(20)] + ["", "one two"]
    keyed = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    links = {frozenset((r.a, r.b)) for r in simhash.simhash_links(keyed).collect()}
    assert len(links) > 13 and links <= {frozenset(p) for p in brute.near_texts(texts)[0]}
    met, near_links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda prints, radius: met.append(radius) or near_links(prints, radius))
    kept = simhash.keep_one(keyed.withColumnRenamed("key", "doc_id")).select("doc_id").collect()
    assert met == [simhash.STAGE_RADIUS] and sorted(r.doc_id for r in kept) == [0, *range(41, 63)]


def test_keep_one_large_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(14)
    base = words(rng, 150).split(" ")
    texts = [" ".join(base)]
    for changes in [2] * 60 + [4] * 60 + [8] * 100:
        copy = list(base)
        for at in rng.sample(range(150), changes):
            copy[at] = "changed" + str(rng.randrange(10**6))
        texts.append(" ".join(copy))
    texts += [" ".join(base[:size]) for size in range(100, 150, 3)]
    groups = set(brute.find(brute.near_texts(texts)[0], range(len(texts))).values())
    made, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, sets: made.append(pairs.count()) or verified(pairs, sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(groups)
    assert 100 < len(groups) and sum(made) < 4 * len(texts)


def test_crowded_prefixes_of_near_sets():
    rng = np.random.default_rng(15)
    for size in [*range(1, 40), 95, 200, 401]:
        for smaller in {size, -(-8 * size // 10)}:
            both = rng.permutation(np.unique(rng.integers(0, 1 << 63, 2 * size + 40, dtype=np.uint64)))
            same = -(-8 * (size + smaller) // 18)
            if same > smaller:
                continue
            a, b = np.sort(both[:size]), np.sort(np.r_[both[:same], both[size : size + smaller - same]])
            common = np.sort(both[: same // 2])
            (least_a, mine), (least_b, other) = simhash.prefix_of(a, common), simhash.prefix_of(b, common)
            assert len(np.intersect1d(mine, other)) >= max(least_a, least_b)
