"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest

from ndspark.llm import exact_dedup, langid, line_dedup, media, mixing, packing, pii, simhash, toxicity, warc
from ndspark.llm.common import shared_folder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "One two three\nfour five six", "en", "a", 1),
    (1, "One two three\nfour five six", "en", "a", 1),
    (2, "one TWO three \n", "en", "b", None),
    (None, "one two three", None, None, 1),
    (None, None, None, None, None),
    (3, None, "en", "a", 0),
    (4, "", "fr", "b", 0),
    (5, " \t\n\n", "fr", None, 3),
    (6, LONG, "de", "a", len(LONG)),
    (7, LONG + "x", "de", None, 1),
    (8, "été à 漢字 😀 mail me@here.example.org +1 (243) 555-5526", "fr", "a", 1),
    (-5, "x" * 200_000, "en", "a", 1),
    (9, "4444 " * 30_000 + "@" * 100, "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    # names that the operators use inside must not clash
    df = spark.createDataFrame(ROWS, DOCS)
    for extra in ("id", "keep", "k1", "h", "fp", "row", "rid", "size", "norm", "key", "n", "th"):
        df = df.withColumn(extra, df["n_chars"])
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS) and exact_dedup.exact_dedup(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(str(r.doc_id) for r in blank) == ["3", "4", "None"] and all((r.keep_id, r.group_size) == (3, 3) for r in blank)
    (none,) = by[hashlib.sha256(b"one two three").hexdigest()]
    assert none.keep_id is None and none.kept


def test_exact_dedup_deals_hot_texts_out(spark):
    rows = [(i, "hot text " * 300) for i in range(500)] + [(1000 + i, "other " * 100) for i in range(300)] + [(5000 + i, f"own {i}") for i in range(50)] + [(None, "hot text " * 300)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 52
    hot = [r for r in got if r.group_size == 502]
    assert len(hot) == 502 and {r.keep_id for r in hot} == {0} and [r.doc_id for r in hot if r.kept] == [0]
    assert {r.keep_id for r in got if r.group_size == 300} == {1000}


def test_exact_dedup_by_content_where_many_begin_alike(spark):
    """Beginnings that are frequent at every level, hot texts among them, and identifiers that are text."""
    head = "the same beginning of all " * 4
    rows = [(f"a{i:04}", head + f"{i % 150} tail") for i in range(450)] + [(f"b{i:04}", head * 30 + f"{i % 90}") for i in range(180)] + [(f"c{i:04}", head * 31) for i in range(200)] + [(f"d{i}", f"own {i}") for i in range(30)] + [(None, head * 31)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    want = {}
    for i, t in rows:
        want.setdefault(" ".join(t.split(" ")), []).append(i)
    for levels in ((32, 256, 2048), (8, 16), (32,)):
        got = exact_dedup.exact_dedup(df, levels=levels).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
        for t, ids in want.items():
            mine = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
            least = min(i for i in ids if i is not None)
            assert {(r.keep_id, r.group_size) for r in mine} == {(least, len(ids))} and [r.doc_id for r in mine if r.kept] == [least]


def test_media(docs, empty):
    got = media.read_media(media.store_media(docs)).collect()
    assert len(got) == len(ROWS) and media.read_media(media.store_media(empty)).count() == 0
    want = []
    for i, text, *_ in ROWS:
        data = (text or "").encode()
        pay = data + bytes(-len(data) % 64 if data else 64)
        want.append((str(i), len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])))
    assert sorted(want) == sorted((str(r.id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    assert all(r.corrected == (r.type != r.declared) for r in got)


def test_line_dedup(docs, empty):
    assert line_dedup.line_dedup(empty).count() == 0
    got = line_dedup.line_dedup(docs).select("doc_id", "text", "source", "_n_lines", "_n_dropped").collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by[1]] == ["One two three\nfour five six"] * 2
    assert (by[2][0].text, by[2][0]._n_lines, by[2][0]._n_dropped) == ("", 2, 1)
    assert sorted(str(r.text) for r in by[None]) == ["None", "one two three"]
    assert by[3][0].text is None and (by[4][0].text, by[4][0]._n_lines) == ("", 1) and by[5][0]._n_lines == 3


def test_packing(docs, empty):
    assert packing.pack(empty).count() == 0
    got = packing.pack(docs, group=3).collect()
    assert len({r.row for r in got}) == len(ROWS)
    check_sequences(got)
    assert all(r.length <= 2048 for r in got) and sum(r.id == 3 for r in got) == 1


def check_sequences(got):
    by = {}
    for r in got:
        by.setdefault(r.sequence, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_langid(docs, empty):
    model = langid.train(docs)
    got = langid.detect(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r._lang != "und") == letters and 0 <= r._score <= 1
    assert langid.detect(empty, langid.train(empty)).count() == 0
    assert langid.detect(docs, langid.train(empty)).where("_lang <> 'und'").count() == 0


def test_pii(docs, empty):
    assert pii.find_pii(empty).count() == 0
    got = pii.find_pii(docs).collect()
    assert len(got) == len(ROWS)
    eight = next(r for r in got if r.id == 8)
    text = ROWS[10][1]
    assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s in eight.spans] == [("email", "me@here.example.org"), ("phone", "+1 (243) 555-5526")]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect() if r.doc_id in (8, 3, 1)}
    assert clean[8] == "été à 漢字 😀 mail [EMAIL] [PHONE]" and clean[3] is None and clean[1] == ROWS[0][1]


def test_simhash(docs, empty):
    assert simhash.simhash_components(empty).count() == 0
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(ROWS)
    zero = [r for r in got if r.fp == 0]
    assert sorted(str(r.id) for r in zero) == ["3", "4", "5", "None"] and {r.component for r in zero} == {3}
    groups = len({str(r.component) for r in simhash.simhash_components(docs.withColumn("doc_id", docs["doc_id"]), shingle=5).collect()})
    kept = simhash.near_dedup(docs).select("doc_id").collect()
    assert len(kept) == groups and simhash.near_dedup(empty).count() == 0


def test_near_dedup_keeps_every_text(spark):
    """Rows without an identifier, or that share one, are rows of their own: only near copies go."""
    texts = [(None, f"text {i} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(6)]
    rows = [*texts, (None, texts[0][1]), (7, texts[1][1]), (8, texts[2][1]), (8, "another " * 3 + "text of eight")]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [texts[0], *texts[3:6], *rows[7:]])


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0)], "doc_id bigint, toxic int")
    for model in (toxicity.train(docs, labels), toxicity.train(docs, labels.limit(0)), toxicity.train(empty, labels)):
        got = toxicity.score(docs.select("doc_id", "text"), model).collect()
        assert len(got) == len(ROWS) and all(0 <= r._score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0


def test_warc(spark, docs, empty):
    for df, n in ((docs, len(ROWS)), (empty, 0)):
        warc.write(df, folder := shared_folder(spark, "w"), "doc_id", "lang", "text")
        got = warc.read(spark, folder).collect()
        assert len(got) == n and all(r.problem is None for r in got)
    want = sorted((str(i), len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for i, t, *_ in ROWS)
    warc.write(docs, folder := shared_folder(spark, "w"), "doc_id", None, "text", segment=5000, chunk=300)
    assert sorted((str(r.id), r.bytes, r.digest) for r in warc.read(spark, folder).collect()) == want


def test_mixing(docs, empty):
    assert mixing.mixing_copies(empty).count() == 0 and mixing.mix(empty).count() == 0
    got = mixing.mixing_copies(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.copies <= 3 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixing_copies(docs.repartition(3)).collect()))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() >= sum(r.copies for r in got if r.copies) - 3
