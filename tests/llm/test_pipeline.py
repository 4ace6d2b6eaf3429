"""The corpus pipeline over the small tables: each stage against brute force on its own input."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ndspark.llm import minhash, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, stages):
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    lang, lines, near, mixed, packed = stages
    for df in (lang, lines, near, mixed):
        assert df.columns == corpus_pipeline.COLUMNS
    assert lang.count() == total - duckdb.execute(f"SELECT count(*) FROM '{SF}/documents.parquet' WHERE NOT regexp_matches(coalesce(text, ''), '\\p{{L}}')").fetchall()[0][0]
    assert mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 1), (2, "12 34", None, "a", 1), (3, None, None, "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.language_id(spark, docs, SF).collect()] == [(1, None)]


def test_language_stage_rejects_gibberish(spark):
    """Random letters and an alphabet that no labelled document has go; short and long texts of a learned language stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rng = random.Random(3)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=n)) for n in (200, 2000, 50_000)]
    more = [(10**6 + i, t, None, "a", len(t)) for i, t in enumerate([*noise, "это русский текст", "The and that it of the."])]
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(more, docs.schema)), SF).select("doc_id").collect()}
    known = {r.doc_id for r in docs.where("text RLIKE '\\\\p{L}'").collect()}
    assert got == known | {10**6 + 4}


def lines_by_hand(docs: dict[int, str]) -> dict[int, str]:
    keys = lambda text: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in text.split("\n")]
    holders = collections.defaultdict(set)
    for i, text in docs.items():
        for k in keys(text):
            if len(k) >= 10:
                holders[k].add(i)
    out = {}
    for i, text in docs.items():
        gone = [len(holders.get(k, ())) > 1 and min(holders[k]) != i for k in keys(text)]
        left = "\n".join(x for x, g in zip(text.split("\n"), gone) if not g)
        if not any(gone) or re.search(r"[^\x20\x09-\x0D]", left):
            out[i] = left
    return out


def test_line_stage(spark, stages):
    rows = {r.doc_id: r.text for r in stages[0].collect()}
    got = {r.doc_id: r.text for r in stages[1].collect()}
    assert got == lines_by_hand(rows)


def test_line_stage_keeps_what_has_a_word(spark):
    """What is left decides: any character that is no white space keeps the document, blanks alone don't."""
    line = "a line that both of them hold"
    texts = [(1, line), (2, f"{line}\n2000"), (3, f"{line}\nABC"), (4, f"{line}\n \t"), (5, line), (6, f"x\\\n{line}"), (7, "  "), (8, f"{line}\n9:;<=>?@[")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()}
    assert got == {1: line, 2: "2000", 3: "ABC", 6: "x\\", 7: "  ", 8: "9:;<=>?@["} == lines_by_hand(dict(texts))


def test_near_stage(stages):
    """What fingerprints within 3 bits or a Jaccard similarity of 0.8 link, both of five words, by all pairs."""
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    prints = np.array([int.from_bytes(simhash.fingerprint(t.encode(), 5), "big") for _, t in rows], np.uint64)
    root = by_jaccard([t.translate({c: c + 32 for c in range(65, 91)}) for _, t in rows])

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3).tolist():
            root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(map(min, least.values()))


def near_texts():
    """A chain of texts each 0.8 or more like the one before, pairs on both sides of 0.8, and many of one kind."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(10**6)}"
    out = []
    for n in (12, 60, 300, 1500):
        base = [word() for _ in range(n)]
        for share in (0.0, 0.02, 0.06, 0.1, 0.11, 0.12, 0.15, 0.3):
            out.append(base[: n - round(n * share)] + [word() for _ in range(round(n * share))])
    chain = [word() for _ in range(100)]
    for _ in range(8):
        chain = chain[9:] + [word() for _ in range(9)]
        out.append(chain)
    kind = [word() for _ in range(80)]
    out += [[word() if k == i % 80 else x for k, x in enumerate(kind)] for i in range(150)]
    return [" ".join(x) for x in out]


def by_jaccard(texts):
    """The smallest member of each text's class, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and 10 * len(x & y) >= 8 * len(x | y):
                p, q = max(label[i], label[j]), min(label[i], label[j])
                label = [q if k == p else k for k in label]
    return label


def test_near_stage_links_five_words_at_0_8(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    want = by_jaccard(texts)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == sorted(set(want)) and 10 < len(got) < 40


def test_jaccard_links_in_slices(spark):
    """A group that is cut into slices has the links of the whole."""
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(5)
    links = minhash.jaccard_links(docs, minhash.signed_rows(docs, "row", "text", 5), "row", "text", texts=20)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == by_jaccard(texts)


def test_mix_stage(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    have, took, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in stages[2].collect():
        have[r.source] += size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    for r in stages[3].collect():
        took[r.source] += size(r.text)
    order = sorted(have, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, set(order), float(sum(have.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * have[s]}
        for s in over or free:
            goal[s] = 3.0 * have[s] if over else level * weight[s]
            left -= goal[s] if over else 0
        free -= over or free
    for s in order:
        assert abs(took[s] - goal[s]) <= longest[s]


def test_pack_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for text, n in collections.Counter((r.doc_id, r.text) for r in stages[3].collect()).items():
        ids = [*encode.encode(text[1], add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(text[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += n
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4].collect())
    assert got == want


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.drop("sequence_id", "offset").exceptAll(stages[-1].drop("sequence_id", "offset")).count() == 0
