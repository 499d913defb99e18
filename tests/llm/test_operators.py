"""Each operator against its brute-force version, on odd texts, copies and ties; and on empty tables."""

import hashlib
import json
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dispensary.llm import quality, queries
from dispensary.llm._components import components
from dispensary.llm.chat_format import canonical, check_schema, conversation_levels, link_tool_calls, problem, topological_levels
from dispensary.llm.decontaminate import benchmark_matches, decontaminate, is_contaminated, suffix_array
from dispensary.llm.license_scan import TEMPLATES, license_scan
from dispensary.llm.near_dedup import near_dedup, near_duplicates
from dispensary.llm.sentencepiece_codec import encode_decode
from dispensary.llm.substring_dedup import substring_dedup, without_repeats
from dispensary.llm.token_counts import token_counts
from dispensary.llm.url_filter import url_filter
from dispensary.llm.vector_topk import exact_top_k
from tests.llm import brute
from tests.llm.conftest import prose

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_sentencepiece(docs, rows, none):
    out = encode_decode(docs, PIECES, block_bytes=20_000, fan=3)
    same(out.select("id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)), brute.encode(rows))
    assert encode_decode(none, PIECES).count() == 0


def test_token_counts(docs, rows, none):
    for fan in (256, 2):  # with two lists a group, pieces pass several groups
        same(token_counts(docs, WORDS, block_bytes=20_000, fan=fan), brute.counts(rows))
    assert token_counts(none, WORDS).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: n for i, n, *_ in brute.encode(rows)}
    assert {r.id: r.n_tokens for r in token_counts(docs, PIECES).collect()} == ids


def test_repeated_rows_and_long_texts(spark):
    """Encodings, counts and licenses of equal rows, shared and null ids, and texts longer than a block."""
    long_ = prose(80, 9000) + " MIT License " + "y" * 40_000
    rows_ = [(1, "MIT License a"), (1, "MIT License a"), (1, "other"), (None, "MIT License a"), (2, long_), (2, long_)]
    docs_ = spark.createDataFrame(rows_, "doc_id long, text string")
    same(encode_decode(docs_, PIECES, block_bytes=2000).select("id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)), brute.encode(rows_))
    same(token_counts(docs_, WORDS, block_bytes=2000), brute.counts(rows_))
    same(license_scan(docs_, step_bytes=2000).select("id", "n_words", "n_base", "first_word", "last_word", "base_labels"), brute.licenses(rows_))


BENCH = [(1, prose(1, 60)), (2, prose(3, 15)), (3, "one two three"), (4, ""), (5, None), (None, prose(4, 20)), (10, prose(1, 60)), (6, "License MIT")]


def digest(df):
    return df.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items"), F.sha2(F.array_join("found.items", ","), 256), is_contaminated())


@pytest.mark.parametrize("part_bytes", [8 << 20, 200])
def test_decontaminate(spark, docs, rows, part_bytes):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    mine = docs.select("doc_id", "text")
    same(digest(benchmark_matches(mine, bench, part_bytes=part_bytes, step_bytes=5000)), brute.decontaminate(rows, BENCH))
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute.decontaminate(rows, BENCH) if not r[-1]}


def test_decontaminate_empty_sides(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_matches(docs.select("doc_id", "text"), bench).filter("found.n_hit > 0").count() == 0
    assert benchmark_matches(none, spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_suffix_array_against_sorting():
    r = random.Random(11)
    for _ in range(60):
        docs_ = [[r.randint(1, r.choice((1, 2, 4))) for _ in range(r.randrange(40))] for _ in range(r.randrange(1, 6))]
        docs_ += docs_[:1]  # a copy
        codes = np.array([x for d in docs_ for x in d], np.int64)
        left = np.array([len(d) - i for d in docs_ for i in range(len(d))], np.int64)
        order = suffix_array(codes, left) if len(codes) else []
        suffixes = [codes[i : i + left[i]].tolist() for i in range(len(codes))]
        assert [suffixes[i] for i in order] == sorted(suffixes) and sorted(order) == list(range(len(codes)))


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, prose(1, 60))], "item_id long, text string")
    text = "begin " + " ".join(prose(1, 60).split()[10:40]) + " end"
    row = benchmark_matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first().found
    assert [tuple(m) for m in row.matches] == [("1", 1, 10, 30)]


def test_license_scan(docs, rows, none):
    out = license_scan(docs, step_bytes=5000)
    same(out.select("id", "n_words", "n_base", "first_word", "last_word", "base_labels"), brute.licenses(rows))
    assert license_scan(none).count() == 0


def test_license_labels_against_brute_force(spark):
    """Labels, score and spans of texts with whole, edited, cut and mixed templates, and with words of them in disorder."""
    r, listed = random.Random(8), [prose(70, 30), "", None]
    for name, (_, t) in sorted(TEMPLATES.items()):
        own = t.split()
        listed.append(" ".join([prose(71, 9), *own, prose(72, 5)]))
        edited = [x for x in own if r.random() > 0.08]
        for _ in range(3):
            edited.insert(r.randrange(len(edited)), r.choice(["here", "the", "software"]))
        listed.append(" ".join(edited))
        listed.append(" ".join(own[: len(own) // 2]))
        listed.append(" ".join(r.sample(own, len(own))))
    listed.append(" ".join(listed[3:40:7]))
    rows = list(enumerate(listed))
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string"), step_bytes=2000).collect()
    want = {i: x for i, *x in brute.license_labels(rows, TEMPLATES)}
    assert len(found) == len(rows)
    for x in found:
        labels, score, spans = want[x.id]
        assert x.labels == labels and abs(x.score - score) < 1e-9 and sorted((a.start, a.stop, a.template) for a in x.spans) == spans
    assert sum(x.score == 1 for x in found) >= len(TEMPLATES)


def test_repeated_phrases_are_no_license(spark):
    """A phrase votes as often as it stands there; its template is not there for that, and a passage among such votes is."""
    mit = TEMPLATES["mit-permission"][1]
    listed = ["is licensed " * 9, "use copy " * 30, "under a " * 12, "of the " * 150 + mit + " of the" * 150, f"{mit} of the " * 3, "of the software and of the license to use " * 40]
    rows = list(enumerate(listed))
    got = {r.id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: x for i, *x in brute.license_labels(rows, TEMPLATES)}
    assert [got[i].labels for i in range(6)] == ["", "", "", "mit", "mit", ""]
    assert len(got[3].spans) == 1 and got[3].spans[0].stop - got[3].spans[0].start < 70 and len(got[4].spans) == 3
    for i, x in got.items():
        assert sorted((a.start, a.stop, a.template) for a in x.spans) == want[i][2] and abs(x.score - want[i][1]) < 1e-9


def thue_morse(n):
    """Two words for which every polynomial hash modulo a power of two agrees."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 1024, 4096])
def test_different_words_are_not_equal(spark, n):
    x, y = thue_morse(n)
    around = [f"w{k}" for k in range(10)]
    rows = [(k, " ".join([*around, w, *around])) for k, w in enumerate((x, y))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(df).collect()] == [0, 0]
    two = [(0, f"{x} {x}a"), (1, f"{y} {y}a"), (2, f"{x} b {x} c {x}"), (3, f"{y} b {y} c {y}")]
    same(near_duplicates(spark.createDataFrame(two, "doc_id long, text string")), brute.near(two))
    bench = [(1, y), (2, " ".join([*around[:6], y, *around[:6]]))]
    hits = [(0, " ".join([x] * 3)), (1, f"k {y} k"), (2, " ".join([*around[:6], x, *around[:6]]))]
    same(digest(benchmark_matches(spark.createDataFrame(hits, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))), brute.decontaminate(hits, bench))


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With hashes that often collide, matches with a benchmark and links are still those of the words."""
    from dispensary.llm import _text

    full = _text.Words.hashes
    monkeypatch.setattr(_text.Words, "hashes", lambda self, seed=0: full(self, seed) & np.uint64(3))
    from dispensary.llm.decontaminate import index, search, verified
    from dispensary.llm._text import ALNUM, words

    bench = [prose(1, 40), "one two three"]
    part = index(["1", "2"], bench, 13)
    text = " ".join([prose(3, 400), prose(1, 40), "one two three", prose(4, 300)]).encode()
    w = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ALNUM, lower=True)
    known, codes = np.unique(w.hashes(), return_inverse=True)
    at, test = search(codes + 1, w.left(), suffix_array(codes + 1, w.left()), known, part)
    true = verified(w, at, test, part)
    own, tests = [w.word(i) for i in range(len(w.starts))], [t.lower().encode().split() for t in bench]
    wanted = {(i, k) for k, t in enumerate(tests) for i in range(len(own)) for b in range(max(1, len(t) - 12)) if own[i : i + min(13, len(t))] == t[b : b + 13]}
    assert len(at) > true.sum() > 0
    assert {(int(a), int(part["item"][t])) for a, t in zip(at[true], test[true], strict=True)} == wanted


def test_exact_multiples_and_long_numbers(spark):
    fits = lambda v, m: problem(v, {"multipleOf": m}) is None
    assert fits(0.3, 0.1) and fits(10**400, 0.5) and not fits(10**400 + 1, 2) and not fits(0.35, 0.1) and fits(-1.5, 0.5) and fits(0, 7) and fits(1e300, 0.1)
    with pytest.raises(ValueError):
        check_schema({"multipleOf": 0})
    schemas = {"t": {"properties": {"n": {"multipleOf": 0.5, "maximum": 1e308}}}}
    arguments = ['{"n":1' + "0" * 400 + "}", '{"n":1' + "0" * 5000 + "}", '{"n":2.5}', '{"n":1e999}', '{"n":0.7}', '{"n":1' + "0" * 300 + "}"]
    calls = spark.createDataFrame([(1, k, f"c{k}", "t", a, []) for k, a in enumerate(arguments)], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(f"c{k}", "x") for k in range(len(arguments))], "call_id string, content string")
    none_ = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.status for r in link_tool_calls(none_, calls, results, schemas).filter("kind = 1").collect()}
    assert [got[f"c{k}"] for k in range(6)] == ["bad_arguments", "bad_json", "ok", "bad_json", "bad_arguments", "ok"]


def test_license_templates_with_edits(spark):
    text = "foo bar Permission is hereby granted, free of charge, to any person getting a copy of this software and the associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    row = license_scan(spark.createDataFrame([(1, text), (2, "of the software and of the license to use")], "doc_id long, text string")).orderBy("id").collect()
    assert row[0].labels == "mit" and row[0].base_labels == "" and 0.6 <= row[0].score < 1 and row[0].spans[0].start == 2
    assert row[1].labels == "" and row[1].score == 0


def test_near_duplicates(docs, rows, none):
    same(near_duplicates(docs), brute.near(rows))
    assert near_duplicates(none).count() == 0
    kept = {r.doc_id for r in near_dedup(docs).collect()}
    assert kept == {r[0] for r in brute.near(rows) if r[3]}


def test_near_duplicates_long_lists_and_odd_ids(spark, monkeypatch):
    from dispensary.llm import near_dedup as module

    monkeypatch.setattr(module, "PART_MEMBERS", 8)
    monkeypatch.setattr(module, "CELLS", 4096)
    r, base = random.Random(3), prose(9, 100).split()
    listed = []
    for k in range(60):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = f"w{r.randrange(50)}"
        listed.append((None if k == 7 else k // 2 if k < 10 else k, " ".join(words)))
    same(near_duplicates(spark.createDataFrame(listed, "doc_id long, text string")), brute.near(listed))


def test_near_dedup_decides_by_row(spark):
    """A shared id, equal rows and null ids: one row of each component stays, and no other component loses its row."""
    a, b, c, d = prose(31, 50), prose(32, 50), prose(33, 50), prose(34, 50)
    near = a + " end"
    data = [(1, a, "a1"), (2, near, "a2"), (2, b, "b"), (3, c, "c"), (3, c, "c"), (None, c + " end", "c"), (None, d, "d"), (None, d + " end", "d"), (None, d, "d"), (4, "", "e"), (4, "", "e"), (None, None, "e"), (None, " ", "e")]
    docs = spark.createDataFrame(data, "doc_id int, text string, source string")
    out = near_dedup(docs)
    assert out.columns == docs.columns and sorted(r.source for r in out.collect()) == ["a1", "b", "c", "d", "e", "e", "e", "e"]
    assert [(r.doc_id, r.text) for r in out.filter("source = 'c'").collect()] == [(3, c)]


def test_near_duplicates_find_every_link(spark):
    """Pairs of all similarities around the threshold: every exact link is found, also between texts of a few words."""
    r, listed = random.Random(12), []
    for k in range(150):
        base = prose(300 + k, r.choice((6, 9, 14, 25, 60, 150))).split()
        listed.append(" ".join(base))
        words_ = list(base)
        for _ in range(r.randrange(1, 1 + max(2, len(base) // 30))):
            words_[r.randrange(len(words_))] = f"n{r.randrange(9)}"
        listed.append(" ".join(words_))
        listed.append(" ".join(base[: -r.randrange(1, 1 + max(1, len(base) // 5))]))
    rows = list(enumerate(listed))
    want = brute.near(rows)
    assert sum(not x[3] for x in want) > 100
    same(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), want)


def test_near_duplicates_stage_takes_five_words(spark):
    """Similar at 79/95 on four words, at 76/96 on five."""
    from corpus_pipeline import near_duplicates as stage

    words = [f"w{i}" for i in range(90)]
    changed = ["x" if i == 30 else "y" if i == 60 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words))], "doc_id long, text string")
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 2]
    assert near_dedup(docs).count() == 1


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 450)]
    got = {c.cls: c.label for c in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for _ in range(len(links)):
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark):
    same(exact_top_k(spark.createDataFrame([(0, []), (1, [1.0]), (2, [])], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0), [(0, 1, 1, 0), (0, 2, 2, 0)])
    clash = spark.createDataFrame([(0, [1.0], 9, 8), (1, [2.0], 9, 8)], "vec_id long, embedding array<float>, id int, region int")
    same(exact_top_k(clash, lambda i: i % 100 == 0), [(0, 1, 1, 2 << 20)])
    r = random.Random(2)
    vec = [[r.gauss(0, 1) for _ in range(8)] for _ in range(400)]
    data = [(i, vec[i % 350]) for i in range(400)] + [(1000, None), (1100, [1.0, None]), (1200, [float("nan")]), (1300, [float("inf")]), (None, [1.0] * 8), (1, vec[3]), (1400, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    stored = [(x.vec_id, x.embedding) for x in df.collect()]
    want = brute.top(stored)
    for options in ({}, {"shard": 60, "leaf": 16, "block": 2, "sample": 50}):
        same(exact_top_k(df, lambda i: i % 100 == 0, **options), want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (100, [3.0])], "vec_id long, embedding array<float>")
    same(exact_top_k(few, lambda i: i % 100 == 0), brute.top([(0, [1.0]), (1, [2.0]), (100, [3.0])]))
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).count() == 0


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_substring_dedup(docs, rows, none, block_bytes):
    out = substring_dedup(docs, block_bytes=block_bytes)
    same(out.select("id", "n_words", "n_removed", F.sha2("kept", 256)), brute.substrings(rows))
    assert substring_dedup(none).count() == 0
    spans = out.select("id", "n_removed", F.aggregate("removed", F.lit(0), lambda a, s: a + s["stop"] - s["start"]).alias("n")).collect()
    assert all(r.n == r.n_removed for r in spans)


def test_without_repeats(docs, rows):
    out = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert len(out) == len(rows) and out[0].text is None
    for (i, text), (_, _, removed, digest_) in zip(rows, brute.substrings(rows), strict=True):
        assert out[i].text == text if not removed else hashlib.sha256(out[i].text.encode()).hexdigest() == digest_ and out[i].n_chars == len(out[i].text)


def test_without_repeats_of_shared_ids(spark):
    """Equal rows, a shared id and null ids: the passage stays once, and every other text is its row's own."""
    passage, other, third = prose(21, 40), prose(22, 30), prose(23, 50) + "  \n"
    data = [(1, passage, 40, "a"), (1, passage, 40, "a"), (1, other, 30, "b"), (2, third, 50, "c"), (2, other, 30, "d"), (None, passage, 40, "e"), (None, None, None, "f"), (3, None, 7, "g")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars int, source string")
    for block_bytes in (4 << 20, 100):
        out = without_repeats(docs, block_bytes=block_bytes)
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = sorted(((r.source, r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
        # a null id comes before all others, so row e keeps the passage; of the other two passages nothing is left
        assert got == [("a", 1, "", 0), ("a", 1, "", 0), ("b", 1, other, 30), ("c", 2, third, 50), ("d", 2, "", 0), ("e", None, passage, 40), ("f", None, None, None), ("g", 3, None, 7)]
        texts = sorted(r.text for r in without_repeats(docs.filter("source = 'a'"), block_bytes=block_bytes).collect())
        assert texts == ["", passage]


def test_quality(spark):
    r = random.Random(4)
    syllables = ["ba", "ne", "ti", "ro", "ka", "lu", "so"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    clean = lambda: " ".join(word() for _ in range(60))
    data, labels = [], []
    for i in range(700):
        text, quality_, toxic = clean(), 1, 0
        if i % 7 == 1:
            text, quality_ = " ".join(f"{w.upper()}$$%%" for w in text.split()), 0
        elif i % 7 == 2:
            words = text.split()
            for w in ("baddy", "meany", "vilex"):
                words.insert(r.randrange(len(words)), w)
            text, toxic = " ".join(words), 1
        data.append((i, text, "xx"))
        if i % 2:
            labels.append((i, quality_, toxic))
    data += [(1000, None, "xx"), (1001, "", None), (1002, "zzz qqq", "yy"), (None, clean(), "xx"), (5, clean(), "xx")]
    labels += [(1, None, None), (9999, 1, 0), (None, 1, 0), (3, 0, 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    rows = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(data)
    judged = {x.id: x for x in rows}
    share = lambda rest: sum(judged[i].kept for i in range(700) if i % 2 == 0 and i % 7 in rest) / len([i for i in range(700) if i % 2 == 0 and i % 7 in rest])
    assert share({0, 3, 4, 5, 6}) > 0.97 and share({1}) < 0.05 and share({2}) < 0.05
    assert judged[1000].kept and judged[1000].perplexity is None and judged[1001].kept and judged[1002].kept
    kept = quality.good_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.classify(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_good_documents_decides_by_row(spark):
    """A rejected row takes neither a clean row of its id nor one in another language with it; null ids are judged too."""
    r = random.Random(6)
    clean = lambda: " ".join("".join(r.choice(("ba", "ne", "ti", "ro")) for _ in range(r.randint(1, 3))) for _ in range(60))
    bad = " ".join(f"{w.upper()}$$%%" for w in clean().split())
    data = [(i, clean(), "xx") for i in range(300)] + [(5, bad, "xx"), (5, bad, "yy"), (None, bad, "xx"), (None, clean(), "xx"), (6, bad, "xx"), (6, bad, "xx")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10, 300)], "doc_id long, quality int, toxic int")
    kept = [(x.doc_id, x.text, x.lang) for x in quality.good_documents(docs, labels).collect()]
    assert data[5] in kept and data[6] in kept and data[301] in kept and data[303] in kept
    assert not {data[300], data[302], data[304]} & set(kept)


def test_kneser_ney_sums_to_one(spark):
    """Over all characters that follow a context, seen or not, the model's probabilities add up to one."""
    counts = brute.collections.Counter()
    for w, n in (("abab", 3), ("abc", 2), ("b", 1)):
        padded = "\x02" * (quality.ORDER - 1) + w + "\x03"
        for i in range(len(w) + 1):
            counts[padded[i : i + quality.ORDER]] += n
    model = quality.probabilities(spark.createDataFrame([("l", g, n) for g, n in counts.items()], "lang string, gram string, n long"))
    contexts, seen = ["\x02\x02\x02", "\x02\x02a", "bab", "zzz", "zza"], ["a", "b", "c", "\x03"]
    asked = spark.createDataFrame([("l", c + x) for c in contexts for x in [*seen, "Z"]] + [("other", "abcd")], "lang string, gram string")
    logp = {r.gram: r.logp for r in quality.gram_scores(asked, model).collect()}
    assert len(logp) == len(contexts) * 5
    want = brute.kneser_ney({"abab": 3, "abc": 2, "b": 1}, quality.ORDER)
    for c in contexts:
        total = sum(math.exp(logp[c + x]) for x in seen) + (4096 - len(seen)) * math.exp(logp[c + "Z"])
        assert abs(total - 1) < 1e-9
        assert all(abs(math.exp(logp[c + x]) - want(c, x)) < 1e-12 for x in [*seen, "Z"])


def test_quality_against_brute_force(spark):
    """Both perplexities and the decision of every document of the smallest tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    stored = [(r.doc_id, r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()]
    want = brute.judged(stored, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()], quality.HELD_OUT, quality.QUANTILE, quality.PEAK_QUANTILE, quality.MARGIN)
    got = {r.id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(stored)
    for i, n, whole, peak, kept in want:
        r = got[i]
        assert r.n_words == n and r.kept == kept and (r.perplexity is None) == (whole is None) and (r.peak is None) == (peak is None)
        assert whole is None or abs(r.perplexity / whole - 1) < 1e-9
        assert peak is None or abs(r.peak / peak - 1) < 1e-9


def test_quality_clashing_columns_and_long_texts(spark):
    docs = spark.createDataFrame([(i, "ba ne ti " * 20, "xx", 1, b"k", "r", 5, 2) for i in range(30)] + [(99, "ba ne " * 60_000 + "x" * 200_000, "xx", 1, b"k", "r", 5, 2)], "doc_id long, text string, lang string, id int, key binary, rest string, block int, perplexity int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = {r.id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == 31 and rows[99].n_words == 120_001 and not rows[99].kept and all(rows[i].kept for i in range(30))
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 30


def test_url_filter(spark):
    at = lambda day: f"2024-01-{day:02d} 00:00:00"
    entries = [("Example.com", "block", at(5)), ("example.com", "lift", at(10)), ("a.example.com", "allow", at(6)), ("b.org/private", "block", at(1)), ("c.net", "block", at(3)), ("c.net", "allow", at(3)), ("d.net", "purge", at(1)), (None, "block", at(1)), ("e.net", "block", None)]
    urls = [(1, "http://example.com/x", at(4)), (2, "http://www.Example.com:80/x", at(5)), (3, "http://example.com", at(9)), (4, "http://example.com", at(10)), (5, "https://u@a.example.com/", at(7)), (6, "http://b.org/private/1", at(2)), (7, "http://b.org/public", at(2)), (8, "http://c.net.", at(4)), (9, "http://d.net", at(4)), (10, None, at(4)), (11, "relative", at(4)), (12, "http://c.net", None), (1, "http://example.com/x", at(4))]
    c = spark.createDataFrame(urls, "page_id long, url string, at string").selectExpr("page_id", "url", "cast(at as timestamp) fetched_at", "'x' as pattern")
    e = spark.createDataFrame(entries, "pattern string, action string, at string").selectExpr("pattern", "action", "cast(at as timestamp) listed_at")
    got = {r.id: (r.kept, r.n_captures, r.pattern) for r in url_filter(c, e).collect()}
    assert got[1] == (True, 2, None) and got[2] == (False, 1, "example.com") and not got[3][0] and got[4] == (True, 1, None) and got[5] == (True, 1, "a.example.com")
    assert not got[6][0] and got[7][0] and not got[8][0] and all(got[i][0] for i in (9, 10, 11, 12)) and len(got) == 12
    assert url_filter(c, e.limit(0)).filter("not kept").count() == 0 and url_filter(c.limit(0), e).count() == 0


def test_url_filter_folders_far_dates_and_long_urls(spark):
    long_ = "http://b.org/" + "x" * 100_000
    urls = [(1, "http://B.org/Private/1", "2024-01-05 00:00:00"), (2, "http://b.org/private", "2024-01-05 00:00:00"), (3, "http://b.org/Private", "9999-12-30 00:00:00"), (4, long_, "2024-01-05 00:00:00"), (5, "http://c.org", "0002-01-01 00:00:00")]
    c = spark.createDataFrame(urls, "page_id long, url string, at string").selectExpr("page_id", "url", "cast(at as timestamp) fetched_at", "1 as period", "2 as start", "3 as host")
    e = spark.createDataFrame([("B.org/Private", "block", "2024-01-01 00:00:00"), ("c.org", "block", "2024-01-01 00:00:00"), ("c.org", "lift", "9998-01-01 00:00:00")], "pattern string, action string, at string").selectExpr("pattern", "action", "cast(at as timestamp) listed_at", "4 as periods")
    got = {r.id: (r.kept, r.pattern) for r in url_filter(c, e).select("id", "kept", "pattern").collect()}
    assert got == {1: (False, "b.org/Private"), 2: (True, None), 3: (False, "b.org/Private"), 4: (True, None), 5: (True, None)}


def test_url_filter_is_native(spark):
    plan = queries.op7_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


TOOLS = {"add": {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 0}, "to": {"type": "array", "items": {"type": "string"}}}}}


def test_schema_problems():
    for value, bad in [({"n": 1}, False), ({"n": True}, True), ({"n": -1}, True), ({}, True), ({"n": 1, "x": 2}, True), ({"n": 1, "to": ["a", 1]}, True), ([], True)]:
        assert bool(problem(value, TOOLS["add"])) == bad
    assert canonical({"b": 1, "a": "é\n"}) == '{"a":"é\\n","b":1}'


def test_chat_format(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 2, None, None), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    calls = [(1, 1, "c", "add", '{"n": 2}', ["b", "gone"]), (1, 1, "b", "add", '{"to": ["x"], "n":1}', ["a"]), (1, 1, "a", "add", '{"n":"x"}', None), (1, 3, "p", "add", '{"n":1}', ["q"]), (1, 3, "q", "add", '{"n":1}', ["p"]), (2, 0, "u", "mul", "{}", []), (2, 1, "j", "add", "{", []), (2, 2, "t", "add", '{"n":1}', []), (2, 3, "t", "add", '{"n":1}', []), (2, 4, None, "add", '{"n":1}', []), (2, 5, "k", "add", '{"n": NaN}', [])]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("c", "4"), ("zz", "5"), (None, "6"), ("u", "7"), ("j", "8"), ("p", "9"), ("q", "9"), ("t", "9")], "call_id string, content string")
    out = link_tool_calls(messages, calls, results, TOOLS).collect()
    assert len(out) == 3 + 11 + 11
    own = {r.call_id: r for r in out if r.kind == 1}
    assert {k: own[k].level for k in "abc"} == {"a": 0, "b": 1, "c": 2}
    assert {k: r.status for k, r in own.items()} == {"a": "bad_arguments", "b": "ok", "c": "ok", "p": "cycle", "q": "cycle", "u": "unknown_tool", "j": "bad_json", "t": "repeated_id", None: "no_result", "k": "bad_json"}
    assert own["b"].line == '{"role":"assistant","tool_calls":[{"arguments":{"n":1,"to":["x"]},"id":"b","name":"add","needs":["a"]}]}'
    back = [r for r in out if r.kind == 2]
    assert sorted(r.status for r in back).count("orphan") == 2 and all(json.loads(r.line)["role"] == "tool" for r in back)
    none = link_tool_calls(messages.limit(0), calls.limit(0), results.limit(0), TOOLS)
    assert none.count() == 0


def test_schema_keywords():
    fits = lambda value, schema: problem(value, schema) is None
    assert fits(None, {"type": ["object", "null"]}) and fits(1.0, {"type": "integer"}) and not fits(True, {"enum": [1]}) and fits(1, {"const": 1.0})
    assert not fits("ab", {"pattern": "^b"}) and fits("b", {"anyOf": [{"type": "integer"}, {"pattern": "^b"}]}) and not fits(1, {"exclusiveMinimum": 1})
    assert not fits([1, 1.0], {"uniqueItems": True}) and not fits({"a": 1}, {"additionalProperties": {"type": "string"}}) and not fits(3, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}) and not fits(4, {"not": {"multipleOf": 2}})
    for bad in ({"$ref": "#"}, {"type": "text"}, {"properties": {"a": {"minimun": 1}}}, {"items": {"type": ["string", "date"]}}):
        with pytest.raises(ValueError):
            check_schema(bad)


def test_chat_format_of_odd_arguments(spark):
    """Numbers beyond a double, half surrogate pairs, deep nesting and long texts are told apart, and no job dies."""
    tools = {"any": {"type": ["object", "null"]}, "add": TOOLS["add"]}
    odd = ['{"n":1e999}', '{"q":"\\ud800"}', "[" * 100_000, "null", None, "", "1", '{"n":' + "9" * 5000 + "}", '{"q":"' + "x" * 300_000 + '"}']
    calls = [(1, i, f"c{i}", "any", x, None, 1) for i, x in enumerate(odd)] + [(1, 99, "bad", "add", '{"n":1,"\\udc00":2}', None, 1)]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, kind int")
    messages = spark.createDataFrame([(1, 0, "user", "x" * 300_000, 5, "l")], "conv_id long, turn long, role string, text string, kind int, level string")
    results = spark.createDataFrame([(f"c{i}", "r", 1) for i in range(len(odd))], "call_id string, content string, owner int")
    own = {r.call_id: r for r in link_tool_calls(messages, calls, results, tools).filter("kind = 1").collect()}
    assert [own[f"c{i}"].status for i in range(len(odd))] == ["bad_json", "ok", "bad_json", "ok", "bad_json", "bad_json", "bad_arguments", "bad_json", "ok"]
    assert '"\\ud800"' in own["c1"].line and json.loads(own["c1"].line)["tool_calls"][0]["arguments"] == {"q": "\ud800"}
    assert own["bad"].status == "bad_arguments" and "\\udc00" in own["bad"].error


def test_chat_format_against_brute_force(spark):
    """Every row of the query over the whole table."""
    stored = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op9_chat_format(spark, "/root/testdata/sf0.01").drop("error"), brute.chat(stored))


def test_levels_of_deep_chains_ladders_and_cycles(spark):
    """Deeper than a thousand levels, against the levels that follow from how the calls are made."""
    n = 2600
    needs = [(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [("c0", "unknown"), (f"c{n - 1}", "c5"), ("c7", None)]
    want = {f"c{i}": i for i in range(n)}
    needs += [(f"l{i}", f"l{i - d}") for i in range(8) for d in (1, 2) if i >= d]  # each needs the two before it
    want |= {f"l{i}": i for i in range(8)}
    needs += [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)] + [("after", "r3"), ("after2", "after"), ("after2", "c9"), ("self", "self"), ("self", "c1")]
    want |= {f"r{i}": None for i in range(40)} | dict.fromkeys(("after", "after2", "self"))
    needs += [(a, b) for a in ("k0", "k1", "k2") for b in ("k0", "k1", "k2") if a != b] + [("k3", "k0"), ("k3", "k1")]  # all need each other
    want |= dict.fromkeys(("k0", "k1", "k2", "k3"))
    needs += [("join", "c100"), ("join", "l7"), ("last", "join"), ("last", "c50")]
    want |= {"join": 101, "last": 102}
    calls = spark.createDataFrame([(x,) for x in [*want, None, "c1"]], "call_id string")
    got = topological_levels(calls, spark.createDataFrame(needs, "call_id string, needed string")).collect()
    assert len(got) == len(want) and {r.call_id: r.level for r in got} == want


@pytest.mark.parametrize("at_once", [100_000, 30])
def test_levels_by_conversation(spark, at_once):
    """Deep ladders within conversations, edges across some, calls that several conversations name, cycles, null conversations."""
    r = random.Random(at_once)
    n = 2000 if at_once > 1000 else 12
    calls = [(1, f"l{i}") for i in range(n)] + [(c, f"c{c}-{i}") for c in range(2, 12) for i in range(6)] + [(None, "x"), (None, "y"), (3, "both"), (4, "both"), (5, None)]
    needs = [(f"l{i}", f"l{i - d}") for i in range(n) for d in (1, 2) if i >= d]  # each needs the two before it
    needs += [(f"c{c}-{i}", f"c{c}-{r.randrange(6) if r.random() < 0.2 else r.randrange(i)}") for c in range(2, 12) for i in range(1, 6) for _ in range(2)]
    needs += [("c5-5", "c6-5"), ("c7-1", "both"), ("both", "c8-2"), ("x", "y"), ("y", "c9-0"), ("c2-3", "unknown"), (None, "c2-1"), ("c2-2", None)]
    names = {x for _, x in calls if x}
    edges = {x: {b for a, b in needs if a == x and b in names} for x in names}
    want, open_ = {}, dict(edges)
    while now := {x for x, need in open_.items() if need <= want.keys()}:
        want |= {x: 1 + max((want[y] for y in edges[x]), default=-1) for x in now}
        open_ = {x: need for x, need in open_.items() if x not in now}
    want |= dict.fromkeys(open_)
    cd = spark.createDataFrame(calls, "conv_id long, call_id string")
    got = conversation_levels(cd, spark.createDataFrame(needs, "call_id string, needed string"), at_once).collect()
    assert len(got) == len(want) and {x.call_id: x.level for x in got} == want
    assert at_once < 1000 or want[f"l{n - 1}"] == n - 1
