"""Hard negatives, shards and spelling variants against brute force, on odd rows, ties and skew."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispensary.llm import hard_negatives as H
from dispensary.llm import sharding as S
from dispensary.llm import spelling
from dispensary.llm.hard_negatives import hard_negatives
from dispensary.llm.sharding import shard_documents, write_shards
from dispensary.llm.spelling import near_words, spelling_groups
from tests.llm import brute
from tests.llm.test_operators import same

VECTORS = "vec_id long, embedding array<float>, label int, id long, shard string, block int, codes int"


def flipped():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def vectors(seed, n, width=6):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.random()
        v = [r.choice((0.0, 0.5, -0.25, 0.125)) for _ in range(width)] if kind < 0.4 else [r.gauss(0.2, 0.5) for _ in range(width)]
        out.append((i, v, r.choice((0, 0, 0, 1, 2, 9))))
    out += [(None, [1.0] * width, 1), (50, None, 1), (100, [1.0, None], 1), (150, [float("nan")], 1), (n + 1, [float("inf")], 2), (n + 2, [1.0] * width, None)]
    out += [(200, [], 0), (201, [9.0], 0), (202, [1.0] * (width + 5), 1)]  # shorter and longer than the sample may be
    out += [out[50], out[51], out[51], (50, [0.1] * width, 9)]  # repeated rows, another row of an anchor's id
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x in out]


@pytest.mark.parametrize(("shard", "block", "entries"), [(40, 2, 3), (8192, 16384, 256)])
def test_hard_negatives(spark, shard, block, entries):
    rows = vectors(shard, 300)
    df = spark.createDataFrame([(*r, 7, "s", 1, 2) for r in rows], VECTORS)
    got = hard_negatives(df, lambda i: i % 50 == 0, flipped(), shard=shard, block=block, entries=entries, sample=64, piece=4)
    want = brute.hard_negatives(rows)
    assert len(want) > 20
    same(got, want)


def test_hard_negatives_of_equal_and_no_rows(spark):
    equal = [(i, [0.5, 0.25], i % 2) for i in range(120)]  # all scores alike: windows are empty
    df = spark.createDataFrame([(*r, 7, "s", 1, 2) for r in equal], VECTORS)
    same(hard_negatives(df, lambda i: i % 50 == 0, flipped(), shard=50), brute.hard_negatives(equal))
    assert hard_negatives(spark.createDataFrame([], VECTORS), lambda i: i % 50 == 0).count() == 0
    lonely = spark.createDataFrame([(0, [1.0], 1, 7, "s", 1, 2)], VECTORS)
    assert hard_negatives(lonely, lambda i: i % 50 == 0).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(3)
    x, q = r.integers(-300, 300, (500, 10)).astype(float), r.integers(-300, 300, (40, 12)).astype(float)
    books = H.codebooks(x[:50, :7], 3, 5)
    codes, residual = H.coded(x, books)
    low, high = H.bounds(q, codes, residual, books, float(np.sqrt((x**2).sum(axis=1).max())))
    exact = q[:, :10] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low < 2 * np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))).mean() > 0.9  # tighter than the norms alone


class _Listed(S.Ends):
    """Ends that are all at hand."""

    def __init__(self, ends, shift, finer):
        self.all, self.total, self.finer, self.open = ends, ends[-1], finer, set()
        self.known = {0: (0, 0)} | self._stretches(ends, shift)
        self.firsts = sorted(self.known)

    @staticmethod
    def _stretches(ends, shift):
        groups = collections.defaultdict(list)
        for x in ends:
            groups[x >> shift].append(x)
        return {v[0]: (v[-1], shift) for v in groups.values()}

    def refine(self):
        for a in self.open:
            b, shift = self.known.pop(a)
            self.known |= self._stretches([x for x in self.all if a <= x <= b], max(0, shift - self.finer))
        self.firsts, self.open = sorted(self.known), set()


def test_smallest_capacity_and_even_cuts():
    r = random.Random(3)
    for _ in range(150):
        sizes = [r.randint(1, r.choice([3, 40])) for _ in range(r.randint(1, 40))]
        if r.random() < 0.4:
            sizes[r.randrange(len(sizes))] *= r.randint(2, 60)
        shards, all_ends = r.randint(1, 16), list(itertools.accumulate(sizes))
        ends = _Listed(all_ends, r.randint(0, 8), r.randint(1, 4))
        while True:
            capacity = S._capacity(ends, shards)
            cuts = S._cuts(ends, capacity, shards)
            if not ends.open:
                break
            ends.refine()
        assert capacity == brute.smallest_capacity(sizes, shards)
        assert cuts == sorted(cuts) and len(cuts) == shards - 1
        for a, b in itertools.pairwise([0, *cuts, all_ends[-1]]):
            assert b - a <= capacity or sum(a < x <= b for x in all_ends) == 1


def held(rows, shards, **options):
    """The checks that any result must pass; gives the sizes of the shards."""
    got = rows.collect()
    per = collections.defaultdict(list)
    for x in got:
        per[x.shard].append(x)
    assert set(per) <= set(range(shards))
    for own in per.values():
        assert sorted(x.slot for x in own) == list(range(len(own)))
    return got, [sum(x.size for x in per[k]) for k in range(shards)]


def test_shards(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(S, "STRETCHES", 8)  # a search in many rounds
    for shards in (1, 2, 5, 16):
        got, sizes = held(shard_documents(docs, shards), shards)
        text = dict(rows)
        assert sorted((x.id, x.size, x.text_crc32) for x in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        where = collections.defaultdict(set)
        for x in got:
            where[text[x.id] or ""].add(x.shard)
        assert all(len(x) == 1 for x in where.values())
        groups = collections.Counter()
        for t in text.values():
            groups[t or ""] += len((t or "").encode()) + 1
        order = [r.t for r in spark.createDataFrame([(t,) for t in groups], "t string").orderBy(S.text_group(F.col("t"))).collect()]
        order.sort(key=lambda t: groups[t] * shards <= sum(groups.values()))  # noqa: B023
        capacity = brute.smallest_capacity([groups[t] for t in order], shards)
        assert max(sizes) <= max(capacity, *groups.values())
    assert shard_documents(none).count() == 0


def test_shards_of_a_giant_group_and_equal_rows(spark):
    rows = [(k, "copy of one text") for k in range(3000)] + [(k, f"text {k} of its own") for k in range(3000, 9000)] + [(1, "equal row")] * 50 + [(None, None)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))
    got, sizes = held(shard_documents(df), 16)
    assert len(got) == len(rows)
    giant = 3000 * 17
    assert max(sizes) < 1.1 * max(giant, (sum(sizes) - giant) / 15)
    rest = sorted(sizes)[:-1]
    assert min(rest) > 0.9 * max(rest)  # all others are even
    again, _ = held(shard_documents(df.repartition(7)), 16)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_written_shards(spark, docs, tmp_path):
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "shard"}
    where = {r.id: r.shard for r in shard_documents(docs, 4).collect()}
    assert {r.doc_id: r.shard for r in back.select("doc_id", "shard").collect()} == where


def test_sharding_is_native(spark, docs):
    for df in (shard_documents(docs), S.sized(docs, "doc_id", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def variants(seed, words, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 60)):
            w = r.choice(words[: 1 + int(len(words) * r.random() ** 3)])
            k = r.randrange(len(w) + 1)
            if r.random() < 0.15:
                w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("aeÀ÷é") + w[k:], w[:k] + r.choice("aeßÿ") + w[k + 1 :]))
            text.append(r.choice((w, w.upper(), w.capitalize())))
        out.append((i, r.choice((" ", ", ", "1", "_")).join(text)))
    return out


@pytest.mark.parametrize(("letters", "one_in"), [("abcdeéÀß", 199), ("ab", 3)])
def test_spelling(spark, letters, one_in):
    r = random.Random(len(letters))
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 11))) for _ in range(60)]
    rows = variants(one_in, words, 150) + [(None, "aaaaaa " * 9), (None, "aaaaaa " * 9), (7, None), (8, ""), (9, "x" * 30_000 + " " + "y" * 30_000), (3, "aaaaaab " * 50 + "12 ... Ā K")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("n")).withColumn("id", F.lit("i"))
    for least in (1, 5):
        want = brute.spelling(rows, least=least, one_in=one_in)
        assert any(x[1] for x in want)
        same(spelling_groups(df, least=least, one_in=one_in), want)


def test_spelling_of_nothing_and_chains(spark):
    assert spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling_groups(spark.createDataFrame([], "doc_id long, text string"), shortest=3)
    chain = ["abcdefgh"[:6] + "x" * k for k in range(4)]  # each one letter longer, five times rarer
    rows = [(k, " ".join([w] * 5 ** (5 - k))) for k, w in enumerate(chain)]
    same(spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), one_in=10**9), brute.spelling(rows, one_in=10**9))


def test_prefix_finds_every_pair(spark):
    """Words over two letters share bigrams, so positions and the order among equal ones matter."""
    words = ["".join(w) for n in (4, 5, 6) for w in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in near_words(df).collect()}
    want = {(a, b) for a in words for b in words if a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b))))}
    assert got == want | {(b, a) for a, b in want}


def test_a_common_half_does_not_multiply_candidates(spark):
    """A third of all words begin alike; what the join makes stays near the number of words."""
    words = [f"aaaaaa{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}zz" for k in range(3000)]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    assert near_words(df).count() < 80 * len(words)  # a word has 75 others at most that differ in one of three letters
    plan = spelling.near_words(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"))
