"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, per language.

The model is an interpolated modified Kneser-Ney model over the characters of words, as the words of the languages
are not a closed list; a word is scored with its begin and end.  Its counts cover all trusted documents: tasks count
the grams of blocks of documents, Spark sums them, and the lower orders, discounts and probabilities are groupings
and joins over gram tables that are dealt by gram.  Nothing of it passes through the driver or is sent to all tasks.

Scoring is a join of counts too.  A block (see _dictionary) holds its documents as counts of the block's distinct words, and asks
once for each distinct gram of these words; the asked grams of all blocks are made distinct, joined with the gram
tables, and their log-probabilities go back to the blocks, which sum them over words and words over documents.

Two perplexities of a document are judged: that of its whole text, and that of its least likely word (the peak), as a
few bad words hardly move the perplexity of a long text.  A language's thresholds are quantiles of both over
trusted documents that were kept out of the model.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dispensary.llm import _dictionary as D
from dispensary.llm._blocks import opened_ids
from dispensary.llm._spark import checkpointed, few, give_back, text_key

ORDER = 4
#: One trusted document of so many is kept out of the model; its scores set the thresholds.
HELD_OUT = 5
#: The quantiles of the two perplexities over these, and how far beyond them a perplexity must be.
QUANTILE, PEAK_QUANTILE, MARGIN = 0.997, 0.995, 1.1
#: A word of at least so many letters, and of nothing else, counts for the peak.
PEAK_LETTERS = 4
#: Log-probability of a character that the model has never seen.
UNSEEN = math.log(1 / 4096)

_BEGIN, _END = "\x02", "\x03"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def plain(words: pa.Array) -> pa.Array:
    """Without punctuation at either end, in small letters."""
    return pc.utf8_lower(pc.utf8_trim(words, string.punctuation))


# --- grams of a block's words -----------------------------------------------------------------------------------


class Grams:
    """The grams of an array of words: `texts` are the distinct ones, `of` says which one each character of a word ends."""

    def __init__(self, words: pa.Array):
        padded = pc.binary_join_element_wise(_BEGIN * (ORDER - 1), words, _END, "")
        text = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), np.uint32)
        self.sizes = np.asarray(pc.utf8_length(words)).astype(np.int64) + 1
        at = np.ones(len(text), bool)  # the characters of words, not of what stands before them
        begins = np.cumsum(self.sizes + ORDER - 1) - self.sizes - ORDER + 1
        for j in range(ORDER - 1):
            at[begins + j] = False
        at = np.flatnonzero(at)
        keys = np.zeros(len(at), np.uint64)
        for j in range(ORDER - 1, -1, -1):
            keys = keys * _BASE + text[at - j]
        encoded = pa.array(keys).dictionary_encode()
        self.of = np.asarray(encoded.indices)
        first = np.zeros(len(encoded.dictionary), np.int64)
        first[self.of[::-1]] = at[::-1]  # the last one written is the first place
        points = np.stack([text[first - j] for j in range(ORDER - 1, -1, -1)], axis=1) if len(first) else np.zeros((0, ORDER), np.uint32)
        joined = points.tobytes().decode("utf-32-le")
        self.texts = [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """The sum over a word's characters of a value for each distinct gram."""
        return np.add.reduceat(values[self.of], np.cumsum(self.sizes) - self.sizes) if len(self.sizes) else np.zeros(0)


class Bag:
    """A block's documents as counts of its distinct words, one language after the other."""

    def __init__(self, body: bytes, langs: list[str]):
        n, _, self.codes, self.times = D.coded_texts(body)
        self.words = pa.array(D.listed_words(body), pa.binary()).cast(pa.string())
        self.langs = np.array(langs, object)
        self.doc = np.repeat(np.arange(len(n)), n)

    def of(self, lang: str) -> np.ndarray:
        """Which entries are of documents in that language."""
        return np.flatnonzero((self.langs == lang)[self.doc])

    def forms(self, lang: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Word numbers, the forms that are scored (the words, then plain forms), and the plain form of each word or -1."""
        used = np.unique(self.codes[self.of(lang)])
        words = self.words.take(pa.array(used))
        bare = plain(words)
        counts = np.flatnonzero(np.asarray(pc.and_(pc.utf8_is_alpha(bare), pc.greater_equal(pc.utf8_length(bare), PEAK_LETTERS))))
        both = pa.concat_arrays([words, bare.take(pa.array(counts))]).dictionary_encode()  # the words are distinct and keep their places
        peak = np.full(len(used), -1)
        peak[counts] = np.asarray(both.indices)[len(used) :]
        return used, both.dictionary, peak


def _bags(docs: DataFrame) -> DataFrame:
    """Blocks of (id, lang, text, key); `rest` keeps lang and key."""
    return D.coded(docs.select("id", "text", F.struct("lang", "key").alias("rest")), None, frequencies=True)


def _opened(t, i: int) -> Bag:
    give_back()  # what the block before needed
    return Bag(t.column("body")[i].as_py(), t.column("rest")[i].values.field("lang").to_pylist())


# --- training ---------------------------------------------------------------------------------------------------


def _labelled(labels: DataFrame) -> DataFrame:
    """(id, part): trusted, or held (trusted, kept out of the model); contradicting rows count against trust."""
    one = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    trusted = one.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return trusted.select("id", F.when(F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0, "held").otherwise("trusted").alias("part"))


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def _counts(bags: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, gram, n) over the documents whose ids are in `trusted`."""
    asked = opened_ids(bags).join(trusted, "id").select(F.col("block").alias("at_block"), "place")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _COUNTS.empty_table()
        bag, out = _opened(left, 0), []
        taken = np.zeros(len(bag.langs), bool)
        taken[np.asarray(right.column("place"))] = True
        for lang in sorted(set(bag.langs[taken])):
            own = bag.of(lang)
            own = own[taken[bag.doc[own]]]
            n = np.bincount(bag.codes[own], weights=bag.times[own], minlength=len(bag.words))
            words = np.flatnonzero(n)
            grams = Grams(bag.words.take(pa.array(words)))
            summed = np.bincount(grams.of, weights=np.repeat(n[words], grams.sizes), minlength=len(grams.texts))
            out.append(pa.table([pa.array([lang] * len(summed), pa.string()), pa.array(grams.texts, pa.string()), pa.array(summed.astype(np.int64))], schema=_COUNTS))
        return pa.concat_tables(out) if out else _COUNTS.empty_table()

    counted = bags.groupBy("block").cogroup(asked.groupBy("at_block")).applyInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(levels: DataFrame) -> DataFrame:
    """D1, D2, D3+ of each language and order, from the numbers of grams that occur one to four times."""
    n = levels.groupBy("lang", "size").agg(*[F.greatest(F.lit(1), F.count(F.when(F.col("n") == i, 1))).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.greatest(F.lit(0.05), F.least(F.lit(float(i) - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).alias(f"d{i}") for i in (1, 2, 3)]
    return n.select("lang", "size", *d)


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp, log_rest) for grams of every length; log_rest is the weight left to shorter grams after it."""
    levels = own = counts.select("lang", F.lit(ORDER).alias("size"), "gram", "n")
    for size in range(ORDER - 1, 0, -1):  # below the top, how many different characters precede a gram
        own = own.groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n")).select("lang", F.lit(size).alias("size"), "gram", "n")
        levels = levels.unionByName(own)
    levels = checkpointed(levels)
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = levels.join(few(_discounts(levels)), ["lang", "size"]).withColumn("cut", cut).withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    after = Window.partitionBy("lang", "size", "context")  # at most as many rows as there are characters
    total = F.sum("n").over(after)
    grams = grams.select("lang", "size", "gram", "context", ((F.col("n") - F.col("cut")) / total).alias("own"), (F.sum("cut").over(after) / total).alias("rest"))
    grams = checkpointed(grams)
    below, out = None, None
    for size in range(1, ORDER + 1):
        own = grams.filter(F.col("size") == size)
        if below is None:
            below = own.select("lang", "gram", (F.col("own") + F.col("rest") * math.exp(UNSEEN)).alias("p"))
        else:
            shorter = below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("p_shorter"))
            below = own.withColumn("shorter", F.substring("gram", 2, size)).join(shorter, ["lang", "shorter"]).select("lang", "gram", (F.col("own") + F.col("rest") * F.col("p_shorter")).alias("p"))
        out = below if out is None else out.unionByName(below)
    rests = grams.select("lang", F.col("context").alias("gram"), F.log("rest").alias("log_rest")).distinct()
    return checkpointed(out.select("lang", "gram", F.log("p").alias("logp")).join(rests, ["lang", "gram"], "full"))


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The gram tables of the trusted documents among (id, lang, text, key) as one DataFrame, written to the shared folder."""
    return probabilities(checkpointed(_counts(_bags(docs), _labelled(labels).filter("part = 'trusted'").select("id"))))


# --- scoring ----------------------------------------------------------------------------------------------------


def gram_scores(asked: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, gram, logp) for distinct (lang, gram) of the full length, in languages that the model knows.

    A gram has the probability of its longest ending that the model has seen, times the weights that the contexts
    of the longer endings leave to shorter ones."""
    ending = lambda size: F.substring("gram", ORDER + 1 - size, size)
    looked = [F.struct(F.lit(k).alias("size"), F.lit(True).alias("whole"), ending(k).alias("key")) for k in range(1, ORDER + 1)]
    looked += [F.struct(F.lit(k).alias("size"), F.lit(False).alias("whole"), F.substring("gram", ORDER + 1 - k, k - 1).alias("key")) for k in range(2, ORDER + 1)]
    keys = asked.select("lang", "gram", F.explode(F.array(*looked)).alias("x")).select("lang", "gram", "x.*")
    found = keys.join(model.withColumnRenamed("gram", "key"), ["lang", "key"], "left")
    rest = {k: F.max(F.when((F.col("size") == k) & ~F.col("whole"), F.col("log_rest"))).alias(f"r{k}") for k in range(2, ORDER + 1)}
    seen = F.max(F.when(F.col("whole") & F.col("logp").isNotNull(), F.struct("size", "logp"))).alias("seen")
    one = found.groupBy("lang", "gram").agg(seen, *rest.values())
    langs = few(model.filter("gram = ''").select("lang", F.col("log_rest").alias("r1")))
    one = one.join(langs, "lang")
    total = F.coalesce(F.col("seen.logp"), F.lit(UNSEEN))
    for k in range(1, ORDER + 1):
        total = total + F.when(F.coalesce(F.col("seen.size"), F.lit(0)) < k, F.coalesce(F.col(f"r{k}"), F.lit(0.0))).otherwise(0.0)
    return one.select("lang", "gram", total.alias("logp"))


_SCORES = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("key", pa.binary()), ("n_words", pa.int64()), ("perplexity", pa.float64()), ("peak", pa.float64())])


def scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lang, key, n_words, perplexity, peak) of (id, lang, text, key); both are null without words or model, and
    the peak without a word of letters alone."""
    bags = _bags(docs)

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                bag, place = _opened(b, i), 0
                for lang in sorted(set(bag.langs)):
                    texts = Grams(bag.forms(lang)[1]).texts
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), b.column("block")[i].as_py(), np.int64)), pa.array(np.arange(place, place + len(texts), dtype=np.int32)), pa.array([lang] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["block", "place", "lang", "gram"])
                    place += len(texts)

    asked = bags.mapInArrow(ask, "block long, place int, lang string, gram string").repartition("lang", "gram")  # dealt once, for both uses
    answers = asked.join(gram_scores(asked.select("lang", "gram").distinct(), model), ["lang", "gram"]).select("block", "place", "logp")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORES.empty_table()
        bag, place = _opened(left, 0), 0
        known = np.full(int(np.asarray(right.column("place")).max(initial=-1)) + 1, np.nan)
        known[np.asarray(right.column("place"))] = np.asarray(right.column("logp"))
        n_docs = len(bag.langs)
        n_words, whole, top = np.bincount(bag.doc, weights=bag.times, minlength=n_docs).astype(np.int64), np.full(n_docs, np.nan), np.full(n_docs, np.nan)
        for lang in sorted(set(bag.langs)):
            used, forms, peak = bag.forms(lang)
            grams = Grams(forms)
            values = np.full(len(grams.texts), np.nan)
            here = known[place : place + len(values)]
            values[: len(here)] = here
            place += len(values)
            if not len(used) or np.isnan(values).any():  # a language without a model
                continue
            logp = grams.per_word(values)
            own = bag.of(lang)
            word, doc, times = np.searchsorted(used, bag.codes[own]), bag.doc[own], bag.times[own]
            total, size = (np.bincount(doc, weights=times * x[word], minlength=n_docs) for x in (logp, grams.sizes))
            has = size > 0
            whole[has] = np.exp(np.minimum(700.0, -total[has] / size[has]))
            least = np.where(peak >= 0, -(logp / grams.sizes)[peak], -np.inf)
            worst = np.full(n_docs, -np.inf)
            np.maximum.at(worst, doc, least[word])
            has = np.isfinite(worst)
            top[has] = np.exp(np.minimum(700.0, worst[has]))
        rest = left.column("rest")[0].values
        floats = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (whole, top)]
        return pa.Table.from_arrays([pa.array(left.column("ids")[0].as_py(), pa.int64()), rest.field("lang"), rest.field("key"), pa.array(n_words), *floats], schema=_SCORES)

    return bags.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "id long, lang string, key binary, n_words long, perplexity double, peak double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, peak_quantile: float = PEAK_QUANTILE) -> DataFrame:
    """(id, lang, n_words, perplexity, peak, kept) for every document.

    A document is rejected if its perplexity, or its peak (that of its least likely word of PEAK_LETTERS letters or
    more, without punctuation and in small letters), is more than MARGIN times the threshold of its language: the
    quantile over trusted documents (quality 1, toxic 0) kept out of the model.  Null and empty texts have no
    perplexity and are kept, as is all text in a language that has no trusted documents; a null language is a language
    of its own.  A very long text is a block of its own and is scored whole.  Labels without a document, and null labels,
    play no part.  Repeated rows and ids give a row each, equal scores are judged alike; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    return _judged(docs, labels, id_col, text_col, lang_col, quantile, peak_quantile).drop("key")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float = QUANTILE, peak_quantile: float = PEAK_QUANTILE) -> DataFrame:
    """What classify returns, and the digest of the text as `key`."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("key", text_key(F.col("text")))
    done = checkpointed(scores(own, fit(own, labels)))
    held = done.join(_labelled(labels).filter("part = 'held'").select("id"), "id").filter("perplexity is not null")
    limits = held.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("most"), F.percentile_approx("peak", peak_quantile, 10000).alias("most_peak"))
    judged = done.join(few(limits), "lang", "left")
    bad = F.coalesce(F.col("perplexity") > MARGIN * F.col("most"), F.lit(False)) | F.coalesce(F.col("peak") > MARGIN * F.col("most_peak"), F.lit(False))
    return judged.select("id", "lang", "key", "n_words", "perplexity", "peak", (~bad).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that are not rejected, with their own columns; each row goes or stays by its own text and language."""
    gone = _judged(docs, labels, id_col, text_col, lang_col, **options).filter("not kept")
    gone = gone.select(F.col("id").alias("gone_id"), F.col("lang").alias("gone_lang"), F.col("key").alias("gone_key")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (F.coalesce(docs[lang_col].cast("string"), F.lit("")) == gone["gone_lang"]) & (text_key(docs[text_col]) == gone["gone_key"])
    return docs.join(gone, same, "left_anti")
