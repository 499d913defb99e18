"""Spelling variants of words: a rare-first prefix filter over positional bigrams, then verification.

Words are counted over all documents.  Bigrams are ordered by the number of places that they have in the distinct
words, rarest first, and a word is posted under its three rarest bigrams with their positions: one edit touches two
bigrams at most, so two words that are one edit apart have one of these three in common, at the same position or, with
an insertion, one further on.  The edit also lies in one half of the shorter word, so the other half is the same in both;
postings carry both halves, which splits the lists of bigrams that many words share.  Pairs that meet are verified.

All of it is expressions and equi-joins.  A word has a bounded number of words at one edit, so no list of partners grows
with the table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.llm._spark import checkpointed

#: A run of letters, and one document in how many loses a letter of a word (see respelt).
LETTERS, ONE_IN = "[A-Za-z\\u00C0-\\u00FF]+", 199
#: Bigrams that a word is posted under: two for each edit, and one.
PREFIX = 3


def lowered(run: Column) -> Column:
    """With A-Z in lower case, and no other letter."""
    plain = F.octet_length(run) == F.length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def respelt(doc_id: Column, run: Column, one_in: int = ONE_IN) -> Column:
    """The run, without one of its letters where the digest h of `doc_id:run` is divisible by `one_in`: that at h % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str, text_col: str, shortest: int, least: int, one_in: int) -> DataFrame:
    """(word, n) of the words with `shortest` letters and `least` places."""
    runs = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    # a run shorter than a word cannot become one
    words = runs.filter(F.length("run") >= shortest).select("id", lowered(F.col("run")).alias("run")).select(respelt(F.col("id"), F.col("run"), one_in).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _bigrams(words: DataFrame) -> DataFrame:
    place = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    return words.select("word", "n", place.alias("place")).withColumn("gram", F.substring("word", F.col("place"), 2))


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, gram, place): the PREFIX rarest bigrams of each word, in one order for all words."""
    grams = _bigrams(words)
    known = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("places")))  # 90 letters squared at most
    key = F.struct("places", "gram", "place")
    ordered = grams.join(known, "gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(key)).alias("all"))  # as long as the word
    return ordered.select("word", "n", F.explode(F.slice("all", 1, PREFIX)).alias("b")).select("word", "n", "b.gram", "b.place")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all words that are one edit apart, in both directions; words have four letters at least."""
    posts = rarest_bigrams(words)
    size = F.length("word")

    def posted(shorter: Column, shift: int, name: str) -> DataFrame:
        half = F.floor(shorter / 2).cast("int")
        halves = F.array(F.concat(F.lit("<"), F.left("word", half)), F.concat(F.lit(">"), F.right("word", half)))
        return posts.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), shorter.alias("size"), "gram", (F.col("place") - shift).alias("place"), F.explode(halves).alias("half"))

    key = ["size", "gram", "place", "half"]
    same = posted(size, 0, "a").join(posted(size, 0, "b"), key).filter("a < b")
    longer = posted(size - 1, 0, "b").unionByName(posted(size - 1, 1, "b"))
    more = posted(size, 0, "a").join(longer, key)
    pairs = same.unionByName(more).filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the form of the form, and so on, to one without a form.

    Each round doubles how far a word sees, and forms have several times the places of their words, so rounds are few."""
    links = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(further, "root", "left_semi").isEmpty():
            return links
        links = checkpointed(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_groups(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, one_in: int = ONE_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word with `shortest` letters and `least` places.

    Words are maximal runs of letters a-z and U+00C0 to U+00FF after lower-casing A-Z, some of which lose a letter (see
    respelt).  n counts a word's places in all documents, n_near the words at one inserted, deleted or replaced letter.
    The form of a word is the near word with the most places, the smallest of equals, if it has `times` as many;
    else null, as is form_n.  The root is where the forms of forms end, or the word itself.  Null and empty texts have no
    words, a null id is written as nothing, very long texts and runs are taken whole, repeated rows count again, and an empty
    table gives an empty result.  Other columns, whatever their names, are ignored."""
    if shortest < 4:
        raise ValueError("shorter words may have no bigram in common with their variants")
    words = checkpointed(word_counts(docs, id_col, text_col, shortest, least, one_in))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = checkpointed(near.select("word", "n_near", F.when(-F.col("best.minus") >= times * F.col("n"), F.struct(F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("f")).select("word", "n_near", "f.form", "f.form_n"))
    out = words.join(near, "word", "left").join(roots(near.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
