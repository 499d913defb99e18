import random

import pytest

LETTERS = ["ka", "lo", "mi", "ré", "ßu", "The", "and", "x9", "ō"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(1, 3))) for _ in range(n))


def texts():
    """Odd texts, copies, near copies and shared passages."""
    r = random.Random(5)
    passage, long_ = prose(1, 60), prose(2, 6000)
    out = [None, "", "   \n\t ", "one", "one two three", "ONE two three", "a b c", "  two  leading  spaces ", "▁mark▁ in ▁text", "tab\tline\nfeed\r\nend ", "<|endoftext|> x <|startoftext|>", "日本語テキスト 🙂🙂 é ﬁ Å", "x" * 5000, "the " * 300, "the\n" * 45]
    out += [passage, passage, passage.upper(), passage + " " + prose(3, 40), prose(4, 30) + " " + passage + " " + prose(5, 10), long_, long_]
    base = prose(6, 120).split()
    for k in range(12):  # near copies, some linked only through others
        words = list(base)
        for _ in range(k):
            words[r.randrange(len(words))] = f"new{r.randrange(99)}"
        out.append(" ".join(words))
    out += ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. cc by cc by", "MIT License and Apache  License; apache license", "gnu general public", "cc", "license mit"]
    out += [prose(50 + k, r.randint(1, 80)) for k in range(25)]
    return out


@pytest.fixture(scope="session")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, id long, block string, kept int, found string, n_words string, body int, bucket int, cls int, n_chars long"
    return spark.createDataFrame([(i, t, "en", 7, "b", 1, "f", "n", 2, 3, 4, None if t is None else len(t)) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
