"""Text expressions: folds, search keys, labels and formats."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispensary.functions.clinical import lookup
from dispensary.schemas import RANGES

# Accented letters by the letter that they are folded to.
_FOLDS = {"a": "àáâãäå", "e": "èéêë", "i": "ìíîï", "o": "òóôõö", "u": "ùúûü", "c": "ç"}
_MORE_FOLDS = {"n": "ñ", "y": "ÿý"}
_LIGATURES = {"e": "œ", "a": "æ"}
#: White space as JavaScript's \s has it.
WHITE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


#: What fold_names changes to each letter, that letter included, large and small; two signs have small letters among these.
LETTERS_OF = {to: to + to.upper() + "".join(x + x.upper() for x in letters) for to, letters in _FOLDS.items()} | {"k": "kK\u212a"}
LETTERS_OF["a"] += "\u212b"
#: The letters that fold_names changes to ASCII ones, large and small, and two signs whose small letters are among these.
FOLDED_LETTERS = "".join(x + x.upper() for letters in _FOLDS.values() for x in letters) + "\u212a\u212b"


def _table(*folds: dict[str, str]) -> tuple[str, str]:
    pairs = [(x, to) for f in folds for to, letters in f.items() for x in letters]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _translate(c: Column, *folds: dict[str, str]) -> Column:
    return F.translate(c, *_table(*folds))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


#: Letters by the letter that they are without the marks of the Latin, Greek and Cyrillic alphabets, as Unicode takes them apart.
_UNMARKED: dict[str, str] = {}
for _x in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), 0x212A, 0x212B)):
    _plain = "".join(c for c in unicodedata.normalize("NFD", _x.lower()) if not "\u0300" <= c <= "\u036f")
    if len(_x.lower()) == len(_plain) == 1 and _x.lower() != _plain:
        _UNMARKED[_plain] = _UNMARKED.get(_plain, "") + _x.lower()


def strip_marks(c: Column) -> Column:
    """Lower case without marks, precomposed or combining, in alphabets that have precomposed letters."""
    return F.regexp_replace(_translate(F.lower(c), _UNMARKED), "[\\u0300-\\u036F]", "")


def normalise(c: Column) -> Column:
    return trim(strip_marks(c))


def search_key(family: Column, given: Column, register_no: Column, phone: Column) -> Column:
    blank = F.lit("")
    return F.regexp_replace(normalise(F.concat_ws(" ", *[F.coalesce(x, blank) for x in (family, given, register_no, phone)])), f"{WHITE}+", " ")


def fold_clinical(c: Column) -> Column:
    """The fold of the extractor; keeps the length."""
    return _translate(F.lower(c), _FOLDS, _MORE_FOLDS, _LIGATURES)


def fold_names(c: Column) -> Column:
    """The fold of redaction: fewer letters; keeps the length."""
    return _translate(F.lower(c), _FOLDS)


_CLINICAL = str.maketrans(*_table(_FOLDS, _MORE_FOLDS, _LIGATURES))


def fold_clinical_py(s: str) -> str:
    return s.lower().translate(_CLINICAL)


def short_code(id_: Column) -> Column:
    return F.upper(F.substring(F.replace(id_, F.lit("-"), F.lit("")), 1, 6))


def initials(family: Column, given: Column) -> Column:
    both = F.upper(F.concat(*[F.substring(trim(F.coalesce(x, F.lit(""))), 1, 1) for x in (family, given)]))
    return F.when(both == "", "?").otherwise(both)


# Palette of initials, in order.
PALETTE = ("teal", "sky", "indigo", "violet", "fuchsia", "rose", "cyan", "blue")


def avatar_colour(seed: Column) -> Column:
    """Palette entry by a 31-hash over the characters, wrapped to 32 bits at every step."""
    chars = F.transform(F.split(seed, ""), lambda c: F.ascii(c))
    wrapped = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: wrapped(acc * 31 + c))
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.abs(F.when(seed == "", F.lit(0).cast("long")).otherwise(h)) % len(PALETTE) + 1).cast("int"))


def truncate(c: Column, most: int = 90) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), f"{WHITE}+$", ""), F.lit("…")))


def format_vital(vital: str, value: Column) -> Column:
    """Fixed decimals and unit; rounding works on the exact binary value, as toFixed does."""
    _, _, unit, decimals = RANGES[vital]
    return F.concat(F.round(value.cast("decimal(30,20)"), decimals).cast("string"), F.lit(f" {unit}"))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" kB")))
        .otherwise(F.concat(F.round((n / 1048576).cast("decimal(30,20)"), 1).cast("string"), F.lit(" MB")))
    )


# Short month names; Malagasy uses the French ones.
MONTHS = {
    "fr": ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."),
    "en": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec"),
}


def format_date(at_ms: Column, lang: str) -> Column:
    """dd month yyyy in the session's time zone."""
    t = F.timestamp_millis(at_ms)
    return F.concat(F.date_format(t, "dd"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS["en" if lang == "en" else "fr"])), F.month(t)), F.lit(" "), F.date_format(t, "yyyy"))


def format_date_time(at_ms: Column, lang: str) -> Column:
    """The date, and hours and minutes."""
    return F.concat(format_date(at_ms, lang), F.lit(", " if lang == "en" else " "), F.date_format(F.timestamp_millis(at_ms), "HH:mm"))


# Malagasy numerals of times.
MALAGASY_TIMES = {"1": "indray mandeha", "2": "indroa", "3": "intelo", "4": "inefatra", "5": "indimy", "6": "inenina"}


def prescription_instruction(drug: Column, dose: Column, frequency: Column, days: Column, lang: str) -> Column:
    """Drug, dose, times a day and days, joined by commas; absent and zero parts are left out."""
    n, d = frequency.cast("string"), days.cast("string")
    plural = lambda x: F.when(x > 1, "s").otherwise("")
    if lang == "mg":
        often, long_ = F.concat(lookup(n, MALAGASY_TIMES, F.concat(F.lit("in-"), n)), F.lit(" isan'andro")), F.concat(F.lit("mandritra ny "), d, F.lit(" andro"))
    elif lang == "en":
        often, long_ = F.concat(n, F.lit(" time"), plural(frequency), F.lit(" per day")), F.concat(F.lit("for "), d, F.lit(" day"), plural(days))
    else:
        often, long_ = F.concat(n, F.lit(" fois par jour")), F.concat(F.lit("pendant "), d, F.lit(" jour"), plural(days))
    return F.concat_ws(", ", drug, F.nullif(dose, F.lit("")), F.when(frequency != 0, often), F.when(days != 0, long_))


def provenance_label(key: Column, labels: dict[str, str]) -> Column:
    """`labels` names the vitals, drug, chiefComplaint, diagnosis and notes; unknown keys stay as they are."""
    vital = F.when(key.startswith("vitals."), F.substring(key, 8, 1000))
    named = lookup(vital, {v: labels[v] for v in RANGES if v in labels}, key)
    fields = {f: labels[f] for f in ("chiefComplaint", "diagnosis", "notes") if f in labels}
    return F.when(vital.isNotNull(), named).when(key.startswith("prescription."), F.lit(labels["drug"])).otherwise(lookup(key, fields, key))


def flatten_lines(c: Column) -> Column:
    """Recognised text on one line."""
    one = F.regexp_replace(c, f"{WHITE}*\\n{WHITE}*", " ")
    return trim(F.regexp_replace(one, f"{WHITE}{{2,}}", " "))


def doubtful_words(words: Column) -> Column:
    """Of (text, confidence) the texts under 70 that are longer than one character."""
    return F.transform(F.filter(words, lambda w: (w["confidence"] < 70) & (F.length(trim(w["text"])) > 1)), lambda w: w["text"])


def clamp_confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.4), F.least(F.lit(1.0), c))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
