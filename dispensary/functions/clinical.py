"""Clinical and reporting expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dispensary.schemas import RANGES, SEVERITY

#: Milliseconds in a Julian year.
YEAR_MS = 31_557_600_000

# Indicators in the order in which they are tried.  A boundary (?<!...)(?!...) is ASCII.
_WORD = "(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"
INDICATORS = (
    ("malaria", ("palud", _WORD.format("palu"), "malaria")),
    ("ari", ("pneumon", "bronch", "infection respiratoire", _WORD.format("ira"))),
    ("diarrhoea", ("diarrh", "gastro", "cholera", "choléra")),
    ("malnutrition", ("malnutrition", "kwashiorkor", "marasme")),
    ("tuberculosis", ("tubercul", _WORD.format("tb"))),
    ("hypertension", ("hypertension", _WORD.format("hta"))),
)

# Indicator names by language; reports use the French ones.
INDICATOR_LABELS = {
    "fr": {"consultations": "Consultations", "malaria": "Paludisme", "ari": "Infection respiratoire aiguë", "diarrhoea": "Diarrhée", "malnutrition": "Malnutrition", "tuberculosis": "Tuberculose", "hypertension": "Hypertension", "other": "Autre"},
    "en": {"consultations": "Consultations", "malaria": "Malaria", "ari": "Acute respiratory infection", "diarrhoea": "Diarrhoea", "malnutrition": "Malnutrition", "tuberculosis": "Tuberculosis", "hypertension": "Hypertension", "other": "Other"},
    "mg": {"consultations": "Fitsaboana", "malaria": "Tazomoka", "ari": "Aretin’ny fofonaina", "diarrhoea": "Fivalanana", "malnutrition": "Tsy fahampian-tsakafo", "tuberculosis": "Raboka", "hypertension": "Tosidra avo", "other": "Hafa"},
}


def lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    """A constant table as CASE, so that it stays in generated code."""
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(None).cast("string"))).otherwise(otherwise)


def patient_age(birth_date: Column, approximate_age: Column, at_ms: Column) -> Column:
    """Whole Julian years from midnight UTC of the birth date, else the approximate age; may be negative."""
    born = F.unix_date(birth_date.try_cast("date")).cast("long") * 86_400_000
    return F.coalesce(F.floor((at_ms - born) / YEAR_MS), approximate_age.cast("long"))


def age_band(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age < 1, "<1").when(age < 5, "1-4").when(age < 15, "5-14").when(age < 50, "15-49").otherwise("50+")


def cap_age(age: Column) -> Column:
    return F.when(age >= 90, F.lit(90)).otherwise(age)


def classify_diagnosis(text: Column) -> Column:
    """The first indicator with a match; Unicode case folding, ASCII word boundaries."""
    c = F.when(F.coalesce(text, F.lit("")) == "", "other")
    for key, patterns in INDICATORS:
        c = c.when(text.rlike("(?iu)" + "|".join(patterns)), key)
    return c.otherwise("other")


def indicator_label(key: Column, lang: str = "fr") -> Column:
    return lookup(key, INDICATOR_LABELS[lang], key)


def sex_label(sex: Column) -> Column:
    return F.when(sex == "female", "F").when(sex == "male", "M").otherwise("?")


def vital_severity(vital: str, value: Column) -> Column:
    """normal, watch or urgent; null without a value."""
    if vital not in SEVERITY:
        return F.when(value.isNotNull(), "normal")
    c = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, (high, low) in zip(("urgent", "watch"), SEVERITY[vital], strict=True):
        tests = [t for t in (value >= high if high is not None else None, value < low if low is not None else None) if t is not None]
        c = c.when(reduce(lambda a, b: a | b, tests), name)
    return c.otherwise("normal")


def worst_severity(vitals: str = "vitals") -> Column:
    """The worst of the eight, normal if there are none."""
    ranks = [lookup(vital_severity(v, F.col(f"{vitals}.{v}")), {"normal": "0", "watch": "1", "urgent": "2"}, F.lit(None).cast("string")) for v in RANGES]
    return lookup(F.coalesce(F.greatest(*ranks), F.lit("0")), {"0": "normal", "1": "watch", "2": "urgent"}, F.lit(None).cast("string"))


def plausible(vital: str, value: Column) -> Column:
    low, high, _, _ = RANGES[vital]
    return value.between(low, high)


def has_any_vital(vitals: str = "vitals") -> Column:
    return F.coalesce(*[F.col(f"{vitals}.{v}") for v in RANGES]).isNotNull()


def period(at_ms: Column) -> Column:
    """yyyyMM in the session's time zone."""
    return F.date_format(F.timestamp_millis(at_ms), "yyyyMM")


def month_start(at_ms: Column) -> Column:
    """First instant of the month in the session's time zone."""
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(at_ms)))


def total_doses(frequency: Column, days: Column) -> Column:
    return F.nullif(frequency, F.lit(0)).cast("long") * F.nullif(days, F.lit(0))


def dosing_slots(frequency: Column) -> Column:
    """(morning, midday, night) for one to three doses a day; empty above, null without a frequency."""
    pattern = {1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 1, 1)}
    c = F.when(F.coalesce(frequency, F.lit(0)) == 0, F.lit(None).cast("array<int>"))
    for n, slots in pattern.items():
        c = c.when(frequency == n, F.array(*map(F.lit, slots)))
    return c.otherwise(F.array().cast("array<int>"))


def pseudonym(id_: Column, salt: Column, characters: int = 8) -> Column:
    """As many characters, 32 at most, from the first bytes of SHA-256 over `salt:id`, each modulo 30.

    Eight are told apart among some ten thousand ids; a million share one with even chance."""
    alphabet = "0123456789BCDFGHJKLMNPQRSTVWXZ"  # fixed value: digits and consonants
    digest = F.sha2(F.concat(salt, F.lit(":"), id_), 256)
    parts = [F.substr(F.lit(alphabet), (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % len(alphabet)) + 1, F.lit(1)) for i in range(characters)]
    return F.concat(*parts)
