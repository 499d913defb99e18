"""De-identification: pseudonyms, generalised dates and ages, and redaction of free text against the roster.

Redaction is a join, not a pattern over every term.  A text can only hold a term as whole words if it holds the term's first
run of word characters, so texts are folded and cut into runs, the runs are joined with those of the terms by hash, and a
row gets the terms that it may hold.  A bitmap of the terms' runs, of bounded size however large the roster is, goes to all
tasks first, and only runs that it may hold leave them.  Each term becomes a pattern that matches the unfolded text, and a row's patterns replace their places one after the other, the longest
first.  Fields of encounters say the same things again and again, so each distinct text of them is redacted once, and only texts
that change go back to their rows.  All of it are expressions.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.functions import clinical as C
from dispensary.functions.numbers import WS
from dispensary.functions.text import FOLDED_LETTERS, LETTERS_OF, WHITE, fold_names

REDACTED = "[…]"
LEVELS = ("identified", "pseudonymous", "anonymous")
REMOVED_FIELDS = ("givenName", "familyName", "birthDate", "phone", "address", "registerNo", "attachments")

#: Characters of a code: of one that a known salt gives again, and of one in an anonymous export, where no two of any number may meet.
CODE, ANONYMOUS_CODE = 8, 32

_WORD = "A-Za-z0-9_"


def _edge(word: str) -> str:
    """Between a character of the class and anything else."""
    return f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"


#: Bits of the map of the terms' runs: 16 MB in pieces of 4 kB, whatever the roster.
MAP_BITS = 27

# Phone numbers, and other long runs of digits.
_PHONE = rf"{_edge(_WORD)}(?:\+?261[{WS}.-]?)?0?[0-9]{{2}}[{WS}.-]?[0-9]{{2}}[{WS}.-]?[0-9]{{3}}[{WS}.-]?[0-9]{{2}}{_edge(_WORD)}"
_DIGITS = rf"{_edge(_WORD)}[0-9]{{7,}}{_edge(_WORD)}"
# What a text with one of them must hold.
_SOME_PHONE, _SOME_DIGITS = rf"[0-9]{{2}}[{WS}.-]?[0-9]{{2}}[{WS}.-]?[0-9]{{3}}", "[0-9]{7}"


def random_salt() -> str:
    return secrets.token_hex(16)


def roster_terms(patients: DataFrame) -> DataFrame:
    """(term, folded, length), distinct: the words of four characters or more of names, addresses and register numbers."""
    fields = F.array("familyName", "givenName", "address", "registerNo")
    values = patients.select(F.explode(F.filter(fields, lambda x: x.isNotNull() & (x != ""))).alias("t")).distinct()
    terms = values.select(F.explode(F.split("t", f"(?:{WHITE}|,)+")).alias("term")).filter(F.length("term") >= 4).distinct()
    return terms.select("term", fold_names(F.col("term")).alias("folded"), F.length("term").alias("length"))


def term_pattern(folded: Column) -> Column:
    """What a folded term looks like in texts: any letter that folds to one of its letters, as whole words."""
    letter = F.create_map(*[F.lit(x) for pair in LETTERS_OF.items() for x in pair])
    one = lambda c: F.coalesce(F.concat(F.lit("["), letter[c], F.lit("]")), F.when(c.rlike(f"[{_WORD}]"), F.concat(F.lit("["), c, F.upper(c), F.lit("]"))), F.concat(F.lit("(?:\\Q"), c, F.lit("\\E|\\Q"), F.upper(c), F.lit("\\E)")))
    # a boundary next to a letter that is known says what the other side must be
    inside = _WORD + FOLDED_LETTERS
    is_word = lambda c: c.rlike(f"[{_WORD}]")  # noqa: E731  folded letters are among these
    before = F.when(is_word(F.left(folded, F.lit(1))), f"(?<![{inside}])").otherwise(f"(?<=[{inside}])")
    after = F.when(is_word(F.right(folded, F.lit(1))), f"(?![{inside}])").otherwise(f"(?=[{inside}])")
    return F.concat(before, F.array_join(F.transform(F.regexp_extract_all(folded, F.lit("(?s)(.)")), one), ""), after)


def _marks(text: Column) -> Column:
    """How many redactions a text shows."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(REDACTED), F.lit("")))) / len(REDACTED)).cast("int")


def _by_patterns(text: Column, patterns: Column) -> Column:
    """(text, n redactions) after all patterns, one after the other.

    A redaction leaves its mark and takes none away, unless a term holds a sign of the mark; then places are counted."""
    start = F.struct(text.alias("text"), F.lit(0).alias("n"))

    odd = F.exists(patterns, lambda p: p.contains("…"))
    slow = F.aggregate(patterns, start, lambda s, p: F.struct(F.regexp_replace(s["text"], p, F.lit(REDACTED)).alias("text"), (s["n"] + F.coalesce(F.regexp_count(s["text"], p), F.lit(0))).alias("n")))
    fast = F.aggregate(patterns, text, lambda t, p: F.regexp_replace(t, p, F.lit(REDACTED)), lambda t: F.struct(t.alias("text"), F.coalesce(_marks(t) - _marks(text), F.lit(0)).alias("n")))
    return F.when(odd, slow).otherwise(fast)


def _numbers(done: Column) -> Column:
    """Phone numbers, then runs of seven digits and more, in what is left of each text."""

    def without(pattern: str, needs: str, done: Column) -> Column:
        found = lambda s: F.coalesce(F.regexp_count(s["text"], F.lit(pattern)), F.lit(0))
        return F.transform(done, lambda s: F.when(s["text"].rlike(needs), F.struct(F.regexp_replace(s["text"], F.lit(pattern), F.lit(REDACTED)).alias("text"), (s["n"] + found(s)).alias("n"))).otherwise(s))

    return without(_DIGITS, _SOME_DIGITS, without(_PHONE, _SOME_PHONE, done))


def _map_place(value: Column) -> tuple[Column, Column]:
    """Which piece of the map a value is in, and which bit of it."""
    at = F.xxhash64(value).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    return F.shiftright(at, 15), at.bitwiseAND(F.lit((1 << 15) - 1))


def _known(rows: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """The rows whose value of `by` the table may hold; what the map does not hold is in none."""
    piece, bit = _map_place(F.col(by))
    pieces = table.select(piece.alias("piece_"), bit.alias("bit_")).groupBy("piece_").agg(F.bitmap_construct_agg("bit_").alias("map_"))
    byte = F.conv(F.hex(F.substring(F.col("map_"), (F.floor(F.col("bit_") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = rows.withColumns({"piece_": piece, "bit_": bit}).join(F.broadcast(pieces), "piece_")  # 4 kB a piece, 2 ** (MAP_BITS - 15) pieces at most
    return met.filter(F.getbit(byte, (F.col("bit_") % 8).cast("int")) == 1).select(*rows.columns)


def scrubbed(rows: DataFrame, key: str, texts: Column, terms: DataFrame) -> DataFrame:
    """The rows with `clean`, an array of (text, n redactions) for the array `texts`; values of `key` are distinct.

    A row's terms are as many as its own words."""
    run = f"([{_WORD}]+)"
    own = rows.withColumn("texts_", texts)
    # a term without any word character can't stand between word boundaries
    t = terms.select("folded", F.regexp_extract("folded", run, 1).alias("run_")).filter("run_ <> ''").distinct()
    t = t.select("run_", F.struct((-F.length("folded")).alias("order"), "folded", term_pattern(F.col("folded")).alias("pattern")).alias("term_"))
    runs = own.select(F.col(key).alias("key_"), F.explode(F.array_distinct(F.flatten(F.transform(F.array_compact("texts_"), lambda x: F.regexp_extract_all(fold_names(x), F.lit(run)))))).alias("run_"))
    hits = _known(runs, t, "run_").join(t, "run_").groupBy("key_").agg(F.array_sort(F.collect_set("term_")).alias("terms_"))
    met = own.join(hits, F.col(key) == F.col("key_"), "left")
    patterns = F.coalesce(F.transform("terms_", lambda x: x["pattern"]), F.array().cast("array<string>"))
    clean = F.transform("texts_", lambda x: _by_patterns(x, patterns))
    return met.withColumn("clean", _numbers(clean)).drop("texts_", "terms_", "key_")


def _digest(text: Column) -> Column:
    return F.xxhash64(text)


def redacted(rows: DataFrame, key: str, texts: Column, terms: DataFrame) -> DataFrame:
    """The rows with `redacted`, a map of those of their texts that change to (text, n redactions); values of `key` are distinct.

    A text is scrubbed once, however many rows hold it.  A row without a key would keep its texts, and is refused."""
    named = F.coalesce(F.col(key), F.raise_error(f"texts of a row without {key} can't be redacted"))
    said = rows.select(named.alias("key_"), F.explode(F.array_distinct(F.array_compact(texts))).alias("said_"))
    # texts that share a digest get each other's terms and changes, too, which they don't hold and don't look up
    once = said.select("said_").distinct().withColumn("digest_", _digest(F.col("said_")))
    changed = scrubbed(once, "digest_", F.array("said_"), terms).select("digest_", "said_", F.col("clean")[0].alias("clean_")).filter("clean_.n > 0")
    met = _known(said.select("key_", _digest(F.col("said_")).alias("digest_")), changed, "digest_").join(changed, "digest_")
    found = met.groupBy("key_").agg(F.map_from_entries(F.collect_set(F.struct("said_", "clean_"))).alias("redacted"))
    return rows.join(found, F.col(key) == F.col("key_"), "left").drop("key_")


def scrub(texts: DataFrame, terms: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, text, redactions) for (key, text), whose keys are distinct.  `terms` is what roster_terms gives."""
    own = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return scrubbed(own, "key", F.array("text"), terms).select("key", F.col("clean")[0]["text"].alias("text"), F.col("clean")[0]["n"].alias("redactions"))


def deid_patients(patients: DataFrame, salt: str, as_of_ms: int, characters: int = CODE) -> DataFrame:
    """Patients under their codes, without identifiers, with their age at `as_of_ms`, 90 at most."""
    code = C.pseudonym(F.col("id"), F.lit(salt), characters)
    age = C.cap_age(C.patient_age(F.col("birthDate"), F.col("approximateAge"), F.lit(as_of_ms)))
    none = F.lit(None)
    new = {"id": code, "familyName": code, "givenName": F.lit(""), "searchKey": F.lower(code), "approximateAge": age} | dict.fromkeys(("birthDate", "birthDatePrecision", "phone", "address", "registerNo", "syncedAt"), none)
    return patients.select([new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name) for f in patients.schema])


def deid_encounters(encounters: DataFrame, patients: DataFrame, salt: str, generalise_dates: bool, strict: bool = False, characters: int = CODE) -> tuple[DataFrame, DataFrame]:
    """(encounters, (id, redactions)): the patient's code or UNKNOWN, scrubbed texts, no attachments.

    Prescriptions and encounter ids stay as they are; `strict` scrubs the prescriptions' notes and codes the ids too."""
    known = patients.select(F.col("id").alias("patientId"), C.pseudonym(F.col("id"), F.lit(salt), characters).alias("code"))
    plain = ("chiefComplaint", "diagnosis", "notes")
    none = F.array().cast("array<string>")
    listed = F.concat(F.array(*plain), F.coalesce(F.transform(F.map_values("provenance"), lambda v: v["rawText"]), none))
    if strict:
        listed = F.concat(listed, F.coalesce(F.transform("prescriptions", lambda p: p["notes"]), none))
    out = redacted(encounters, "id", listed, roster_terms(patients)).join(known, "patientId", "left")
    done = lambda text: F.try_element_at("redacted", text)
    clean = lambda text: F.coalesce(done(text)["text"], text)
    new = {c: clean(F.col(c)) for c in plain}
    new["patientId"] = F.coalesce("code", F.lit("UNKNOWN"))
    new["provenance"] = F.transform_values("provenance", lambda _, v: v.withField("rawText", clean(v["rawText"])))
    new["attachmentIds"] = none
    new["syncedAt"] = F.lit(None).cast("long")
    if generalise_dates:
        new["occurredAt"] = C.month_start(F.col("occurredAt"))
    if strict:
        new["id"] = C.pseudonym(F.col("id"), F.lit(salt), characters)
        new["prescriptions"] = F.transform("prescriptions", lambda p: p.withField("notes", clean(p["notes"])))
    rows = out.select([new[c].alias(c) if c in new else F.col(c) for c in encounters.columns])
    return rows, out.select("id", F.aggregate(listed, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(done(x)["n"], F.lit(0))).alias("redactions"))


def deidentify(patients: DataFrame, encounters: DataFrame, level: str, as_of_ms: int, salt: str | None = None, generalise_dates: bool | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patients, encounters, manifest of one row) at level identified, pseudonymous or anonymous.

    An anonymous export always gets a fresh salt, and codes of 32 characters; the salt is drawn once, here, so that retried tasks agree."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    counts = patients.agg(F.count("*").alias("patientsProcessed")).crossJoin(encounters.agg(F.count("*").alias("encountersProcessed")))  # one row each
    facts = lambda dates, removed: counts.select(F.lit(level).alias("level"), F.lit(dates).alias("generalisedDates"), "patientsProcessed", "encountersProcessed", F.array(*map(F.lit, removed)).cast("array<string>").alias("fieldsRemoved"))
    if level == "identified":
        return patients, encounters, facts(False, ()).withColumn("freeTextRedactions", F.lit(0).cast("long"))
    if level == "anonymous" or salt is None:
        salt = random_salt()
    dates = level == "anonymous" if generalise_dates is None else generalise_dates
    characters = ANONYMOUS_CODE if level == "anonymous" else CODE
    rows, redactions = deid_encounters(encounters, patients, salt, dates, strict, characters)
    manifest = facts(dates, REMOVED_FIELDS).crossJoin(redactions.agg(F.coalesce(F.sum("redactions"), F.lit(0)).alias("freeTextRedactions")))  # one row each
    return deid_patients(patients, salt, as_of_ms, characters), rows, manifest
