"""Rule-based extraction of vitals, prescriptions and narrative fields from dictated or recognised text.

The rules run inside an Arrow UDF, one call a batch of texts; filter and prune columns before applying it.  One automaton over
all drugs, triggers and section words of a language finds their places in a single pass, and a rule runs only where its word is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dispensary.functions.numbers import ENGLISH, FRENCH, WS, Numerals, rx
from dispensary.functions.text import fold_clinical_py
from dispensary.schemas import RANGES, VITALS


#: Patterns, each with the word that it needs.
Rules = list[tuple[str, re.Pattern]]


@dataclass(frozen=True)
class Locale:
    """A language pack: word lists, and rules as (pattern, meaning) tried in order; <N> stands for a number.

    In `frequency` and `duration` a meaning is a constant, a table from the matched word, or a function of the number
    and the match that returns None to go on to the next rule."""

    code: str
    numerals: Numerals
    vital_triggers: dict[str, tuple[str, ...]]
    bp_triggers: tuple[str, ...]
    bp_may_be_cm: bool
    diagnosis_triggers: tuple[str, ...]
    complaint_triggers: tuple[str, ...]
    section_words: tuple[str, ...]
    frequency: tuple
    duration: tuple
    dose_units: str
    formulary: tuple[str, ...]

    def pattern(self, text: str) -> re.Pattern:
        return rx(text.replace("<N>", f"({self.numerals.pattern})"))

    @cached_property
    def frequency_rules(self) -> list:
        return [(self.pattern(p), meaning) for p, meaning in self.frequency]

    @cached_property
    def duration_rules(self) -> list:
        return [(self.pattern(p), meaning) for p, meaning in self.duration]

    @cached_property
    def dose_rule(self) -> re.Pattern:
        return self.pattern(rf"<N><s>*({self.dose_units})\b")

    @cached_property
    def bp_rules(self) -> Rules:
        return [(t, self.pattern(rf"\b{t}\b[^\d\w]{{0,12}}<N><s>*(?:sur|over|/)<s>*<N>")) for t in self.bp_triggers]

    @cached_property
    def vital_rules(self) -> list[tuple[str, Rules]]:
        return [(k, [(t, self.pattern(rf"\b{re.escape(t)}\b[^\d\w]{{0,12}}(?:de<s>+|a<s>+|of<s>+|is<s>+)?<N>")) for t in ts]) for k, ts in self.vital_triggers.items()]

    @cached_property
    def words(self) -> tuple[str, ...]:
        """Whatever may end a narrative: drugs, triggers and section words."""
        return (*(t for ts in self.vital_triggers.values() for t in ts), *self.bp_triggers, *self.diagnosis_triggers, *self.complaint_triggers, *self.section_words, *self.formulary)

    @cached_property
    def boundary(self) -> re.Pattern:
        return rx(rf"\b(?:{'|'.join(map(re.escape, self.words))})\b")

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out, drugs = ahocorasick.Automaton(), set(self.formulary)
        for w in dict.fromkeys(self.words):
            out.add_word(w, (w, w in drugs))
        out.make_automaton()
        return out

    def places(self, folded: str) -> tuple[set[str], list[tuple[int, int]]]:
        """The words that stand in a text as whole words, and the places of drugs, in which a hyphen counts as a space."""
        spaced, there, drugs = folded.replace("-", " "), set(), []
        for last, (word, drug) in self.automaton.iter(spaced):
            start, stop = last - len(word) + 1, last + 1
            if start and _in_word(spaced[start - 1]) or stop < len(spaced) and _in_word(spaced[stop]):
                continue
            if drug:
                drugs.append((start, stop))
            if folded[start:stop] == word:
                there.add(word)
        return there, drugs

    def narrative_rules(self, triggers: tuple[str, ...]) -> Rules:
        return [(t, rx(rf"\b{re.escape(t)}\b<s>*:?<s>*([^.;\n]{{2,160}})")) for t in triggers]

    @cached_property
    def diagnosis_rules(self) -> Rules:
        return self.narrative_rules(self.diagnosis_triggers)

    @cached_property
    def complaint_rules(self) -> Rules:
        return self.narrative_rules(self.complaint_triggers)


def _in_word(c: str) -> bool:
    return c == "_" or c.isascii() and c.isalnum()


def _within(low: int, high: int, then=lambda x, m: x):
    return lambda x, m: then(x, m) if low <= x <= high else None


def _weeks(x, m):
    return x * 7


_PER_HOURS = _within(1, 24, lambda h, m: math.floor(24 / h + 0.5))

# The French pack.
FR = Locale(
    code="fr",
    numerals=FRENCH,
    vital_triggers={
        "oxygenSaturation": ("saturation en oxygene", "saturation", "spo2", "sao2", "sat"),
        "respiratoryRate": ("frequence respiratoire", "rythme respiratoire", "respiration"),
        "pulse": ("frequence cardiaque", "rythme cardiaque", "pouls"),
        "temperature": ("temperature", "fievre a", "temp"),
        "weight": ("poids", "pese"),
        "height": ("taille", "mesure"),
    },
    bp_triggers=("pression arterielle", "tension arterielle", "tension", "ta"),
    bp_may_be_cm=True,
    diagnosis_triggers=("diagnostic", "diagnostique", "impression"),
    complaint_triggers=("motif de consultation", "motif", "se plaint de", "vient pour", "plainte"),
    section_words=("prescrire", "prescription", "ordonnance", "donner", "traitement"),
    frequency=(
        ("<N><s>*fois<s>*par<s>*jour", _within(1, 12)),
        ("toutes?<s>+les<s>+<N><s>*heures?", _PER_HOURS),
        ("matin,?<s>*(?:et<s>*)?midi,?<s>*(?:et<s>*)?soir", 3),
        ("matin<s>*(?:,|et)<s>*soir", 2),
        (r"par<s>*jour|\bquotidien", 1),
    ),
    duration=(
        ("pendant<s>+<N><s>*semaines?", _weeks),
        ("pendant<s>+une<s>+semaine", 7),
        ("pendant<s>+<N><s>*jours?", _within(1, 365)),
    ),
    dose_units="mg|g|ml|ui|comprimes?|cuilleres?|gouttes?|sachets?",
    formulary=(
        "artemether lumefantrine", "sulfadoxine pyrimethamine", "amoxicilline acide clavulanique", "sels de rehydratation orale",
        "paracetamol", "ibuprofene", "aspirine", "artemether", "lumefantrine", "artesunate", "quinine", "amodiaquine",
        "sulfadoxine", "pyrimethamine", "amoxicilline", "ampicilline", "cotrimoxazole", "ciprofloxacine", "azithromycine",
        "doxycycline", "metronidazole", "gentamicine", "ceftriaxone", "albendazole", "mebendazole", "praziquantel",
        "ivermectine", "fer", "acide folique", "zinc", "vitamine a", "sels de rehydratation", "sro", "salbutamol",
        "prednisolone", "dexamethasone", "chlorphenamine", "promethazine", "omeprazole", "ranitidine", "isoniazide",
        "rifampicine", "ethambutol", "pyrazinamide", "oxytocine", "misoprostol", "magnesium",
    ),
)

# The English pack, with the prescribing abbreviations.
EN = Locale(
    code="en",
    numerals=ENGLISH,
    vital_triggers={
        "oxygenSaturation": ("oxygen saturation", "saturation", "spo2", "sao2", "sats", "sat"),
        "respiratoryRate": ("respiratory rate", "resp rate", "breathing rate", "rr"),
        "pulse": ("heart rate", "pulse rate", "pulse", "hr"),
        "temperature": ("temperature", "temp", "fever of"),
        "weight": ("weight", "weighs"),
        "height": ("height",),
    },
    bp_triggers=("blood pressure", "bp"),
    bp_may_be_cm=False,
    diagnosis_triggers=("diagnosis", "impression", "assessment"),
    complaint_triggers=("presenting complaint", "chief complaint", "complains of", "complaining of", "reason for visit", "came for", "c/o"),
    section_words=("prescribe", "prescription", "give", "treatment", "plan", "rx"),
    frequency=(
        ("<N><s>*times?<s>*(?:a|per|each)?<s>*day|<N><s>*times?<s>*daily", _within(1, 12)),
        (r"every<s>+<N><s>*(?:hours?|hrs?|h)\b", _PER_HOURS),
        (r"\b(od|om|on|nocte|mane|bd|bid|tds|tid|qds|qid|daily)\b", {"od": 1, "om": 1, "on": 1, "nocte": 1, "mane": 1, "daily": 1, "bd": 2, "bid": 2, "tds": 3, "tid": 3, "qds": 4, "qid": 4}),
        (r"\btwice\b", 2),
        (r"\bthrice\b", 3),
        (r"\bonce\b", 1),
        ("morning,?<s>*(?:and<s>*)?noon,?<s>*(?:and<s>*)?(?:night|evening)", 3),
        ("morning<s>*(?:,|and)<s>*(?:night|evening)", 2),
    ),
    duration=(
        (r"\b(\d{1,3})<s>*/<s>*(7|52)\b", _within(1, 365, lambda x, m: x * 7 if m[2] == "52" else x)),
        ("for<s>+<N><s>*weeks?", _weeks),
        ("for<s>+(?:a|one)<s>+week", 7),
        ("for<s>+<N><s>*days?", _within(1, 365)),
    ),
    dose_units="mg|g|ml|iu|units?|tablets?|tabs?|capsules?|caps?|drops?|sachets?|spoons?",
    formulary=(
        "artemether lumefantrine", "sulfadoxine pyrimethamine", "amoxicillin clavulanic acid", "oral rehydration salts",
        "paracetamol", "acetaminophen", "ibuprofen", "aspirin", "artemether", "lumefantrine", "artesunate", "quinine",
        "amodiaquine", "sulfadoxine", "pyrimethamine", "amoxicillin", "ampicillin", "cotrimoxazole", "ciprofloxacin",
        "azithromycin", "doxycycline", "metronidazole", "gentamicin", "ceftriaxone", "albendazole", "mebendazole",
        "praziquantel", "ivermectin", "iron", "folic acid", "zinc", "vitamin a", "ors", "salbutamol", "prednisolone",
        "dexamethasone", "chlorphenamine", "promethazine", "omeprazole", "ranitidine", "isoniazid", "rifampicin",
        "ethambutol", "pyrazinamide", "oxytocin", "misoprostol", "magnesium",
    ),
)

LOCALES = {"fr": FR, "en": EN}


def locale_for(lang: str | None) -> Locale:
    """English for `en`, French for everything else."""
    return EN if lang == "en" else FR


def _first_rule(rules: list, segment: str, numerals: Numerals):
    for pattern, meaning in rules:
        m = pattern.search(segment)
        if not m:
            continue
        said = next((g for g in m.groups() if g is not None), None)
        if isinstance(meaning, dict):
            return meaning[said]
        if not callable(meaning):
            return meaning
        value = numerals.parse(said.strip())
        if value is not None and (value := meaning(value, m)) is not None:
            return value
    return None


def _plausible(vital: str, value: float) -> bool:
    return RANGES[vital][0] <= value <= RANGES[vital][1]


_WHITE = "".join(c for c in map(chr, range(1 << 16)) if re.match(f"[{WS}]", c))


def _trim(s: str) -> str:
    return s.strip(_WHITE)


def _blood_pressure(loc: Locale, folded: str, there: set[str]):
    """(systolic, diastolic, confidence, span)"""
    for word, rule in loc.bp_rules:
        m = rule.search(folded) if word in there else None  # only the first place of a trigger counts
        if not m:
            continue
        high, low = (loc.numerals.parse(g) for g in m.groups())
        if high is None or low is None:
            continue
        confidence = 0.9
        if loc.bp_may_be_cm and high < 30:
            high, low, confidence = high * 10, low * 10, 0.8
        if _plausible("systolic", high) and _plausible("diastolic", low):
            return high, low, confidence, m.span()
    return None


def _scalar(loc: Locale, vital: str, rules: Rules, folded: str, there: set[str]):
    """(value, confidence, span); an implausible value leads to the next trigger, not to the next place."""
    for word, rule in rules:
        for m in rule.finditer(folded) if word in there else ():
            value = loc.numerals.parse(m[1])
            if value is None:
                continue
            if _plausible(vital, value):
                return value, 0.9 if m[1][0].isdigit() else 0.75, m.span()
            break
    return None


def _drug_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """At one place the longest drug counts, and none may overlap another."""
    kept: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda s: (s[0], s[0] - s[1])):
        if not kept or start >= kept[-1][1]:
            kept.append((start, end))
    return kept


def _prescriptions(loc: Locale, text: str, folded: str, found: list[tuple[int, int]], spans: list):
    drugs = _drug_spans(found)
    for i, (start, end) in enumerate(drugs):
        nxt = drugs[i + 1][0] if i + 1 < len(drugs) else len(folded)
        scope = re.split("[.;]", folded[end : min(end + 90, nxt)], maxsplit=1)[0]
        m = loc.dose_rule.search(scope)
        amount = loc.numerals.parse(m[1]) if m else None
        dose = None if amount is None else f"{amount} {m[2]}"
        often = _first_rule(loc.frequency_rules, scope, loc.numerals)
        days = _first_rule(loc.duration_rules, scope, loc.numerals)
        stop = end + len(scope)
        spans.append((start, stop))
        known = sum(x is not None for x in (dose, often, days))
        yield {"drug": _trim(text[start:end]), "dose": dose, "frequencyPerDay": often, "durationDays": days, "rawText": _trim(text[start:stop]), "confidence": 0.5 + 0.5 * (known / 3)}


def _narrative(loc: Locale, rules: Rules, text: str, folded: str, there: set[str], spans: list):
    for word, rule in rules:
        m = rule.search(folded) if word in there else None
        if not m:
            continue
        start, stop = m.span(1)
        if edge := loc.boundary.search(folded[start:stop]):
            stop = start + edge.start()
        value = _trim(text[start:stop])
        if stop - start >= 2 and value:
            spans.append((m.start(), stop))
            return {"value": value, "rawText": _trim(text[m.start() : stop]), "confidence": 0.8}
    return None


def _remainder(text: str, spans: list[tuple[int, int]]) -> str:
    pieces, at = [], 0
    for start, stop in sorted(spans, key=lambda s: s[0]):
        if start > at:
            pieces.append(text[at:start])
        at = max(at, stop)
    pieces.append(text[at:])
    kept = [p for p in map(_trim, pieces) if p.strip(_WHITE + ".;,:/-")]
    out = re.sub(f"[{WS}]*([.;,:])", r"\1", " ".join(kept))
    out = re.sub(f"([.;,:])[{WS}]*(?=[.;,:])", "", out)
    out = re.sub(f"[{WS}]{{2,}}", " ", out)
    return _trim(re.sub(f"^[{WS}.;,:-]+|[{WS}.;,:-]+$", "", out))


def extract_clinical(text: str, loc: Locale = FR) -> dict:
    """vitals, prescriptions, chiefComplaint, diagnosis, and the remainder that no rule claimed."""
    folded = fold_clinical_py(text)
    if len(folded) != len(text):  # lower-casing made a letter longer; offsets need equal lengths
        folded = "".join(f if len(f) == 1 else c for c, f in ((c, fold_clinical_py(c)) for c in text))
    spans: list[tuple[int, int]] = []
    vitals: dict[str, dict] = {}

    def note(vital, value, confidence, span):
        vitals[vital] = {"value": float(value), "rawText": _trim(text[span[0] : span[1]]), "confidence": confidence}

    there, drugs = loc.places(folded)
    if bp := _blood_pressure(loc, folded, there):
        note("systolic", bp[0], bp[2], bp[3])
        note("diastolic", bp[1], bp[2], bp[3])
        spans.append(bp[3])
    for vital, rules in loc.vital_rules:
        if hit := _scalar(loc, vital, rules, folded, there):
            note(vital, *hit)
            spans.append(hit[2])
    prescriptions = list(_prescriptions(loc, text, folded, drugs, spans))
    diagnosis = _narrative(loc, loc.diagnosis_rules, text, folded, there, spans)
    complaint = _narrative(loc, loc.complaint_rules, text, folded, there, spans)
    return {"vitals": {v: vitals.get(v) for v in VITALS}, "prescriptions": prescriptions, "chiefComplaint": complaint, "diagnosis": diagnosis, "remainder": _remainder(text, spans)}


_NUMBER, _TEXT = "struct<value:double,rawText:string,confidence:double>", "struct<value:string,rawText:string,confidence:double>"
EXTRACTION = f"""struct<vitals:struct<{",".join(f"{v}:{_NUMBER}" for v in VITALS)}>,
prescriptions:array<struct<drug:string,dose:string,frequencyPerDay:int,durationDays:int,rawText:string,confidence:double>>,
chiefComplaint:{_TEXT},diagnosis:{_TEXT},remainder:string>"""


#: Texts whose results are held at once: those of a whole Arrow batch take many times the memory of its texts.
CHUNK = 256


def extract_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The extractions of (texts, languages) in frames of CHUNK rows at most, whatever the size of a batch."""
    for texts, langs in batches:
        for at in range(0, len(texts), CHUNK):
            rows = [extract_clinical(t or "", locale_for(x)) for t, x in zip(texts.iloc[at : at + CHUNK], langs.iloc[at : at + CHUNK], strict=True)]
            yield pd.DataFrame(rows, columns=["vitals", "prescriptions", "chiefComplaint", "diagnosis", "remainder"])


def extraction(text: Column, lang: Column) -> Column:
    """The extraction of each text as a struct; a null text counts as empty."""

    @F.pandas_udf(EXTRACTION)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return extract_batches(batches)

    return run(text, lang)


def spoken_number(text: Column, lang: str) -> Column:
    """The value of a spoken number, null if it is none."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numerals = locale_for(lang).numerals
        for texts in batches:
            yield pd.Series([None if t is None else numerals.parse(t) for t in texts], dtype="float64")

    return run(text)
