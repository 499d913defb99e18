import json

import pytest

from dispensary.functions.extract import EN, FR, extract_clinical, locale_for
from dispensary.functions.numbers import ENGLISH, FRENCH


@pytest.mark.parametrize(
    ("said", "value"),
    [("38,5", 38.5), ("38.5", 38.5), ("soixante-dix-sept", 77), ("quatre-vingts", 80), ("quatre-vingt-dix", 90), ("quatre-vingt-douze", 92), ("vingt et un", 21), ("cent vingt", 120), ("deux mille", 2000),
     ("trente-sept virgule vingt-cinq", 37.25), ("trente-huit et demi", 38.5), ("trente-huit virgule zéro cinq", 38.5), ("bonjour", None), ("", None), ("et", None)],
)
def test_french_numbers(said, value):
    assert FRENCH.parse(said) == value


@pytest.mark.parametrize(("said", "value"), [("one hundred and twenty", 120), ("a hundred", 100), ("thirty-eight point five", 38.5), ("thirty eight and a half", 38.5), ("two thousand", 2000), ("hello", None)])
def test_english_numbers(said, value):
    assert ENGLISH.parse(said) == value


def values(text, loc=FR):
    return {k: v["value"] for k, v in extract_clinical(text, loc)["vitals"].items() if v}


def test_french_dictation():
    r = extract_clinical("Température trente-huit virgule cinq, pouls quatre-vingt-douze, tension douze sur huit, poids soixante-cinq kilos. Prescrire artéméther-luméfantrine matin et soir pendant trois jours, paracétamol 500 mg trois fois par jour pendant cinq jours.")
    assert {k: v["value"] for k, v in r["vitals"].items() if v} == {"temperature": 38.5, "pulse": 92, "systolic": 120, "diastolic": 80, "weight": 65}
    assert r["vitals"]["systolic"]["confidence"] == 0.8 and r["vitals"]["temperature"]["confidence"] == 0.75
    first, second = r["prescriptions"]
    assert (first["drug"], first["frequencyPerDay"], first["durationDays"], first["dose"]) == ("artéméther-luméfantrine", 2, 3, None)
    assert (second["dose"], second["frequencyPerDay"], second["durationDays"], second["confidence"]) == ("500 mg", 3, 5, 1.0)


def test_english_dictation():
    r = extract_clinical("BP 120 over 80, temp 38.5. Give amoxicillin 500 mg tds for 5/7; paracetamol every 8 hours for one week; zinc bd 2/52.", EN)
    assert [(p["drug"], p["dose"], p["frequencyPerDay"], p["durationDays"]) for p in r["prescriptions"]] == [("amoxicillin", "500 mg", 3, 5), ("paracetamol", None, 3, 7), ("zinc", None, 2, 14)]
    assert r["vitals"]["systolic"]["confidence"] == 0.9


def test_implausible_values_are_refused():
    assert values("Température 385") == {}
    assert values("BP 12 over 8", EN) == {}
    assert values("température 385. temp 38") == {"temperature": 38}


def test_narrative_stops_at_the_next_section():
    r = extract_clinical("Motif fièvre depuis trois jours Température 38.9 Diagnostic paludisme simple prescrire zinc")
    assert r["chiefComplaint"]["value"] == "fièvre depuis trois jours"
    assert r["diagnosis"]["value"] == "paludisme simple"


def test_known_oddities():
    assert extract_clinical("Give zinc on tray", EN)["prescriptions"][0]["frequencyPerDay"] == 1
    assert extract_clinical("zinc 2.5 mg")["prescriptions"][0]["dose"] is None
    assert extract_clinical("zinc 20 fois par jour")["prescriptions"][0]["frequencyPerDay"] == 1
    assert extract_clinical("zinc toutes les 16 heures")["prescriptions"][0]["frequencyPerDay"] == 2
    assert extract_clinical("tout va bien.")["remainder"] == "tout va bien"
    assert extract_clinical("") == {"vitals": dict.fromkeys(extract_clinical("")["vitals"]), "prescriptions": [], "chiefComplaint": None, "diagnosis": None, "remainder": ""}
    assert (locale_for("mg"), locale_for("en"), locale_for(None)) == (FR, EN, FR)


def test_longest_drug_wins():
    drugs = [p["drug"] for p in extract_clinical("artemether lumefantrine, artemether")["prescriptions"]]
    assert drugs == ["artemether lumefantrine", "artemether"]
    assert json.dumps(drugs)


def test_results_of_a_batch_are_held_in_chunks():
    """Of a batch of any size few results are in memory at once, and none is lost or moved."""
    import pandas as pd

    from dispensary.functions.extract import CHUNK, extract_batches

    texts = [f"Pouls {60 + k % 90}" for k in range(3 * CHUNK + 5)]
    frames = list(extract_batches(iter([(pd.Series(texts), pd.Series(["fr"] * len(texts))), (pd.Series([], dtype="object"), pd.Series([], dtype="object"))])))
    assert max(map(len, frames)) == CHUNK
    assert [v["pulse"]["value"] for f in frames for v in f["vitals"]] == [60.0 + k % 90 for k in range(len(texts))]
