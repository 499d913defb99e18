"""The derived tables as SQL common table expressions, for checking results on another engine."""

from __future__ import annotations

from dispensary.sources.testdata import DIAGNOSES, DRUGS, FAMILY_NAMES


def case(key: str, values: tuple) -> str:
    """values[key % n]"""
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


PATIENTS = f"""patients AS (
  SELECT 'p' || k AS id, CASE WHEN k % 6 <> 5 THEN CAST(k + 2000 AS VARCHAR) END AS "registerNo",
    CASE WHEN k % 7 = 0 THEN '' ELSE 'Voahirana' END AS "givenName", {case("k", FAMILY_NAMES)} AS "familyName",
    {case("k", ("female", "male", "unknown"))} AS sex,
    CASE WHEN k % 4 <> 0 THEN CAST(DATE '1920-01-01' + CAST((k * 37) % 29800 AS INTEGER) AS VARCHAR) END AS "birthDate",
    CASE WHEN k % 4 <> 0 THEN 'day' END AS "birthDatePrecision",
    CASE WHEN k % 8 = 4 THEN k % 100 END AS "approximateAge",
    CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN '' ELSE '034 ' || (k % 90 + 10) || ' 345 67' END AS phone,
    CASE WHEN k % 10 <> 3 THEN n_name END AS address, {case("k", ("fr", "mg", "en"))} AS "preferredLang",
    k * 1000 + 1600000000000 AS "createdAt", (k * 7919) % 100000 * 1000 + 1600000000000 AS "updatedAt",
    CASE WHEN k % 4 <> 1 THEN (k * 7919) % 100000 * 1000 + 1600000000000 END AS "syncedAt",
    CASE WHEN k % 50 = 49 THEN 1 END AS "deletedAt", k
  FROM (SELECT c_custkey AS k, c_nationkey FROM customer) LEFT JOIN nation ON n_nationkey = c_nationkey),
keyed AS (SELECT *, regexp_replace(trim(strip_accents(lower("familyName" || ' ' || "givenName" || ' ' || coalesce("registerNo", '') || ' ' || coalesce(phone, '')))), '\\s+', ' ', 'g') AS "searchKey" FROM patients)"""

VISITS = f"""visits AS (
  SELECT 'e' || k AS id, CASE WHEN k % 97 = 0 THEN 'ghost' ELSE 'p' || c END AS "patientId", started AS "occurredAt",
    CASE WHEN k % 6 = 1 THEN '' WHEN k % 6 <> 0 THEN 'fievre depuis ' || (k % 9 + 1) || ' jours' END AS "chiefComplaint",
    CASE WHEN k % 5 <> 0 THEN 'vu par ' || {case("k", FAMILY_NAMES)} || ' le ' || (k % 28 + 1) END AS notes,
    {case("k", DIAGNOSES)} AS diagnosis,
    CASE WHEN k % 3 <> 0 THEN 34 + CAST(k % 71 AS DOUBLE) / 10 END AS temperature,
    CASE WHEN k % 4 <> 1 THEN CAST(k % 101 + 40 AS DOUBLE) END AS pulse,
    CASE WHEN k % 5 <> 2 THEN CAST(k % 111 + 80 AS DOUBLE) END AS systolic,
    CASE WHEN k % 5 NOT IN (2, 3) THEN CAST(k % 81 + 45 AS DOUBLE) END AS diastolic,
    CASE WHEN k % 6 NOT IN (1, 2) THEN CAST(k % 40 + 6 AS DOUBLE) END AS "respiratoryRate",
    CASE WHEN k % 8 <> 5 THEN 3 + CAST(k % 900 AS DOUBLE) / 10 END AS weight,
    CASE WHEN k % 9 <> 4 THEN CAST(k % 150 + 40 AS DOUBLE) END AS height,
    CASE WHEN k % 7 <> 3 THEN CAST(k % 21 + 80 AS DOUBLE) END AS "oxygenSaturation",
    CASE WHEN s = 'P' THEN 'draft' ELSE 'final' END AS status, started AS "createdAt", started + k % 1000 * 1000 AS "updatedAt",
    CASE WHEN k % 3 <> 1 THEN started + k % 1000 * 1000 END AS "syncedAt", CASE WHEN k % 41 = 0 THEN 1 END AS "deletedAt", k
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, epoch_us(o_orderdate) // 1000 + o_orderkey % 1440 * 60000 AS started FROM orders))"""

PRESCRIPTIONS = f"""prescriptions AS (
  SELECT 'e' || l_orderkey AS "encounterId", 'rx' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
    {case("l_partkey", DRUGS)} AS drug, CASE WHEN l_suppkey % 5 <> 0 THEN ((l_suppkey % 4 + 1) * 250) || ' mg' END AS dose,
    nullif(l_linenumber % 5, 0) AS "frequencyPerDay", nullif(CAST(floor(l_quantity) AS INTEGER) % 31, 0) AS "durationDays",
    CASE WHEN l_partkey % 3 = 0 THEN 'apres repas' END AS notes
  FROM lineitem)"""

CHANGES = """changes AS (
  SELECT 'f' || (user_id % 3) AS "facilityId", event_id // 50 AS push, CAST(event_id % 50 AS INTEGER) AS ord,
    CASE WHEN event_type IN ('view', 'click') THEN 'patient' ELSE 'encounter' END AS kind, 'u' || user_id AS id,
    epoch_us(ts) // 1000 - event_id % 13 * 21600000 AS "updatedAt",
    CASE WHEN event_id % 29 = 0 THEN epoch_us(ts) // 1000 - event_id % 13 * 21600000 END AS "deletedAt", props AS body FROM events),
judged AS (
  SELECT *, max("updatedAt") OVER w AS seen FROM (SELECT *, CASE kind WHEN 'patient' THEN 0 ELSE 1 END AS kord FROM changes)
  WINDOW w AS (PARTITION BY "facilityId", kind, id ORDER BY push, kord, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
counted AS (
  SELECT *, sum(n) OVER (PARTITION BY "facilityId" ORDER BY push ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base
  FROM (SELECT "facilityId", push, count(*) AS n FROM changes GROUP BY ALL)),
accepted AS (
  SELECT j.*, coalesce(base, 0) + row_number() OVER (PARTITION BY j."facilityId", j.push ORDER BY kord, ord) AS seq
  FROM judged j JOIN counted c ON j."facilityId" = c."facilityId" AND j.push = c.push WHERE seen IS NULL OR "updatedAt" > seen),
state AS (SELECT * FROM accepted QUALIFY row_number() OVER (PARTITION BY "facilityId", kind, id ORDER BY "updatedAt" DESC, seq) = 1)"""

CELLS = """aged AS (
  SELECT v.diagnosis, coalesce(p.sex, 'unknown') AS sex,
    CASE WHEN "birthDate" IS NOT NULL THEN CAST(floor(("occurredAt" - epoch_us(CAST("birthDate" AS TIMESTAMP)) // 1000) / 31557600000.0) AS BIGINT) ELSE "approximateAge" END AS age
  FROM visits v LEFT JOIN (SELECT * FROM patients WHERE "deletedAt" IS NULL) p ON v."patientId" = p.id
  WHERE v."deletedAt" IS NULL AND status = 'final' AND "occurredAt" >= 867715200000 AND "occurredAt" < 870393600000),
banded AS (
  SELECT CASE WHEN age IS NULL THEN 'unknown' WHEN age < 1 THEN '<1' WHEN age < 5 THEN '1-4' WHEN age < 15 THEN '5-14' WHEN age < 50 THEN '15-49' ELSE '50+' END AS "ageBand", sex,
    CASE WHEN coalesce(diagnosis, '') = '' THEN 'other'
      WHEN regexp_matches(diagnosis, '(?i)palud|\\bpalu\\b|malaria') THEN 'malaria'
      WHEN regexp_matches(diagnosis, '(?i)pneumon|bronch|infection respiratoire|\\bira\\b') THEN 'ari'
      WHEN regexp_matches(diagnosis, '(?i)diarrh|gastro|cholera|choléra') THEN 'diarrhoea'
      WHEN regexp_matches(diagnosis, '(?i)malnutrition|kwashiorkor|marasme') THEN 'malnutrition'
      WHEN regexp_matches(diagnosis, '(?i)tubercul|\\btb\\b') THEN 'tuberculosis'
      WHEN regexp_matches(diagnosis, '(?i)hypertension|\\bhta\\b') THEN 'hypertension' ELSE 'other' END AS ind FROM aged),
cells AS (
  SELECT indicator, "ageBand", sex, count(*) AS count
  FROM (SELECT 'consultations' AS indicator, "ageBand", sex FROM banded UNION ALL SELECT ind, "ageBand", sex FROM banded) GROUP BY ALL),
named AS (
  SELECT *, CASE sex WHEN 'female' THEN 'F' WHEN 'male' THEN 'M' ELSE '?' END AS s,
    CASE indicator WHEN 'consultations' THEN 'Consultations' WHEN 'malaria' THEN 'Paludisme' WHEN 'ari' THEN 'Infection respiratoire aiguë' WHEN 'diarrhoea' THEN 'Diarrhée'
      WHEN 'malnutrition' THEN 'Malnutrition' WHEN 'tuberculosis' THEN 'Tuberculose' WHEN 'hypertension' THEN 'Hypertension' ELSE 'Autre' END AS label FROM cells)"""


def dictation_numbers(c: str = "conv_id", t: str = "turn") -> str:
    """What goes into a dictation, which its extraction must give back."""
    return f"""SELECT conv_id, turn, CAST(({c} * 7 + {t}) % 5 + 36 AS DOUBLE) + ({c} + {t}) % 10 / 10.0 AS temperature,
  CAST(({c} * 3 + {t}) % 60 + 60 AS DOUBLE) AS pulse, CAST(({c} + {t}) % 60 + 100 AS DOUBLE) AS systolic, CAST(({c} + {t}) % 30 + 60 AS DOUBLE) AS diastolic,
  'paracétamol' AS drug, '500 mg' AS dose, ({c} + {t}) % 4 + 1 AS frequency, ({c} * 5 + {t}) % 14 + 1 AS days,
  'toux depuis ' || ({t} + 2) || ' jours' AS complaint, {case(f"({c} + {t})", ("paludisme simple", "pneumonie", "gastro-entérite"))} AS diagnosis FROM conversations"""


def sql(*parts: str, select: str) -> str:
    return (f"WITH {', '.join(parts)} " if parts else "") + select
