"""Patients, encounters, prescriptions, changes and dictations derived from general star-schema tables.

The derivations are integer arithmetic on keys, so that another engine computes the same rows from the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dispensary.functions.text import search_key

FAMILY_NAMES = ("RAKOTOARISOA", "ANDRIANJAFY", "RAZAFIMAHATRATRA", "RAKOTOÀRISON", "BÉMANANA")
DIAGNOSES = ("paludisme simple", "PNEUMONIE", "diarrhée aiguë", "hypertension artérielle", "CHOLÉRA", "éira suspecte", "tb pulmonaire", "HTA", "marasme", "", None, "entorse")
DRUGS = ("artéméther luméfantrine", "paracétamol", "amoxicilline", "zinc", "ibuprofène", "métronidazole")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: tuple) -> Column:
    """values[key % len(values)]"""
    c = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        c = c.when(key % len(values) == i, F.lit(v))
    return c


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left")
    birth = F.when(k % 4 != 0, F.date_add(F.lit("1920-01-01").cast("date"), ((k * 37) % 29800).cast("int")).cast("string"))
    p = p.select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"),
        F.when(k % 6 != 5, (k + 2000).cast("string")).alias("registerNo"),
        F.when(k % 7 == 0, "").otherwise("Voahirana").alias("givenName"),
        pick(k, FAMILY_NAMES).alias("familyName"),
        pick(k, ("female", "male", "unknown")).alias("sex"),
        birth.alias("birthDate"),
        F.when(k % 4 != 0, "day").alias("birthDatePrecision"),
        F.when(k % 8 == 4, k % 100).cast("int").alias("approximateAge"),
        F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, "").otherwise(F.concat(F.lit("034 "), (k % 90 + 10).cast("string"), F.lit(" 345 67"))).alias("phone"),
        F.when(k % 10 != 3, F.col("n_name")).alias("address"),
        pick(k, ("fr", "mg", "en")).alias("preferredLang"),
        (k * 1000 + 1600000000000).alias("createdAt"),
        ((k * 7919) % 100000 * 1000 + 1600000000000).alias("updatedAt"),
        F.when(k % 4 != 1, (k * 7919) % 100000 * 1000 + 1600000000000).alias("syncedAt"),
        F.when(k % 50 == 49, F.lit(1)).cast("long").alias("deletedAt"),
    )
    return p.withColumn("searchKey", search_key(F.col("familyName"), F.col("givenName"), F.col("registerNo"), F.col("phone")))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters without their prescriptions."""
    k = F.col("o_orderkey")
    started = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + k % 1440 * 60000
    number = lambda c: c.cast("double")
    vitals = F.struct(
        F.when(k % 3 != 0, F.lit(34.0) + number(k % 71) / 10).alias("temperature"),
        F.when(k % 4 != 1, number(k % 101 + 40)).alias("pulse"),
        F.when(k % 5 != 2, number(k % 111 + 80)).alias("systolic"),
        F.when(~(k % 5).isin(2, 3), number(k % 81 + 45)).alias("diastolic"),
        F.when(~(k % 6).isin(1, 2), number(k % 40 + 6)).alias("respiratoryRate"),
        F.when(k % 8 != 5, F.lit(3.0) + number(k % 900) / 10).alias("weight"),
        F.when(k % 9 != 4, number(k % 150 + 40)).alias("height"),
        F.when(k % 7 != 3, number(k % 21 + 80)).alias("oxygenSaturation"),
    )
    said = lambda source, confidence, text: F.struct(F.lit(source).alias("source"), confidence.alias("confidence"), text.alias("rawText"))
    notes = F.when(k % 5 != 0, F.concat(F.lit("vu par "), pick(k, FAMILY_NAMES), F.lit(" le "), (k % 28 + 1).cast("string")))
    provenance = F.map_from_arrays(
        F.array(F.lit("vitals.pulse"), F.lit("notes")),
        F.array(said("voice", number(k % 10 + 1) / 10, F.concat(F.lit("pouls "), (k % 101 + 40).cast("string"))), said("manual", F.lit(None).cast("double"), notes)),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("e"), k.cast("string")).alias("id"),
        F.when(k % 97 == 0, "ghost").otherwise(F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("patientId"),
        started.alias("occurredAt"),
        F.when(k % 6 == 1, "").when(k % 6 != 0, F.concat(F.lit("fievre depuis "), (k % 9 + 1).cast("string"), F.lit(" jours"))).alias("chiefComplaint"),
        notes.alias("notes"),
        pick(k, DIAGNOSES).alias("diagnosis"),
        vitals.alias("vitals"),
        provenance.alias("provenance"),
        F.when(k % 11 == 0, F.array(F.concat(F.lit("a"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("attachmentIds"),
        F.when(F.col("o_orderstatus") == "P", "draft").otherwise("final").alias("status"),
        started.alias("createdAt"),
        (started + k % 1000 * 1000).alias("updatedAt"),
        F.when(k % 3 != 1, started + k % 1000 * 1000).alias("syncedAt"),
        F.when(k % 41 == 0, F.lit(1)).cast("long").alias("deletedAt"),
    )


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(encounterId, id, drug, dose, frequencyPerDay, durationDays, notes), one row each."""
    number = lambda c: c.cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("e"), number(F.col("l_orderkey"))).alias("encounterId"),
        F.concat(F.lit("rx"), number(F.col("l_linenumber")), F.lit("-"), number(F.col("l_partkey")), F.lit("-"), number(F.col("l_suppkey"))).alias("id"),
        pick(F.col("l_partkey"), DRUGS).alias("drug"),
        F.when(F.col("l_suppkey") % 5 != 0, F.concat(number((F.col("l_suppkey") % 4 + 1) * 250), F.lit(" mg"))).alias("dose"),
        F.nullif(F.col("l_linenumber") % 5, F.lit(0)).cast("int").alias("frequencyPerDay"),
        F.nullif(F.col("l_quantity").cast("int") % 31, F.lit(0)).cast("int").alias("durationDays"),
        F.when(F.col("l_partkey") % 3 == 0, "apres repas").alias("notes"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters with their prescriptions, in the order of the prescriptions' ids."""
    listed = prescriptions(spark, sf_dir).groupBy("encounterId").agg(F.array_sort(F.collect_list(F.struct("id", "drug", "dose", "frequencyPerDay", "durationDays", "notes"))).alias("prescriptions"))
    v = visits(spark, sf_dir)
    joined = v.join(listed, v["id"] == listed["encounterId"], "left").drop("encounterId")
    none = F.array().cast("array<struct<id:string,drug:string,dose:string,frequencyPerDay:int,durationDays:int,notes:string>>")
    return joined.withColumn("prescriptions", F.coalesce("prescriptions", none))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed with stale arrivals: fifty events a push."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) - F.col("event_id") % 13 * 21600000
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("facilityId"),
        F.floor(F.col("event_id") / 50).alias("push"),
        (F.col("event_id") % 50).cast("int").alias("ord"),
        F.when(F.col("event_type").isin("view", "click"), "patient").otherwise("encounter").alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        at.cast("double").alias("updatedAt"),
        F.when(F.col("event_id") % 29 == 0, at).alias("deletedAt"),
        F.col("props").alias("body"),
    )


def dictations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French dictations built from the keys of conversations."""
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    text = F.concat(
        F.lit("Température "), s((c * 7 + t) % 5 + 36), F.lit(","), s((c + t) % 10), F.lit(". Pouls "), s((c * 3 + t) % 60 + 60),
        F.lit(". Tension "), s((c + t) % 60 + 100), F.lit(" sur "), s((c + t) % 30 + 60),
        F.lit(". Motif: toux depuis "), s(t + 2), F.lit(" jours. Diagnostic "), pick(c + t, ("paludisme simple", "pneumonie", "gastro-entérite")),
        F.lit(". Prescrire paracétamol 500 mg "), s((c + t) % 4 + 1), F.lit(" fois par jour pendant "), s((c * 5 + t) % 14 + 1), F.lit(" jours. Revoir si besoin."),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def dictations_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English ones: abbreviations, two drugs one of which begins like another, every fourth temperature implausible."""
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    text = F.concat(
        F.lit("Temperature "), F.when((c + t) % 4 == 0, "99").otherwise(F.concat(s((c * 7 + t) % 5 + 36), F.lit("."), s((c + t) % 10))), F.lit(". Heart rate "), s((c * 3 + t) % 60 + 60),
        F.lit(". BP "), s((c + t) % 60 + 100), F.lit(" over "), s((c + t) % 30 + 60), F.lit(". SpO2 "), pick(c + t, ("ninety one", "ninety-two", "ninety five")),
        F.lit(". Complaining of cough for "), s(t + 2), F.lit(" days. Assessment "), pick(c + t, ("malaria", "pneumonia", "simple cough")),
        F.lit(". Give amoxicillin clavulanic acid 250 mg every "), pick(c + t, ("4", "six", "8", "twelve")), F.lit(" hours for "), s(c % 3 + 1), F.lit(" weeks. Paracetamol two tablets "),
        pick(c + t, ("od", "bd", "tds", "qid", "twice")), F.lit(" "), s((c * 5 + t) % 14 + 1), F.lit("/7. Review if needed."),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def dictations_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French ones that turn on single rules: an implausible value, doses by the hour, times of day, weeks, spoken numbers, pressure in centimetres."""
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    text = F.concat(
        F.lit("Température "), F.when((c + t) % 3 == 0, "99").otherwise("trente-huit virgule cinq"), F.lit(". Pouls "), pick(c + t, ("quatre-vingt-dix-sept", "soixante et onze", "cent vingt")),
        F.lit(". Tension "), s((c + t) % 8 + 10), F.lit(" sur "), s((c + t) % 4 + 6), F.lit(". Vient pour fièvre. Impression "), pick(c + t, ("angine", "HTA")),
        F.lit(". Artéméther luméfantrine quatre comprimés toutes les "), pick(c + t, ("6", "huit", "12")), F.lit(" heures pendant "), s(c % 12 + 1), F.lit(" jours. Amoxicilline 500 mg "),
        pick(c + t, ("matin et soir", "matin, midi et soir", "par jour")), F.lit(" pendant "), pick(c + t, ("une semaine", "2 semaines", "trois semaines")), F.lit("."),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
