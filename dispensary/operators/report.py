"""The monthly aggregate report and its two export shapes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispensary.functions import clinical as C

INDICATOR_KEYS = ("consultations", *(k for k, _ in C.INDICATORS), "other")


@dataclass(frozen=True)
class Mapping:
    """Identifiers of the receiving instance; the defaults are placeholders."""

    org_unit: str = "REPLACE_ORG_UNIT_UID"
    data_set: str = "REPLACE_DATASET_UID"
    data_elements: dict[str, str] = field(
        default_factory=lambda: {
            "consultations": "REPLACE_DE_CONSULTATIONS",
            "malaria": "REPLACE_DE_MALARIA",
            "ari": "REPLACE_DE_ARI",
            "diarrhoea": "REPLACE_DE_DIARRHOEA",
            "malnutrition": "REPLACE_DE_MALNUTRITION",
            "tuberculosis": "REPLACE_DE_TB",
            "hypertension": "REPLACE_DE_HTN",
            "other": "REPLACE_DE_OTHER",
        }
    )
    option_combos: dict[str, str] = field(default_factory=dict)  # by `band|sex`

    @property
    def is_placeholder(self) -> bool:
        return self.org_unit.startswith("REPLACE_") or any(v.startswith("REPLACE_") for v in self.data_elements.values())


def month_bounds(spark, year: int, month: int) -> tuple[int, int]:
    """First instant of the month and of the next one, in the session's time zone."""
    start = F.make_timestamp(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    row = spark.range(1).select(F.unix_millis(start).alias("a"), F.unix_millis(start + F.expr("interval 1 month")).alias("b")).first()
    return row.a, row.b


def aggregate_month(patients: DataFrame, encounters: DataFrame, year: int, month: int) -> DataFrame:
    """(indicator, ageBand, sex, count): every final encounter of the month counts as a consultation and under one indicator.

    Ages are those at the encounter; an encounter without a known patient counts as unknown.  Encounters are reduced to
    their key, time and indicator before the join, and a patient's rows to the newest one, so that the join adds no rows."""
    start, end = month_bounds(patients.sparkSession, year, month)
    e = encounters.filter((F.col("status") == "final") & (F.col("occurredAt") >= start) & (F.col("occurredAt") < end))
    e = e.select("patientId", "occurredAt", C.classify_diagnosis(F.col("diagnosis")).alias("indicator"))
    newest = F.max(F.struct("updatedAt", "sex", "birthDate", "approximateAge")).alias("p")
    p = patients.groupBy(F.col("id").alias("patientId")).agg(newest).select("patientId", "p.sex", "p.birthDate", "p.approximateAge")
    band = C.age_band(C.patient_age(F.col("birthDate"), F.col("approximateAge"), F.col("occurredAt")))
    joined = e.join(p, "patientId", "left").select("indicator", band.alias("ageBand"), F.coalesce("sex", F.lit("unknown")).alias("sex"))
    both = joined.select(F.explode(F.array(F.lit("consultations"), "indicator")).alias("indicator"), "ageBand", "sex")
    return both.groupBy("indicator", "ageBand", "sex").agg(F.count("*").alias("count"))


def _order() -> list:
    """Indicator, then band, in the order of the Unicode root collation; sex breaks ties."""
    return [F.collate("indicator", "UNICODE"), F.collate("ageBand", "UNICODE"), F.col("sex")]


def report_order(cells: DataFrame) -> DataFrame:
    return cells.orderBy(*_order())


def placed(cells: DataFrame) -> DataFrame:
    """The cells with their `place` in the report; a month has some hundred cells, whatever the number of encounters."""
    return cells.withColumn("place", F.row_number().over(Window.orderBy(*_order())))


def _in_order(row: Column) -> Column:
    """The rows of a report as one list, by place."""
    return F.transform(F.array_sort(F.collect_list(F.struct("place", row.alias("row")))), lambda x: x["row"])


def _data_value(mapping: Mapping) -> list[Column]:
    element = C.lookup(F.col("indicator"), mapping.data_elements, F.concat(F.lit("REPLACE_DE_"), F.upper("indicator")))
    combo = C.lookup(F.concat("ageBand", F.lit("|"), "sex"), mapping.option_combos, F.concat(F.lit("REPLACE_COC_"), "ageBand", F.lit("_"), C.sex_label(F.col("sex"))))
    return [element.alias("dataElement"), combo.alias("categoryOptionCombo"), F.col("count").cast("string").alias("value")]


def data_values(cells: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """(dataElement, categoryOptionCombo, value)"""
    return cells.select(_data_value(mapping or Mapping()))


def _period(cells: DataFrame, year: int, month: int) -> Column:
    return C.period(F.lit(month_bounds(cells.sparkSession, year, month)[0]))


CSV_COLUMNS = ("periode", "indicateur", "tranche_age", "sexe", "nombre")


def csv_rows(cells: DataFrame, year: int, month: int) -> DataFrame:
    """CSV_COLUMNS as text."""
    return cells.select(_period(cells, year, month).alias("periode"), C.indicator_label(F.col("indicator")).alias("indicateur"), F.col("ageBand").alias("tranche_age"), C.sex_label(F.col("sex")).alias("sexe"), F.col("count").cast("string").alias("nombre"))


def csv_text(cells: DataFrame, year: int, month: int) -> DataFrame:
    """One row: the whole CSV in report order, comma-joined without quotes, without a line end after the last row."""
    rows = placed(cells)
    fields = [_period(cells, year, month), C.indicator_label(F.col("indicator")), F.col("ageBand"), C.sex_label(F.col("sex")), F.col("count").cast("string")]
    return rows.agg(F.array_join(F.concat(F.array(F.lit(",".join(CSV_COLUMNS))), _in_order(F.concat_ws(",", *fields))), "\n").alias("csv"))


def data_value_set(cells: DataFrame, year: int, month: int, complete_date: str, mapping: Mapping | None = None) -> DataFrame:
    """One row: the export as one JSON document, its lists in report order."""
    mapping = mapping or Mapping()
    mirror = F.struct(C.indicator_label(F.col("indicator")).alias("indicator"), "ageBand", C.sex_label(F.col("sex")).alias("sex"), "count")
    lists = placed(cells).agg(_in_order(F.struct(*_data_value(mapping))).alias("dataValues"), _in_order(mirror).alias("_readable"))
    fields = [F.lit(mapping.data_set).alias("dataSet"), _period(cells, year, month).alias("period"), F.lit(mapping.org_unit).alias("orgUnit"), F.lit(complete_date).alias("completeDate"), "dataValues"]
    if mapping.is_placeholder:
        fields.append(F.lit(True).alias("_placeholderMapping"))
    return lists.select(F.to_json(F.struct(*fields, "_readable")).alias("json"))
