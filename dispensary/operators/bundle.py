"""Export of records as standard nested JSON resources: one row a resource, in a defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensary.functions.clinical import patient_age
from dispensary.schemas import VITAL_CODES

#: Namespace of the two URNs that are local to a deployment.
URN = "urn:local"

_UCUM, _LOINC = "http://unitsofmeasure.org", "http://loinc.org"
_PLAIN_VITALS = [v for v in VITAL_CODES if v not in ("systolic", "diastolic")]


def iso(ms: Column) -> Column:
    """UTC with milliseconds, whatever the session's time zone."""
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def _struct(**fields: Column | str | bool | int) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _blank(c: str | Column) -> Column:
    """The text, or null where it is empty: absent parts are left out of the JSON."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _some(value: Column, then: Column) -> Column:
    return F.when(value.isNotNull(), then)


def patient_resources(patients: DataFrame, as_of_ms: int, urn: str = URN) -> DataFrame:
    """(id, resource); the age of a patient without a birth date is one at `as_of_ms`."""
    phone, address, number, birth = map(_blank, ("phone", "address", "registerNo", "birthDate"))
    age = patient_age(F.col("birthDate"), F.col("approximateAge"), F.lit(as_of_ms))
    name = _struct(use="official", family=F.col("familyName"), given=F.when(_blank("givenName").isNotNull(), F.array("givenName")).otherwise(F.array().cast("array<string>")))
    language = _struct(language=_struct(coding=F.array(_struct(system="urn:ietf:bcp:47", code=F.col("preferredLang")))), preferred=True)
    resource = _struct(
        resourceType="Patient", id=F.col("id"), active=True, name=F.array(name), gender=F.col("sex"),
        identifier=_some(number, F.array(_struct(use="usual", system=f"{urn}:register", value=number))),
        birthDate=birth,
        telecom=_some(phone, F.array(_struct(system="phone", value=phone, use="mobile"))),
        address=_some(address, F.array(_struct(use="home", text=address, country="MG"))),
        communication=F.array(language),
        extension=F.when(birth.isNull() & age.isNotNull(), F.array(_struct(url=f"{urn}:approximateAgeYears", valueInteger=age))),
    )
    return patients.select("id", resource.alias("resource"))


def exported(encounters: DataFrame, include_drafts: bool = False) -> DataFrame:
    return encounters if include_drafts else encounters.filter(F.col("status") == "final")


def _subject() -> Column:
    return _struct(reference=F.concat(F.lit("Patient/"), F.col("patientId")))


def _visit() -> Column:
    return _struct(reference=F.concat(F.lit("Encounter/"), F.col("id")))


def _start() -> Column:
    return iso(F.col("occurredAt"))


def _encounter(start: Column | None = None) -> Column:
    complaint, diagnosis = _blank("chiefComplaint"), _blank("diagnosis")
    return _struct(
        resourceType="Encounter", id=F.col("id"), status=F.when(F.col("status") == "final", "finished").otherwise("in-progress"),
        **{"class": _struct(system="http://terminology.hl7.org/CodeSystem/v3-ActCode", code="AMB", display="ambulatory")},
        subject=_subject(), period=_struct(start=_start() if start is None else start),
        reasonCode=_some(complaint, F.array(_struct(text=complaint))),
        diagnosis=_some(diagnosis, F.array(_struct(use=_struct(text="diagnosis"), condition=_struct(display=diagnosis)))),
    )


def encounter_resources(encounters: DataFrame) -> DataFrame:
    """(encounterId, id, resource)"""
    return encounters.select(F.col("id").alias("encounterId"), "id", _encounter().alias("resource"))


def _quantity(value: Column, unit: Column, code: Column) -> Column:
    return _struct(value=value, unit=unit, system=_UCUM, code=code)


def _observation(id_: Column, loinc: Column, display: Column, start: Column | None = None, **rest: Column) -> Column:
    category = _struct(system="http://terminology.hl7.org/CodeSystem/observation-category", code="vital-signs", display="Vital Signs")
    return _struct(
        resourceType="Observation", id=id_, status="final", category=F.array(_struct(coding=F.array(category))),
        code=_struct(coding=F.array(_struct(system=_LOINC, code=loinc, display=display))),
        subject=_subject(), encounter=_visit(), effectiveDateTime=_start() if start is None else start, **rest,
    )


def _measured() -> Column:
    """The values outside blood pressure that are there, in export order: place, vital, value and codes."""
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(v).alias("vital"), F.col(f"vitals.{v}").alias("value"), *[F.lit(x).alias(n) for n, x in zip(("loinc", "display", "unit", "ucum"), VITAL_CODES[v], strict=True)]) for i, v in enumerate(_PLAIN_VITALS)])
    return F.filter(listed, lambda x: x["value"].isNotNull())


def _vital_id(x: Column) -> Column:
    return F.concat(F.col("id"), F.lit("-"), x["vital"])


def _vital(x: Column, start: Column | None = None) -> Column:
    return _observation(_vital_id(x), x["loinc"], x["display"], start, valueQuantity=_quantity(x["value"], x["unit"], x["ucum"]))


def observations(encounters: DataFrame) -> DataFrame:
    """(encounterId, place, id, vital, value, resource), one row a value outside blood pressure, in export order."""
    o, x = encounters.select("id", "patientId", "occurredAt", F.explode(_measured()).alias("x")), F.col("x")
    return o.select(F.col("id").alias("encounterId"), "x.place", _vital_id(x).alias("id"), "x.vital", "x.value", _vital(x).alias("resource"))


def _has_pressure() -> Column:
    return F.col("vitals.systolic").isNotNull() | F.col("vitals.diastolic").isNotNull()


def _pressure_id() -> Column:
    return F.concat("id", F.lit("-bp"))


def _pressure(start: Column | None = None) -> Column:
    parts = []
    for v in ("systolic", "diastolic"):
        loinc, display, unit, ucum = map(F.lit, VITAL_CODES[v])
        value = F.col(f"vitals.{v}")
        parts.append(F.when(value.isNotNull(), _struct(code=_struct(coding=F.array(_struct(system=_LOINC, code=loinc, display=display))), valueQuantity=_quantity(value, unit, ucum))))
    return _observation(_pressure_id(), F.lit("85354-9"), F.lit("Blood pressure panel with all children optional"), start, component=F.array_compact(F.array(*parts)))


def blood_pressures(encounters: DataFrame) -> DataFrame:
    """(encounterId, id, systolic, diastolic, resource), one panel for encounters with either value."""
    e = encounters.filter(_has_pressure())
    return e.select(F.col("id").alias("encounterId"), _pressure_id().alias("id"), "vitals.systolic", "vitals.diastolic", _pressure().alias("resource"))


def _frequency(p: Column) -> Column:
    return F.nullif(p["frequencyPerDay"], F.lit(0))


def _days(p: Column) -> Column:
    return F.nullif(p["durationDays"], F.lit(0))


def _dosage(p: Column) -> Column:
    return F.nullif(F.concat_ws(", ", _blank(p["dose"]), _blank(p["notes"])), F.lit(""))


def _medication_id(p: Column) -> Column:
    return F.concat(F.col("id"), F.lit("-"), p["id"])


def _medication(p: Column, start: Column | None = None) -> Column:
    frequency, days = _frequency(p), _days(p)
    repeat = _struct(frequency=frequency, period=_some(frequency, F.lit(1)), periodUnit=_some(frequency, F.lit("d")), boundsDuration=_some(days, _struct(value=days, unit="d", system=_UCUM, code="d")))
    return _struct(
        resourceType="MedicationRequest", id=_medication_id(p), status="active", intent="order", medicationCodeableConcept=_struct(text=p["drug"]),
        subject=_subject(), encounter=_visit(), authoredOn=_start() if start is None else start,
        dosageInstruction=F.array(_struct(text=_dosage(p), timing=F.when(frequency.isNotNull() | days.isNotNull(), _struct(repeat=repeat)))),
    )


def medication_requests(encounters: DataFrame) -> DataFrame:
    """(encounterId, place, id, drug, dosage, frequency, days, resource), one row a prescription."""
    m, p = encounters.select("id", "patientId", "occurredAt", F.posexplode("prescriptions").alias("place", "p")), F.col("p")
    return m.select(F.col("id").alias("encounterId"), "place", _medication_id(p).alias("id"), "p.drug", _dosage(p).alias("dosage"), _frequency(p).alias("frequency"), _days(p).alias("days"), _medication(p).alias("resource"))


# --- the bundle -------------------------------------------------------------------------------------------------

BUNDLE_ORDER = ("part", "encounterId", "section", "place")
_MEASURED = "struct<place:int,vital:string,value:double,loinc:string,display:string,unit:string,ucum:string>"


def bundle_entries(patients: DataFrame, encounters: DataFrame, as_of_ms: int, include_drafts: bool = False, urn: str = URN, json: bool = True) -> DataFrame:
    """(part, encounterId, section, place, resourceType, fullUrl, json): the entries of the bundle.

    They are ordered by BUNDLE_ORDER (patients, then encounters); absent fields are left out of the JSON, which
    is null without `json`, so that entries can be counted or listed without being written."""
    return patient_entries(patients, as_of_ms, urn, json).unionByName(encounter_entries(exported(encounters, include_drafts), json))


def patient_entries(patients: DataFrame, as_of_ms: int, urn: str = URN, json: bool = True) -> DataFrame:
    """Those of patients, in the order of these."""
    zero, text = F.lit(0), F.to_json("resource") if json else F.lit(None).cast("string")
    first = patient_resources(patients, as_of_ms, urn)
    return first.select(F.lit(0).alias("part"), F.col("id").alias("encounterId"), zero.alias("section"), zero.alias("place"), F.lit("Patient").alias("resourceType"), F.concat(F.lit("urn:uuid:"), "id").alias("fullUrl"), text.alias("json"))


def encounter_entries(encounters: DataFrame, json: bool = True) -> DataFrame:
    """Those of encounters, in the order of these, and of one encounter by section and place.

    One pass over the encounters lists what each has, as plain values; resources are made of the listed rows, in generated code, which
    the inside of a list doesn't get."""
    zero, prescription = F.lit(0), encounters.schema["prescriptions"].dataType.elementType

    def listed(section: int, place: Column, x: Column | None = None, p: Column | None = None) -> Column:
        nothing = F.lit(None)
        return F.struct(F.lit(section).alias("section"), place.cast("int").alias("place"), (nothing if x is None else x).cast(_MEASURED).alias("x"), (nothing if p is None else p).cast(prescription).alias("p"))

    all_ = F.concat(
        F.array(listed(0, zero)),
        F.transform(_measured(), lambda x: listed(1, x["place"], x=x)),
        F.filter(F.array(listed(2, zero)), lambda _: _has_pressure()),
        F.transform(F.coalesce("prescriptions", F.array().cast(encounters.schema["prescriptions"].dataType)), lambda p, i: listed(3, i, p=p)),
    )
    pressure = F.struct("vitals.systolic", "vitals.diastolic").alias("pressure")
    own = encounters.select("id", "patientId", "status", "chiefComplaint", "diagnosis", pressure, _start().alias("start"), F.explode(all_).alias("e")).withColumnRenamed("pressure", "vitals")
    x, p, start, section = F.col("e.x"), F.col("e.p"), F.col("start"), F.col("e.section")
    # section: resource type, id, resource
    kinds = (("Encounter", F.col("id"), _encounter(start)), ("Observation", _vital_id(x), _vital(x, start)), ("Observation", _pressure_id(), _pressure(start)), ("MedicationRequest", _medication_id(p), _medication(p, start)))

    def of(values: list[Column]) -> Column:
        return F.when(section == 0, values[0]).when(section == 1, values[1]).when(section == 2, values[2]).otherwise(values[3])

    text = of([F.to_json(r) for _, _, r in kinds]) if json else F.lit(None).cast("string")
    url = F.concat(F.lit("urn:uuid:"), of([i for _, i, _ in kinds]))
    return own.select(F.lit(1).alias("part"), F.col("id").alias("encounterId"), "e.section", "e.place", of([F.lit(k) for k, _, _ in kinds]).alias("resourceType"), url.alias("fullUrl"), text.alias("json"))


def entry_json() -> Column:
    """An entry as it stands in a bundle."""
    return F.concat(F.lit('{"fullUrl":'), F.to_json(F.array("fullUrl")).substr(F.lit(2), F.length(F.to_json(F.array("fullUrl"))) - 2), F.lit(',"resource":'), F.col("json"), F.lit("}"))


def bundle_head(as_of_ms: int) -> Column:
    """What a bundle holds beside its entries, with the time of the export."""
    return F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), iso(F.lit(as_of_ms)).alias("timestamp")))
