"""The data model.  Times are epoch milliseconds; null stands for an absent value."""

from __future__ import annotations

VITALS = ("temperature", "pulse", "systolic", "diastolic", "respiratoryRate", "weight", "height", "oxygenSaturation")

PATIENTS = """id string, registerNo string, givenName string, familyName string, sex string, birthDate string,
birthDatePrecision string, approximateAge int, phone string, address string, preferredLang string, searchKey string,
createdAt long, updatedAt long, syncedAt long, deletedAt long"""

PRESCRIPTION = "id: string, drug: string, dose: string, frequencyPerDay: int, durationDays: int, notes: string"
PROVENANCE = "source: string, confidence: double, rawText: string"

ENCOUNTERS = f"""id string, patientId string, occurredAt long, chiefComplaint string, notes string, diagnosis string,
vitals struct<{", ".join(f"{v}: double" for v in VITALS)}>, prescriptions array<struct<{PRESCRIPTION}>>,
provenance map<string, struct<{PROVENANCE}>>, attachmentIds array<string>, status string,
createdAt long, updatedAt long, syncedAt long, deletedAt long"""

#: The change feed: facility, number of the push, place in the push, and the record.
CHANGES = "facilityId string, push long, ord int, kind string, id string, updatedAt double, deletedAt long, body string"

#: The record store: the last accepted version of each record.
STATE = "facilityId string, kind string, id string, updatedAt double, deletedAt long, seq long, body string"

# Plausibility bounds (both included), unit, decimals shown.
RANGES = {
    "temperature": (30.0, 45.0, "°C", 1),
    "pulse": (20.0, 250.0, "/min", 0),
    "systolic": (50.0, 260.0, "mmHg", 0),
    "diastolic": (20.0, 180.0, "mmHg", 0),
    "respiratoryRate": (5.0, 90.0, "/min", 0),
    "weight": (0.5, 300.0, "kg", 1),
    "height": (20.0, 250.0, "cm", 0),
    "oxygenSaturation": (50.0, 100.0, "%", 0),
}

# From the first number on or below the second it is urgent, likewise watch; None sets no bound.
SEVERITY = {
    "temperature": ((39.5, 35.0), (38.0, None)),
    "pulse": ((130.0, 45.0), (100.0, 55.0)),
    "systolic": ((180.0, 90.0), (140.0, None)),
    "diastolic": ((120.0, 50.0), (90.0, None)),
    "respiratoryRate": ((30.0, 8.0), (24.0, None)),
    "oxygenSaturation": ((None, 90.0), (None, 94.0)),
}

# Export codes, LOINC, display, unit, UCUM, in export order.
VITAL_CODES = {
    "temperature": ("8310-5", "Body temperature", "°C", "Cel"),
    "pulse": ("8867-4", "Heart rate", "/min", "/min"),
    "systolic": ("8480-6", "Systolic blood pressure", "mmHg", "mm[Hg]"),
    "diastolic": ("8462-4", "Diastolic blood pressure", "mmHg", "mm[Hg]"),
    "respiratoryRate": ("9279-1", "Respiratory rate", "/min", "/min"),
    "weight": ("29463-7", "Body weight", "kg", "kg"),
    "height": ("8302-2", "Body height", "cm", "cm"),
    "oxygenSaturation": ("59408-5", "Oxygen saturation in Arterial blood by Pulse oximetry", "%", "%"),
}
