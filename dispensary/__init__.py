"""Clinical-register analytics on Spark: reports, search, extraction, de-identification, export and sync."""
