"""The queries: operators applied to the tables of a data folder, with the SQL that says the same."""
