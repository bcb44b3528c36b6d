"""Profile consolidation on Spark: many partial descriptions of a person in, one canonical profile out."""
