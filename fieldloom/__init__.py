"""An analytics engine for nested, field-level records, built from Spark SQL expressions."""
