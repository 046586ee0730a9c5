"""backglot: round-trip translation analytics for code and text tables, on Spark DataFrames."""
