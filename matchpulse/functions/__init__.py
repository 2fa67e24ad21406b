"""Column expressions; no DataFrames here."""
