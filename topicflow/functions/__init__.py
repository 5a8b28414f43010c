"""Column -> Column expressions; all JVM-side (no Python UDF on the text path)."""
