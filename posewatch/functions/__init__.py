"""Column expressions: units, text lines, identifiers, redaction, settings."""
