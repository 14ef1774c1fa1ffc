"""Column functions: span extraction, validators, text projections."""
