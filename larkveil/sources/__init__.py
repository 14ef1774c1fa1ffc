"""Readers and writers: texts, term lists, configuration, the vault's tables, audit rows."""
