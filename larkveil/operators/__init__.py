"""Operators over documents, findings, entities, tokens and mappings."""
