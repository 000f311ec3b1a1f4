"""Declarative compliance analytics on Spark: versioned rules, typed checks, scores, extraction and reconciliation."""
