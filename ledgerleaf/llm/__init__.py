"""Operators for large text collections: one module per operator, `registry` lists their queries."""
