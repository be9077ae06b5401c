"""Queries over the test tables: each operator bound to tables, with an equivalent plain SQL text."""
