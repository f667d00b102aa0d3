"""Operators of a training-data pipeline: filters, near-duplicate removal,
decontamination, formatting, counting and packing of text tables.

Nothing else in the library imports this subpackage; ``catalog`` holds its
registered queries and ``oracle`` their DuckDB SQL.
"""
