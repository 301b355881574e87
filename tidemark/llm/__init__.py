"""Operations of a training-data pipeline over a ``documents`` table.

Nothing outside this subpackage imports it; ``queries.py`` here lists its queries for the entry point.
"""
