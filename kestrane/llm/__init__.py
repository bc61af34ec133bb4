"""Operators for large-scale training-text preparation.

Nothing outside this subpackage imports it; `queries.py` holds the registered
queries and `sql.py` their SQL counterparts.
"""
