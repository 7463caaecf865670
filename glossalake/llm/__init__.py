"""Operators for preparing large training corpora.

Nothing outside this package imports it. Each operator module holds a general
interface; the fixed-contract queries built on them are in ``queries.py``.
"""
