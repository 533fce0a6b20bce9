"""Operators for preparing training text at corpus scale.

Nothing outside this package imports it.  ``queries.py`` binds every operator to
the synthetic tables; the operators themselves take plain DataFrames.
"""
