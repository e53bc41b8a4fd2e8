"""Operators for large training-text collections, one module each.

Nothing outside this folder imports it. Every module states its method, its
defined results for odd input (NULLs, empty tables, repeated rows) and the
bounds of whatever it broadcasts; :mod:`worklens.llm.queries` registers one
query per operator.
"""
