"""Operators for preparing language-model training data.

A self-contained subpackage: nothing else in the library imports it, and
``barlume.llm.queries`` holds the thin queries that apply each operator to its
whole table.
"""
