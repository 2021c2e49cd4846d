"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries`` holds the registered queries and their SQL.
"""
