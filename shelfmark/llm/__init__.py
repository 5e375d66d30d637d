"""Operators of a training-data pipeline over documents, pages and vectors.

Each module holds one operator with its own interface; ``queries`` applies them to the
tables of a data set. Nothing else in the library imports this subpackage.
"""
