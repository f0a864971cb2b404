"""Operators of a training-data pipeline over tables of documents.

Each module holds one operator with its own interface; ``queries`` applies them to the given
tables. Texts are never cut: null texts count as empty, and every function names its result for
empty, tied and repeated rows.
"""
