"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``registry`` holds the
queries that ``__spark_entry__`` adds when the subpackage can be imported.
"""
