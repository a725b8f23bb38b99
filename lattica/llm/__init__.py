"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and returns a DataFrame; ``queries`` holds the thin benchmark
queries built from them.
"""
