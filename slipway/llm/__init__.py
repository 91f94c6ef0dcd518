"""Operators for building training corpora.

Nothing outside this package imports it; ``registry`` holds its queries and
their SQL, and ``__spark_entry__.py`` adds them when the package is present.
"""
