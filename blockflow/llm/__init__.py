"""Operators for preparing training corpora at scale, one module each, plus
the queries that apply them to the driver tables (see ``registry``).

Nothing else in the library imports this package.
"""
