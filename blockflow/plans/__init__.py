"""Composed jobs: fixtures, apportionment, migration tables, cross-filter,
point datasets and the state split."""
