"""Operators on collections: paths, comparisons, joins, constraints, mutations and layout."""
