"""Relational building blocks: visibility predicates, joins, aggregates, rankings and set operations."""
