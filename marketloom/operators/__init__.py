"""Relational building blocks: filters, joins, aggregates, series, cleaning, encoding, scores."""
