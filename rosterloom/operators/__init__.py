"""DataFrame operators: reshaping, joins, lookups, updates and reconciliation."""
