"""DataFrame operators: filters, projection, paging, lookups, joins, search, metrics."""
