"""DataFrame operators: filters, joins, aggregates, paging, changes, quality, access."""
