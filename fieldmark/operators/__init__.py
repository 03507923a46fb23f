"""DataFrame operators: ranking, joins, splits, neighbours, scoring, mining."""
