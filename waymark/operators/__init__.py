"""DataFrame operators: cleaning, filters, reshaping, joins, aggregates, order and splicing."""
