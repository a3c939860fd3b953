"""DataFrame operators: scoring, ratings, joins, retrieval, training sets, text metrics, simulated backends, transactions."""
