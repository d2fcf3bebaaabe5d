"""DataFrame operators: dedup, selection, guards, similarity, reports, training examples."""
