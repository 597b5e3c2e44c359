"""DataFrame operators: entity merge, history, selection, enrichment, reports."""
