"""DataFrame to DataFrame operators, keyed by package or pack."""
