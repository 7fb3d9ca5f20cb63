"""DataFrame operators: filters, taxonomy, damage counts, roll-ups, selections."""
