"""Table-level operators: validation, filters, listing, counting, retention."""
