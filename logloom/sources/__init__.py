"""Where batches come from and where log rows are stored."""
