"""Reading tables, choosing rows and splits, writing results."""
