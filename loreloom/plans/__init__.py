"""Query catalogue: one callable for each query and, where SQL can say it, its SQL."""
