"""Composite plans: the served dashboard datasets and the full batch run."""
