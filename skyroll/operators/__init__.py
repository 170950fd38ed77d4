"""DataFrame -> DataFrame operators: standardise, aggregate, rank, check, dedup."""
