"""Static extraction of lineage from source text."""
