"""Column-level functions: sequences, strands, scores."""
