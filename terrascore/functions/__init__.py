"""Part of the place-scoring library."""
