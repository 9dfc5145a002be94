"""Physical plans of the neighbour query."""
