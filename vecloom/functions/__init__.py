"""Functions of the vector-item store."""
