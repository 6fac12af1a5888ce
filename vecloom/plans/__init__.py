"""Plans of the vector-item store."""
