"""DataFrame operators over intervals, signal, density matrices, clusters and sequences."""
