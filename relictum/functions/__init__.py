"""Column functions on reads, and the numeric kernels."""
