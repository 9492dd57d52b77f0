"""Column functions and the few Arrow kernels."""
