"""Array kernels in NumPy, as Arrow functions."""
