"""Array kernels: pure NumPy, one image or one pair at a time."""
