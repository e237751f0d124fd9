"""Small numeric kernels in numpy."""
