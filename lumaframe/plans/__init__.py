"""Physical helpers: how per-image kernels run, and inputs derived from tables."""
