"""Column-level helpers: scalar functions, selectors, quantile functions, skew-safe scans and quantiles."""
