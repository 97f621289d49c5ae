"""Plan-level helpers: lineage cuts, positions, quantiles, operation lists."""
