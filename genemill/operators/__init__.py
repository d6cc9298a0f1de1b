"""DataFrame-in, DataFrame-out operators over long tables."""
