"""DataFrame -> DataFrame operators: clean, search, trends, quantiles,
box statistics, published analyses, geo and facets."""
