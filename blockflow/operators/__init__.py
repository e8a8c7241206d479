"""DataFrame -> DataFrame operators: filters, aggregates, rasters, top-k,
windows, row expansion and the spatial join."""
