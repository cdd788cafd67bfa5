"""tessera: raster, catalogue and point-set analytics expressed as Spark DataFrames."""
