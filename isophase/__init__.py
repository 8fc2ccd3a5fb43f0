"""isophase: raster phase analytics expressed as Spark DataFrame plans."""
