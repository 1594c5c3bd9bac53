"""Dense signal and raster analytics on Spark DataFrames."""
