"""pixelloom: raster image analytics on Spark DataFrames."""
