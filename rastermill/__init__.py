"""rastermill: image and recognition corpora as Spark DataFrames."""
