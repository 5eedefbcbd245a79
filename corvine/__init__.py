"""corvine: catalogue matching and data-quality operators on Spark DataFrames."""
