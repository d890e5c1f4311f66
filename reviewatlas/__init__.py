"""Set-wise product-review analytics on Spark DataFrames."""
