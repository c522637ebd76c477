"""Document structuring and corpus cleaning on PySpark DataFrames."""
