"""Registry trees, their change logs and their binary images as Spark DataFrames."""
