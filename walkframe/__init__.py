"""walkframe: analytics over collections of graph walks, as PySpark DataFrames."""
