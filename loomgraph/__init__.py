"""Graph learning tables and corpus preparation on PySpark DataFrames."""
