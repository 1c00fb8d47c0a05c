"""Flight-trajectory and separation analytics on Spark DataFrames."""
