"""helixframe: sequence and annotation analytics on Spark DataFrames."""
