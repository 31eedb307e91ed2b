"""factloom: a document register engine on Spark DataFrames."""
