"""textfacts: analytics over source trees, logs and text corpora on Spark DataFrames."""
