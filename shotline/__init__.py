"""shotline: moment retrieval and analytics expressed as Spark DataFrames."""
