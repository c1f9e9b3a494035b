"""traceloom: evidence-traceability analytics and data preparation on Spark DataFrames."""
