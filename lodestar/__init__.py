"""Evidence retrieval, admission analytics and corpus preparation on Spark DataFrames."""
