"""Score-following analytics, and the relational core under it, on Spark DataFrames."""
