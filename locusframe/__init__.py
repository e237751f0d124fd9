"""locusframe: genomic-interval analytics on Spark DataFrames."""
