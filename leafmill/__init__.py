"""Document and spreadsheet analytics on Spark DataFrames."""
