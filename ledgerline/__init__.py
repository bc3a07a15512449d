"""Personal-finance ledger analytics on Spark DataFrames."""
