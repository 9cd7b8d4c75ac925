"""tidemark: ledger analytics and data preparation on Spark DataFrames."""
