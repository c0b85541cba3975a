"""tvloom: playlist and programme-guide integration on Spark DataFrames."""
