"""loomlens: session-log analytics on Spark DataFrames."""
