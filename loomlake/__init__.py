"""loomlake: append-only, event-sourced analytics on Spark DataFrames."""
