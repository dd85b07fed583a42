"""dugout: play-by-play analytics on Spark DataFrames."""
