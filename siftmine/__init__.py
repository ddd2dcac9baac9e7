"""siftmine: data mining and corpus preparation on Spark DataFrames."""
