"""penprint: writing-style measurement and corpus preparation on Spark DataFrames."""
