"""factweave: structural analytics and table operators on Spark DataFrames."""
