"""docloom: document analytics and hybrid retrieval expressed as Spark DataFrames."""
