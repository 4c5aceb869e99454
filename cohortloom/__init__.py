"""Evidence retrieval, study analytics and longitudinal records on Spark DataFrames."""
