"""Sample pipelines, dataset operators and model evaluation on Spark DataFrames."""
