"""quern: machine-learning operators over Spark DataFrames."""
