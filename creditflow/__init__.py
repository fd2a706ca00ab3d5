"""Credit-policy data jobs on Spark: DataFrame in, DataFrame out."""
