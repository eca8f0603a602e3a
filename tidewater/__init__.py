"""Time-series analytics on Spark: DataFrame in, DataFrame out."""
