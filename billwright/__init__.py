"""Bill-of-quantities analytics on Spark: DataFrame in, DataFrame out."""
