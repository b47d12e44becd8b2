"""Point-in-time market-panel operators for Spark: DataFrame in, DataFrame out."""
