"""lodestar: evidence-ranking analytics expressed as Spark DataFrame plans."""
