"""Dataset-assembly analytics expressed as Spark DataFrame plans."""
