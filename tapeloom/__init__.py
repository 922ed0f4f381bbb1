"""tapeloom: market-data analytics expressed as Spark DataFrame plans."""
