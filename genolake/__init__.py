"""genolake: quantitative-genetics analytics expressed as Spark DataFrame jobs."""
