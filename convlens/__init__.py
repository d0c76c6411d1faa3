"""Analytics over conversation archives as Spark jobs."""
