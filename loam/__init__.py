"""Analytics over memories and metrics collected from many systems, as lazy Spark DataFrame operators."""
