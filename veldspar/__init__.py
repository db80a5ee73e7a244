"""Analytics over multi-rate sensor sessions and data shaped like them, on Spark."""
