"""Object-graph (heap snapshot) analytics on Spark."""
