"""meshline: network, spatial and training-data operators as Spark jobs."""
