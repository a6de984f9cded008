"""pastglass: point-in-time analytics and training-data operators as lazy Spark plans."""
