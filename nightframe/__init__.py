"""nightframe: bed-sensor analytics and training-data operators as Spark jobs."""
