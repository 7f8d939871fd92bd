"""Multi-vector retrieval and corpus operators as Spark DataFrame programs."""
