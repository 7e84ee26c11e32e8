"""Sparse-basis analytics over collections of small matrices, as Spark jobs."""
