"""Analysis of corpus query workloads with Spark."""
