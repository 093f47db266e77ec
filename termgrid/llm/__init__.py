"""Training-data operators: thirteen large-scale text and vector jobs on Spark.

Nothing outside this subpackage imports it.
"""
