"""Declarative data pipelines executed as lazy Spark DataFrame plans."""
