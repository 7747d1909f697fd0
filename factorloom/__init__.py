"""Implicit-feedback recommendation analytics, expressed as Spark DataFrame plans."""
