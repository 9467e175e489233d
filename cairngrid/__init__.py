"""Spatial probability analytics expressed as PySpark DataFrame plans."""
