"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it depends only on
PySpark, numpy and the small C helpers named in each module.
"""
