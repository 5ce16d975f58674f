"""Operators for preparing training data at scale.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames, keeps text on the executors and writes intermediate tables
only below ``spark.checkpoint.dir``.
"""
