"""Operators for training-data pipelines.

Nothing outside this package imports it: the registry in ``__spark_entry__``
picks it up when it is there.
"""
