"""Operators for training-data pipelines over whole corpora of text and pages.

Nothing outside this subpackage imports it.  Each module is one operator; ``queries`` binds
the operators to the driver's tables.
"""
