"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; it imports nothing of the
library's other subpackages either, so it can be removed as a whole.
"""
