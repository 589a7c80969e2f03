"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; numpy and Arrow
appear only inside tasks, on bounded slices of a partition.
"""
