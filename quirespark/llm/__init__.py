"""Operators for preparing large text collections for model training.

Nothing outside this subpackage imports it; delete the folder and the rest
of the library still works.
"""
