"""Operators for building language-model training data.

Nothing else in the library imports this subpackage; it only imports Spark,
Arrow and NumPy, so it can be removed as a whole.
"""
