"""Scalar functions of the engine: paths, coercions and templates."""
