"""Compilation of flow configs into DataFrame plans."""
