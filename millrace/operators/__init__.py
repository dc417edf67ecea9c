"""Conditions and the instructions a pipeline is made of."""
