"""Errors raised while a flow, tap or condition config is compiled."""


class FlowConfigError(ValueError):
    """The config cannot be turned into a plan; the message names the culprit."""
