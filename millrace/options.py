"""Settings shared by every step of one flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DecimalType

from millrace.errors import FlowConfigError


@dataclass(frozen=True)
class FlowOptions:
    """How a flow treats numbers, macros and values that cannot be coerced.

    ``precision``/``scale``  type of every number a flow writes
    ``macros``               ``single_pass``: data is never re-expanded;
                             ``recursive``: data holding ``${x}`` is expanded again
    ``max_passes``           bound on ``recursive`` expansion
    ``on_error``             ``fail``: a bad boolean, a number beyond its type, or a macro
                             that is left after ``max_passes`` stops the query;
                             ``null``: the first two become NULL, the macro stays
    ``track_faults``         keep a per-row count of values that became NULL
    """

    precision: int = 38
    scale: int = 18
    macros: str = "single_pass"
    max_passes: int = 8
    on_error: str = "fail"
    track_faults: bool = False

    def __post_init__(self):
        if self.macros not in ("single_pass", "recursive"):
            raise FlowConfigError(f"Unknown macro mode {self.macros!r}")
        if self.on_error not in ("fail", "null"):
            raise FlowConfigError(f"Unknown error policy {self.on_error!r}")
        if self.max_passes < 1:
            raise FlowConfigError("max_passes must be at least 1")

    @property
    def number(self) -> DecimalType:
        return DecimalType(self.precision, self.scale)
