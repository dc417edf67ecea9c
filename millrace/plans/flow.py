"""Flow configs: checked, and applied to a DataFrame as a chain of transforms."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from millrace.errors import FlowConfigError
from millrace.operators.log import LogStep
from millrace.operators.registry import apply_instruction
from millrace.options import FlowOptions
from millrace.plans.frame import Frame

TAPS = ("gate",)
SINKS = ("blackhole", "gate")


@dataclass(frozen=True)
class Endpoint:
    """A tap or a sink: its class and its gate, if it has one."""

    kind: str
    gate: str | None = None


@dataclass(frozen=True)
class FlowConfig:
    tap: Endpoint
    pipeline: list
    sink: Endpoint


def load_config(config: dict | str) -> dict:
    """A config as a dict, from a dict or from JSON text."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except json.JSONDecodeError as e:
            raise FlowConfigError(f"Config is not JSON: {e}") from None
    if not isinstance(config, dict):
        raise FlowConfigError("Config must be a JSON object")
    return config


def _endpoint(config: dict, branch: str, known: tuple[str, ...]) -> Endpoint:
    part = config.get(branch)
    if not isinstance(part, dict):
        raise FlowConfigError(f"{branch}: the flow config has no such object")
    kind, props = part.get("class"), part.get("props")
    if not isinstance(kind, str):
        raise FlowConfigError(f"{branch}.class: expected the name of a class as text")
    if props is None:
        raise FlowConfigError(f"{branch}.props: expected an object")
    if kind not in known:
        raise FlowConfigError(f"{branch}.class: {kind!r} is none of {', '.join(known)}")
    if kind != "gate":
        return Endpoint(kind)
    name = props.get("name") if isinstance(props, dict) else None
    if not isinstance(name, str):
        raise FlowConfigError(f"{branch}.props.name: expected the name of a gate as text, got {props}")
    return Endpoint(kind, name)


def pipeline_of(config: dict) -> list:
    pipeline = config.get("pipeline")
    if not isinstance(pipeline, list):
        raise FlowConfigError("pipeline: expected a list of steps")
    return pipeline


def parse_flow(config: dict | str) -> FlowConfig:
    """Check that a config names a tap, a pipeline and a sink."""
    config = load_config(config)
    tap = _endpoint(config, "tap", TAPS)
    pipeline = pipeline_of(config)
    return FlowConfig(tap, pipeline, _endpoint(config, "sink", SINKS))


def compile_pipeline(frame: Frame, pipeline: list) -> Frame:
    """Run a frame through the steps, left to right; no steps change nothing."""
    return reduce(apply_instruction, pipeline, frame)


@dataclass(frozen=True)
class FlowResult:
    """Transformed records and the ``log`` steps that report once they are written."""

    df: DataFrame
    logs: tuple[LogStep, ...]


def transform(df: DataFrame, config: dict | str | list, output: str = "same", **options) -> FlowResult:
    """:func:`apply_flow`, with the handles of its ``log`` steps."""
    pipeline = config if isinstance(config, list) else pipeline_of(load_config(config))
    frame = compile_pipeline(Frame.of(df, FlowOptions(**options)), pipeline)
    if output == "same":
        output = "envelope" if frame.enveloped else "table"
    render = {"envelope": frame.to_envelope, "table": frame.to_table, "json": frame.to_json}.get(output)
    if render is None:
        raise FlowConfigError(f"Unknown output {output!r}")
    return FlowResult(render(), frame.logs)


def apply_flow(df: DataFrame, config: dict | str | list, output: str = "same", **options) -> DataFrame:
    """Apply a flow's pipeline to a batch or streaming DataFrame.

    ``config`` is a flow config or only its pipeline. ``output`` is ``table`` (one column
    per top-level field), ``envelope`` (``event`` and ``ctx``) or ``json`` (the event as
    text); by default what came in. ``options`` are those of :class:`FlowOptions`.
    """
    return transform(df, config, output, **options).df
