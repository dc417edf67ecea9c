"""The instructions a pipeline can name, and how users add their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame

from millrace.errors import FlowConfigError
from millrace.functions.paths import ctx_column, leaf_column, quoted
from millrace.operators.conditions import as_column, compile_condition, required_text
from millrace.operators.drop import drop
from millrace.operators.enrich import enrich
from millrace.operators.grok import grok
from millrace.operators.log import log
from millrace.plans.frame import CTX_MAP, FAULTS, OVERFLOW, Frame, flatten, table_columns

Instruction = Callable[[Frame, dict, Column | None], Frame]
TableInstruction = Callable[[DataFrame, dict, Column], DataFrame]

_instructions: dict[str, Instruction] = {"enrich": enrich, "grok": grok, "log": log, "drop": drop}

CONDITION = "x:condition"


def register_instruction(name: str, fn: TableInstruction) -> None:
    """Add an instruction ``fn(df, props, cond) -> df``.

    ``df`` has the event's top-level fields as columns, ``cond`` is a boolean column of it
    that says for which records the step applies. Columns named ``c:...`` and ``x:...``
    belong to the engine and must be kept.
    """
    if name in _instructions:
        raise FlowConfigError(f"Instruction {name!r} exists")
    _instructions[name] = lambda frame, props, cond: _on_table(fn, frame, props, cond)


def unregister_instruction(name: str) -> None:
    """Remove a user's instruction."""
    if name in ("enrich", "grok", "log", "drop"):
        raise FlowConfigError(f"Instruction {name!r} is built in")
    _instructions.pop(name, None)


def apply_instruction(frame: Frame, step: dict) -> Frame:
    """One pipeline step: where its condition fails, a record passes unchanged."""
    if not isinstance(step, dict):
        raise FlowConfigError(f"step: expected an object, got {step!r}")
    name = required_text(step, "class", "step")
    if step.get("props") is None:
        raise FlowConfigError(f"step {name!r}: expected an object under 'props', got {step}")
    if name not in _instructions:
        raise FlowConfigError(f"step: {name!r} is none of {', '.join(_instructions)}")
    test = compile_condition(step.get("condition"), frame.scope, frame.df.sparkSession)
    props = step["props"] if isinstance(step["props"], dict) else {}
    # A test that is known now still lets the step check its own config.
    cond = None if test is True else as_column(test)
    return _instructions[name](frame, props, cond)


def _on_table(fn: TableInstruction, frame: Frame, props: dict, cond: Column | None) -> Frame:
    private = [ctx_column(n) for n in frame.ctx]
    private += [n for n, used in ((CTX_MAP, frame.ctx_map), (OVERFLOW, frame.overflow)) if used]
    if frame.options.track_faults:
        private.append(FAULTS)
    renamed = {n: f"x:extra:{n}" for n in frame.extra}
    bound = frame.df.withColumn(CONDITION, as_column(True) if cond is None else cond)
    df = bound.select(
        *table_columns(frame.scope.leaves),
        *[quoted(n) for n in private],
        *[quoted(n).alias(r) for n, r in renamed.items()],
        quoted(CONDITION),
    )
    out = fn(df, props, quoted(CONDITION))
    missing = [n for n in [*private, *renamed.values()] if n not in out.columns]
    if missing:
        raise FlowConfigError(f"The instruction dropped engine columns: {', '.join(missing)}")
    kept = [*private, *renamed.values(), CONDITION]
    fields = [f for f in out.schema.fields if f.name not in kept]
    inner = flatten(fields)
    df = out.select(
        *[col.alias(leaf_column(path)) for path, col, _ in inner],
        *[quoted(n) for n in private],
        *[quoted(r).alias(n) for n, r in renamed.items()],
    )
    return replace(frame, df=df, leaves={path: dtype for path, _, dtype in inner})
