"""``log``: let records pass while counting them.

A line per record would drown any log at scale, so each ``log`` step reports through an
observed metric: how many records met its condition and, with ``"sample": true`` among its
props, one of them as JSON. A sample makes the step read every field; counting does not.

The records themselves are a table, :func:`log_records`: those that met each step, as they
were there, with the step's place, logger and level. :func:`millrace.run_flow` writes them to a
gate of their own (``log_gate``) under the batch that its sink gets.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from millrace.errors import FlowConfigError
from millrace.operators.conditions import optional_text
from millrace.plans.frame import Frame

# Levels a config may name.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
PREFIX = "millrace.log"


def _emit(logger: str, level: str, step: str, count: int, sample: str | None) -> None:
    code = logging.WARNING if level == "WARN" else getattr(logging, level)
    logging.getLogger(logger).log(code, "%s: %d records%s", step, count or 0, "" if sample is None else f", sample {sample}")


@dataclass(frozen=True)
class LogStep:
    """What a ``log`` step will report once the plan has run."""

    logger: str
    level: str
    metric: str
    observation: Observation | None
    records: DataFrame | None = None

    def report(self) -> dict:
        """Batch only: wait for the metrics, log them and return them."""
        values = self.observation.get
        _emit(self.logger, self.level, self.metric, values["records"], values["sample"])
        return values


def metric_name(position: int, level: str, logger: str) -> str:
    return f"{PREFIX}:{position}:{level}:{logger}"


def log(frame: Frame, props: dict, cond: Column | None) -> Frame:
    level = (optional_text(props, "level") or "INFO").upper()
    logger = optional_text(props, "logger") or "default"
    if level not in LEVELS:
        raise FlowConfigError(f"Unknown log level {level!r}; known levels: {', '.join(LEVELS)}")
    metric = metric_name(len(frame.logs), level, logger)
    hit = F.lit(True) if cond is None else cond
    # first() over the typed event keeps JSON rendering out of the per-record work.
    wanted = props.get("sample") is True
    sample = F.to_json(F.first(F.when(hit, frame.event()), ignorenulls=True)) if wanted else F.lit(None).cast("string")
    # A metric has to aggregate.
    sample = sample if wanted else F.max(sample)
    observation = None if frame.df.isStreaming else Observation(metric)
    df = frame.df.observe(
        observation or metric,
        F.count(F.when(hit, F.lit(1))).alias("records"),
        sample.alias("sample"),
    )
    seen = frame.df.where(hit).select(
        F.lit(len(frame.logs)).alias("step"), F.lit(logger).alias("logger"), F.lit(level).alias("level"), frame.scope.event_json().alias("record")
    )
    step = LogStep(logger, level, metric, observation, seen)
    return replace(frame, df=df, logs=(*frame.logs, step))


def log_records(spark: SparkSession, steps: tuple[LogStep, ...] | list[LogStep]) -> DataFrame:
    """``step, logger, level, record``: every record that met a ``log`` step, as JSON."""
    out = spark.createDataFrame([], "step int, logger string, level string, record string")
    for step in steps:
        out = out.unionAll(step.records)
    return out


def listen(spark) -> None:
    """Let this session's flows write their ``log`` steps to Python loggers."""
    if not getattr(spark, "_millrace_listens", False):
        spark._millrace_listens = True
        spark.streams.addListener(FlowLogListener())


class FlowLogListener(StreamingQueryListener):
    """Writes the ``log`` metrics of every streaming micro-batch to Python loggers."""

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        for name, row in (event.progress.observedMetrics or {}).items():
            if name.startswith(PREFIX + ":") and row["records"]:
                _, _, level, logger = name.split(":", 3)
                _emit(logger, level, event.progress.name or str(event.progress.id), row["records"], row["sample"])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            logging.getLogger("default").error("query %s failed: %s", event.id, json.dumps(event.exception))
