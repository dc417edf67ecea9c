"""Named flows and gates: add, start, stop, edit, remove and list them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import FlowConfigError
from millrace.functions.paths import safe_id
from millrace.plans.flow import apply_flow, load_config, parse_flow
from millrace.sources import storage
from millrace.streaming import gates
from millrace.streaming.run import checkpoint_path, run_flow

ACTIVE, PASSIVE = "active", "passive"
#: Options of a registry that are not those of its pipelines.
RUN_OPTIONS = ("max_batches", "closed_wait", "log_gate")


class FlowRegistry:
    """Flows and gates under one folder. Configs are kept there, so a new session finds
    the flows of an old one; which of them run is known to the session alone."""

    def __init__(self, spark: SparkSession, root: str, trigger: dict | None = None, **options):
        self.spark, self.root, self.trigger, self.options = spark, root.rstrip("/"), trigger, options
        self._queries: dict[str, StreamingQuery] = {}
        self._held: dict[str, list[str]] = {}
        self._configs: dict[str, str] = {}
        for path in storage.matching(spark, f"{self.root}/flows/*.json"):
            flow = json.loads(storage.read_text(spark, path))
            self._configs[flow["name"]] = flow["config"]

    # -- flows -------------------------------------------------------------------------

    def add(self, name: str, config: dict | str) -> None:
        """Register a flow; it stays passive until it is started."""
        if not name or not name.strip():
            raise FlowConfigError("A flow needs a name that is not blank")
        if any(safe_id(name) == safe_id(other) for other in self._configs):
            raise FlowConfigError(f"Flow {name!r} exists")
        self._keep(name, load_config(config))

    def start(self, name: str) -> StreamingQuery:
        """Start a flow on its checkpoint; a running one goes on."""
        if self.state(name) == ACTIVE:
            return self._queries[name]
        query = run_flow(self.spark, name, self._config(name), self.root, self.trigger, **self.options)
        self._queries[name] = query
        return query

    def stop(self, name: str) -> None:
        """Stop reading; the batch in flight is repeated or found done at the next start."""
        self._config(name)
        query = self._queries.pop(name, None)
        if query is not None:
            query.stop()

    def edit(self, name: str, config: dict | str) -> None:
        """Give a flow a new config. A running flow goes on with it from where it was. A bad
        config is kept for show, while the running flow stays as it is."""
        config = load_config(config)
        old = self._config(name)
        self._keep(name, config)
        if self.state(name) != ACTIVE:
            return
        self._check(config)
        self.stop(name)
        try:
            self.start(name)
        except Exception:
            self._queries[name] = run_flow(self.spark, name, old, self.root, self.trigger, **self.options)
            raise

    def remove(self, name: str) -> None:
        """Stop and forget a flow. What it delivered stays in its gate."""
        self.stop(name)
        storage.delete(self.spark, self._file(name))
        storage.delete(self.spark, checkpoint_path(self.root, "flow", name))
        del self._configs[name]

    def state(self, name: str) -> str:
        self._config(name)
        query = self._queries.get(name)
        return ACTIVE if query is not None and query.isActive else PASSIVE

    def info(self, name: str) -> dict:
        """Name, config and state; ``waiting`` names the closed gate that a running flow waits for."""
        about = {"name": name, "config": self._config(name), "state": self.state(name)}
        if about["state"] == ACTIVE:
            sink = parse_flow(self._configs[name]).sink.gate
            if sink is not None and not gates.is_open(self.spark, sink, self.root):
                about["waiting"] = sink
        return about

    def list(self) -> DataFrame:
        """``name, config, state`` of all flows."""
        rows = [(n, self._configs[n], self.state(n)) for n in sorted(self._configs)]
        return self.spark.createDataFrame(rows, "name string, config string, state string")

    def _config(self, name: str) -> str:
        if name not in self._configs:
            raise FlowConfigError(f"Unknown flow {name!r}")
        return self._configs[name]

    def _file(self, name: str) -> str:
        return f"{self.root}/flows/{safe_id(name)}.json"

    def _keep(self, name: str, config: dict) -> None:
        text = json.dumps(config)
        flow = json.dumps({"name": name, "config": text})
        storage.write_text(self.spark, self._file(name), flow)
        self._configs[name] = text

    def _check(self, config: dict) -> None:
        """Plan a config without starting it."""
        flow = parse_flow(config)
        source = gates.read_entries(self.spark, "", [], gates.known_schema(self.spark, flow.tap.gate, self.root))
        options = {k: v for k, v in self.options.items() if k not in RUN_OPTIONS}
        apply_flow(source, flow.pipeline, "envelope", **options)

    # -- gates -------------------------------------------------------------------------

    def add_gate(self, name: str, schema=None) -> None:
        """Register a gate, open, with the schema its first reader may rely on."""
        path = gates.gate_path(self.root, name)
        if storage.exists(self.spark, path):
            raise FlowConfigError(f"Gate {name!r} exists")
        storage.make_folder(self.spark, path)
        if schema is not None:
            gates.declare(self.spark, name, self.root, "registry", schema)

    def gate_state(self, name: str) -> str:
        if not storage.exists(self.spark, gates.gate_path(self.root, name)):
            raise FlowConfigError(f"Unknown gate {name!r}")
        return ACTIVE if gates.is_open(self.spark, name, self.root) else PASSIVE

    def stop_gate(self, name: str) -> None:
        """Close a gate; flows that write to it wait."""
        self.gate_state(name)
        writers = [n for n in self._queries if self.state(n) == ACTIVE and parse_flow(self._configs[n]).sink.gate == name]
        for flow in writers:
            self.stop(flow)
        self._held.setdefault(name, []).extend(writers)
        gates.set_open(self.spark, name, self.root, False)

    def start_gate(self, name: str) -> None:
        """Open a gate; flows that waited for it go on."""
        self.gate_state(name)
        gates.set_open(self.spark, name, self.root, True)
        for flow in self._held.pop(name, []):
            if flow in self._configs:
                self.start(flow)

    def gate_info(self, name: str) -> dict:
        """Name, state and the schema of what the gate's producers write."""
        schema = gates.gate_schema(self.spark, name, self.root)
        return {"name": name, "state": self.gate_state(name), "schema": schema and schema.simpleString()}

    def remove_gate(self, name: str) -> None:
        """Close a gate, stop what reads or writes it here, and forget its records."""
        self.stop_gate(name)
        self._held.pop(name, None)
        for flow in [n for n in self._queries if self.state(n) == ACTIVE and parse_flow(self._configs[n]).tap.gate == name]:
            self.stop(flow)
        storage.delete(self.spark, gates.gate_path(self.root, name))

    def list_gates(self) -> DataFrame:
        """``name, state`` of all gates."""
        names = sorted(p.rstrip("/").rsplit("/", 1)[1] for p in storage.matching(self.spark, f"{self.root}/gates/*"))
        rows = [(n, self.gate_state(n)) for n in names]
        return self.spark.createDataFrame(rows, "name string, state string")
