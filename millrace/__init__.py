"""Event flows as Spark plans: JSON flow configs compiled to DataFrame transforms."""

from millrace.errors import FlowConfigError
from millrace.operators.log import FlowLogListener, log_records
from millrace.operators.registry import register_instruction, unregister_instruction
from millrace.options import FlowOptions
from millrace.plans.flow import apply_flow, parse_flow, transform
from millrace.plans.frame import Frame
from millrace.sources.files import (
    cursor_place,
    file_inventory,
    first_file,
    keep_inventory,
    kept_inventory,
    last_file,
    read_rolling,
    stream_rolling,
    with_next,
)
from millrace.sources.json_frames import from_json_frames, stamp_source, to_envelope, to_json_frames
from millrace.sources.tail import TailDataSource, register_tail
from millrace.streaming.delivery import blackhole_sink, fan_out, gate_sink, write_blackhole
from millrace.streaming.gates import GateClosed, clean_gate, compact_gate, drop_duplicates, follow_gate, read_gate, write_gate
from millrace.streaming.latest import conflate, latest_by_key, latest_snapshot, publish_latest, replay_latest
from millrace.streaming.registry import FlowRegistry
from millrace.streaming.run import run_flow, run_tap, tap_stream

__all__ = [
    "FlowConfigError",
    "FlowLogListener",
    "FlowOptions",
    "FlowRegistry",
    "Frame",
    "GateClosed",
    "TailDataSource",
    "apply_flow",
    "blackhole_sink",
    "clean_gate",
    "compact_gate",
    "conflate",
    "cursor_place",
    "drop_duplicates",
    "fan_out",
    "file_inventory",
    "first_file",
    "follow_gate",
    "from_json_frames",
    "gate_sink",
    "keep_inventory",
    "kept_inventory",
    "last_file",
    "latest_by_key",
    "latest_snapshot",
    "log_records",
    "parse_flow",
    "publish_latest",
    "read_gate",
    "read_rolling",
    "register_instruction",
    "register_tail",
    "replay_latest",
    "run_flow",
    "run_tap",
    "stamp_source",
    "stream_rolling",
    "tap_stream",
    "to_envelope",
    "to_json_frames",
    "transform",
    "unregister_instruction",
    "with_next",
    "write_blackhole",
    "write_gate",
]
