"""``enrich``: set fields from templates in order, then add tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FlowConfigError
from millrace.functions.coerce import same_type
from millrace.functions.paths import overlaps, parse_path
from millrace.functions.templates import parse_template
from millrace.operators.conditions import optional_text, required_text
from millrace.plans.frame import Frame
from millrace.plans.scope import Leaf, Scope, check_type


@dataclass(frozen=True)
class Setting:
    """One assignment: templates of the name and the value, and the type to set."""

    name: str
    value: str
    code: str


def settings_of(props: dict) -> list[Setting]:
    found = []
    for entry in _list(props, "fields"):
        if not isinstance(entry, dict):
            raise FlowConfigError(f"enrich.fields: expected objects, got {entry!r}")
        name = required_text(entry, "name", "enrich field")
        if entry.get("value") is None:
            raise FlowConfigError(f"enrich field {name!r}: expected something under 'value'")
        # Only a text is a template; any other value stands for the empty text.
        value = optional_text(entry, "value") or ""
        found.append(Setting(name, value, check_type(optional_text(entry, "type") or "s")))
    for tag in _list(props, "tags"):
        found.append(Setting("tags", tag if isinstance(tag, str) else "", "as"))
    return found


def _list(props: dict, key: str) -> list:
    value = props.get(key)
    return value if isinstance(value, list) else []


def apply_setting(
    scope: Scope, setting: Setting, cond: Column | None, text: Column | None = None, name: Column | None = None
) -> Scope:
    """One assignment. ``text`` and ``name`` are the expanded templates, if at hand."""
    fixed = parse_template(setting.name).text
    number = _plain_number(scope, setting)
    if fixed is not None and number is not None:
        return scope.put(parse_path(fixed), number, setting.code, cond)
    if text is None:
        text = scope.expand(setting.value)
    if fixed is not None:
        after = scope.assign(parse_path(fixed), text, setting.code, cond)
    else:
        after = scope.assign_by(scope.expand(setting.name) if name is None else name, text, setting.code, cond)
    return after.with_fault(scope.expansion_fault(setting.value, text), cond)


def _plain_number(scope: Scope, setting: Setting) -> Leaf | None:
    """The number itself, where its way through text would change nothing."""
    name = parse_template(setting.value).single_name
    leaf = None if name is None or setting.code != "n" else scope.plain_leaf(name)
    number = scope.options.number
    if leaf is None or number.precision - number.scale < 19:
        return None
    if not isinstance(leaf.dtype, T.IntegralType) and not same_type(leaf.dtype, number):
        return None
    return Leaf(F.coalesce(leaf.column.cast(number), F.lit(0).cast(number)), number)


def _touches(scope: Scope, setting: Setting, changed: set) -> bool:
    """Whether a setting reads or writes what an earlier one has changed."""
    if not changed:
        return False
    read = [scope.names_read(setting.name), scope.names_read(setting.value)]
    if None in read or None in changed or parse_template(setting.name).text is None:
        return True
    touched = {parse_path(n) for names in read for n in names} | {parse_path(parse_template(setting.name).text)}
    return any(overlaps(a, b) for a in touched for b in changed)


def enrich(frame: Frame, props: dict, cond: Column | None) -> Frame:
    settings = settings_of(props)
    if cond is not None and len(settings) > 1:
        # The condition sees the record as it came in, whatever is set meanwhile.
        frame, names = frame.bind(cond=cond)
        cond = names["cond"]
    before = scope = frame.scope
    changed: set = set()
    for setting in settings:
        if _touches(scope, setting, changed):
            frame = frame.commit(before, scope)
            before = scope = frame.scope
            changed = set()
        fixed = parse_template(setting.name).text
        if fixed is None or scope.overflow is not None or scope.options.macros == "recursive":
            # Costly texts that are used more than once get a column of their own.
            frame = frame.commit(before, scope)
            frame, bound = frame.bind(text=frame.scope.expand(setting.value), name=frame.scope.expand(setting.name))
            before = scope = frame.scope
            scope = apply_setting(scope, setting, cond, **bound)
            changed = set()
        else:
            scope = apply_setting(scope, setting, cond)
        changed.add(parse_path(fixed) if fixed is not None else None)
    return frame.commit(before, scope)
