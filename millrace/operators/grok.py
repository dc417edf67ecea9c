"""``grok``: pull fields out of a text with a regular expression.

Every match puts its groups into the context, then sets the fields; so plain fields end
with the last match and array fields gather all of them. Two plans give that result:

* *closed*: when no value depends on a field that this step sets, the last match and the
  list of matches say it all, and the step is a handful of codegen'd expressions;
* *fold*: otherwise one ``aggregate`` over the matches carries the fields from match to
  match.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.coerce import same_type
from millrace.errors import FlowConfigError
from millrace.functions.paths import Path, dotted, overlaps, parse_path
from millrace.functions.templates import parse_template
from millrace.operators.conditions import required_text
from millrace.operators.enrich import Setting, apply_setting
from millrace.operators.patterns import check_pattern
from millrace.plans.frame import Frame
from millrace.plans.scope import OVERFLOW_TYPE, VARIANT, Leaf, Scope, check_type, convert, is_variant, unify


# Stands around the groups of a match while they are cut out of a text.
MARK = "\x01"


def _names(props: dict, key: str) -> list[str]:
    # The empty text is one empty name; trailing empty names of other texts fall away.
    text = required_text(props, key, "grok instruction")
    parts = text.split(",")
    while text and parts and not parts[-1]:
        parts.pop()
    return [part.strip() for part in parts]


def grok(frame: Frame, props: dict, cond: Column | None, force_fold: bool = False) -> Frame:
    pattern = required_text(props, "pattern", "grok instruction")
    groups_in_pattern = check_pattern(frame.df.sparkSession, pattern)
    source = required_text(props, "source", "grok instruction")
    fields, types, groups, values = (_names(props, key) for key in ("fields", "types", "groups", "values"))
    settings = [Setting(f, v, check_type(t)) for f, v, t in zip(fields, values, types)]
    # Of two groups with one name the later wins.
    number_of = {name: i for i, name in enumerate(groups[:groups_in_pattern], start=1)}

    text = _source_text(frame.scope, source)
    if cond is not None:
        # A record outside the condition is one without matches.
        text = F.when(cond, text)
    closed = not force_fold and _is_closed(frame.scope, settings, set(number_of))
    plain = all(len(s.code) == 1 for s in settings)
    find = _last_match if closed and plain and len(number_of) > 1 else _all_matches
    frame, found = find(frame, text, pattern, number_of, groups_in_pattern)
    return (_closed if closed else _fold)(frame, settings, found)


@dataclass(frozen=True)
class Found:
    """What the matches hold, by group name: values of the first and last match, and, if
    asked for, lists with a value per match. ``each`` has an item per match."""

    hit: Column
    first: dict[str, Column]
    last: dict[str, Column]
    lists: dict[str, Column] | None = None
    each: Column | None = None


def _extract(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.coalesce(found, F.array().cast("array<string>"))


def _all_matches(frame: Frame, text: Column, pattern: str, number_of: dict[str, int], _: int) -> tuple[Frame, Found]:
    """One search per group that has a name."""
    wanted = sorted(set(number_of.values())) or [0]
    frame, bound = frame.bind(**{f"match{i}_": _extract(text, pattern, i) for i in wanted})
    lists = {name: bound[f"match{i}_"] for name, i in number_of.items()}
    each = bound[f"match{wanted[0]}_"]
    return frame, Found(
        F.size(each) > 0,
        {name: F.get(items, F.lit(0)) for name, items in lists.items()},
        {name: F.try_element_at(items, F.lit(-1)) for name, items in lists.items()},
        lists,
        each,
    )


def _last_match(frame: Frame, text: Column, pattern: str, number_of: dict[str, int], count: int) -> tuple[Frame, Found]:
    """One search for all groups: each match is replaced by its groups between marks, and
    the text is cut at the marks. A text that has marks itself is searched per group."""
    marks = MARK + "".join(f"${i}{MARK}" for i in range(1, count + 1))
    frame, bound = frame.bind(source=text)
    source = bound["source"]
    frame, bound = frame.bind(parts=F.split(F.regexp_replace(source, pattern, marks), MARK))
    parts, marked = bound["parts"], source.contains(MARK)

    def pick(group: int, at: int, listed: int) -> Column:
        slow = F.try_element_at(_extract(source, pattern, group), F.lit(listed))
        return F.when(marked, slow).otherwise(F.try_element_at(parts, F.lit(at)))

    hit = F.when(marked, source.rlike(pattern)).otherwise(F.size(parts) > 1)
    return frame, Found(
        F.coalesce(hit, F.lit(False)),
        {name: pick(i, i + 1, 1) for name, i in number_of.items()},
        # Behind the last group stands the rest of the text.
        {name: F.when(F.size(parts) > 1, pick(i, i - count - 2, -1)) for name, i in number_of.items()},
    )


def _source_text(scope: Scope, source: str) -> Column:
    fixed = parse_template(source).text
    return scope.lookup(fixed) if fixed is not None else scope.lookup_by(scope.expand(source))


def _fixed_path(setting: Setting) -> Path | None:
    name = parse_template(setting.name).text
    return None if name is None else parse_path(name)


def _with_groups(scope: Scope, values: dict[str, Column]) -> Scope:
    return replace(scope, ctx={**scope.ctx, **values})


def _last_groups(scope: Scope, found: Found) -> dict[str, Column]:
    return {name: F.coalesce(col, scope.ctx[name]) if name in scope.ctx else col for name, col in found.last.items()}


# -- closed form ---------------------------------------------------------------


def _is_closed(scope: Scope, settings: list[Setting], groups: set[str]) -> bool:
    paths = [_fixed_path(s) for s in settings]
    if None in paths or scope.overflow is not None:
        return False
    if any(overlaps(a, b) for i, a in enumerate(paths) for b in paths[:i]):
        return False
    for setting, path in zip(settings, paths):
        if len(setting.code) == 2 and not _plain_array(scope, setting, path):
            return False
        names = scope.names_read(setting.value)
        if names is None:
            return False
        for read in map(parse_path, names):
            clash = [p for p in paths if overlaps(read, p)]
            if clash and not (clash == [path] and _reads_itself(scope, setting, groups)):
                return False
    return True


def _plain_array(scope: Scope, setting: Setting, path: Path) -> bool:
    """The field is absent or already an array of the very type to be added."""
    if any(p != path and overlaps(p, path) for p in scope.leaves):
        return False
    leaf = scope.leaves.get(path)
    element = scope.coerce(F.lit(""), setting.code)[0].dtype
    return leaf is None or same_type(leaf.dtype, T.ArrayType(element))


def _reads_itself(scope: Scope, setting: Setting, groups: set[str]) -> bool:
    """``level = ${level}``: an event value hides the group of the same name, so the
    field keeps the value it has, or gets that of the first match."""
    name = setting.name
    if len(setting.code) != 1 or name not in groups or parse_template(setting.value).single_name != name:
        return False
    leaf = scope.leaves.get(parse_path(name))
    wanted = scope.coerce(F.lit(""), setting.code)[0].dtype
    return not scope.subtree(parse_path(name)) and (leaf is None or same_type(leaf.dtype, wanted))


def _closed(frame: Frame, settings: list[Setting], found: Found) -> Frame:
    scope = after = frame.scope
    inside = _with_groups(scope, found.last)
    for setting in settings:
        path = _fixed_path(setting)
        if len(setting.code) == 2:
            after = _gather(after, scope, path, setting, found)
        elif _reads_itself(scope, setting, set(found.last)):
            after = _first_value(after, path, setting, found)
        else:
            after = after.assign(path, inside.expand(setting.value), setting.code, found.hit)
    return frame.commit(scope, replace(after, ctx={**scope.ctx, **_last_groups(scope, found)}))


def _first_value(after: Scope, path: Path, setting: Setting, found: Found) -> Scope:
    value, fault = after.coerce(found.first[setting.name], setting.code)
    column = value.column
    old = after.leaves.get(path)
    if old is not None:
        column = F.coalesce(old.column, column)
        fault = None if fault is None else old.column.isNull() & fault
    return after.put(path, Leaf(column, value.dtype), setting.code, found.hit).with_fault(fault, found.hit)


def _gather(after: Scope, scope: Scope, path: Path, setting: Setting, found: Found) -> Scope:
    """Append one value per match in one go."""
    name, matches, hit = parse_template(setting.value).single_name, found.lists, found.hit
    if name in matches and scope.event_text(parse_path(name)) is None:
        texts = matches[name]
    else:
        texts = F.transform(
            found.each,
            lambda _, i: _with_groups(scope, {n: F.get(items, i) for n, items in matches.items()}).expand(setting.value),
        )
    element = scope.coerce(F.lit(""), setting.code)[0].dtype
    items = texts
    fault = None
    if not isinstance(element, T.StringType):
        items = F.array_compact(F.transform(texts, lambda t: scope.coerce(t, setting.code)[0].column))
        fault = F.exists(texts, lambda t: scope.coerce(t, setting.code)[1])
    target = T.ArrayType(element)
    old = scope.leaves.get(path)
    if old is None:
        column = F.when(hit, F.array_distinct(items))
    else:
        present = F.coalesce(old.column, F.array().cast(target))
        column = F.when(hit, F.array_union(present, items)).otherwise(old.column)
    return replace(after, leaves={**after.leaves, path: Leaf(column, target)}).with_fault(fault, hit)


# -- fold ----------------------------------------------------------------------


def _fold(frame: Frame, settings: list[Setting], found: Found) -> Frame:
    frame, loose = _loosened(frame, settings)
    scope, matches = frame.scope, found.lists
    types, changed = _stable_types(scope, settings, matches, loose)
    dynamic = scope.overflow is not None or any(_fixed_path(s) is None for s in settings)
    options = scope.options

    def pack(leaves: dict[Path, Leaf], overflow: Column | None, faults: Column | None) -> Column:
        parts = []
        for i, path in enumerate(changed):
            leaf = leaves.get(path)
            column = F.lit(None).cast(types[path]) if leaf is None else convert(leaf, types[path])
            parts.append(column.alias(f"f{i}"))
        if dynamic:
            empty = F.create_map().cast(OVERFLOW_TYPE)
            parts.append((empty if overflow is None else overflow).alias("late"))
        if options.track_faults:
            parts.append(faults.alias("faults"))
        return F.struct(*(parts or [F.lit(0).alias("none")]))

    def merge(state: Column, index: Column) -> Column:
        carried = {path: Leaf(state[f"f{i}"], types[path]) for i, path in enumerate(changed)}
        inside = replace(
            scope,
            leaves={**scope.leaves, **carried},
            ctx={**scope.ctx, **{name: F.get(items, index) for name, items in matches.items()}},
            overflow=state["late"] if dynamic else None,
            faults=state["faults"] if options.track_faults else None,
        )
        for setting in settings:
            inside = _set_in_fold(inside, setting, loose)
        return pack(inside.leaves, inside.overflow, inside.faults)

    start = pack(scope.leaves, scope.overflow, scope.faults)
    indexes = F.transform(found.each, lambda _, i: i)
    frame, bound = frame.bind(fold=F.aggregate(indexes, start, merge))
    state = bound["fold"]
    scope = frame.scope
    after = replace(
        scope,
        leaves={
            **scope.leaves,
            **{path: Leaf(state.getField(f"f{i}"), types[path]) for i, path in enumerate(changed)},
        },
        ctx={**scope.ctx, **_last_groups(scope, found)},
        overflow=state.getField("late") if dynamic else None,
        faults=state.getField("faults") if options.track_faults else None,
    )
    return frame.commit(scope, after)


def _set_in_fold(scope: Scope, setting: Setting, loose: set[Path]) -> Scope:
    """One set; a field without a fixed shape stays one whatever it is set to."""
    scope, path = apply_setting(scope, setting, None), _fixed_path(setting)
    if path not in loose or is_variant(scope.leaves[path].dtype):
        return scope
    return replace(scope, leaves={**scope.leaves, path: Leaf(convert(scope.leaves[path], VARIANT), VARIANT)})


def _loosened(frame: Frame, settings: list[Setting]) -> tuple[Frame, set[Path]]:
    """The frame with every field whose structure a match may change as one value without a
    fixed shape, so that it has the same type before and after any match. Sets below such a
    field patch it; a set of the field itself replaces it."""
    scope = frame.scope
    paths = [p for p in map(_fixed_path, settings) if p is not None]
    # Sets of a map's keys leave it the map it is.
    other = [q for q in (*scope.leaves, *paths) if q not in scope.leaves or not isinstance(scope.leaves[q].dtype, T.MapType)]
    tops = {min(p, q, key=len) for p in paths for q in other if p != q and overlaps(p, q)}
    loose = [t for t in tops if t in scope.leaves and is_variant(scope.leaves[t].dtype)]
    for top in sorted(tops - set(loose)):
        if any(other != top and other == top[: len(other)] for other in tops):
            continue  # a part of one that is loosened as a whole
        if scope.overflow is not None:
            raise FlowConfigError(f"{dotted(top)!r}: a match cannot change the shape of a field beside fields whose names come from data")
        scope = scope.loosened(top)
    return frame.commit(frame.scope, scope), {p for p in paths if p in scope.leaves and is_variant(scope.leaves[p].dtype)}


def _stable_types(scope: Scope, settings: list[Setting], matches, loose: set[Path]) -> tuple[dict[Path, T.DataType], list[Path]]:
    """Types that fields can hold before and after any match, and the fields a match
    changes. Only the types of the trial expressions are looked at."""
    types = {path: leaf.dtype for path, leaf in scope.leaves.items()}
    while True:
        before = {path: Leaf(F.lit(None).cast(dtype), dtype) for path, dtype in types.items()}
        trial = replace(scope, leaves=before, ctx={**scope.ctx, **{name: F.lit("") for name in matches}})
        for setting in settings:
            trial = _set_in_fold(trial, setting, loose)
        grown = {
            path: unify(types[path], leaf.dtype, scope.options.number) if path in types else leaf.dtype
            for path, leaf in trial.leaves.items()
        }
        if all(path in types and same_type(types[path], dtype) for path, dtype in grown.items()):
            return types, [path for path, leaf in trial.leaves.items() if before.get(path) is not leaf]
        types = grown
