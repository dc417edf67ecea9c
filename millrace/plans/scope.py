"""What one record looks like while a flow is compiled.

A :class:`Scope` maps every event path to a Catalyst expression and its type, and every
context key to an expression. Lookups read it; assignments return a new scope. Nothing
here touches data: the expressions become ``withColumns`` in :mod:`millrace.plans.frame`
or the accumulator of an ``aggregate`` in :mod:`millrace.operators.grok`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FlowConfigError
from millrace.functions import coerce
from millrace.functions.coerce import VARIANT, is_variant, same_type, to_variant
from millrace.functions.paths import Path, dotted, overlaps, parse_path
from millrace.functions.templates import Macro, Template, parse_template
from millrace.options import FlowOptions

# Fixed value: the last macro of a text; "." stops at line ends.
LAST_MACRO = r"\A.*[$][{]([^}]+)[}].*\z"

# A late field while JSON text is put together.
ENTRY = "struct<path:array<string>,json:string>"

OVERFLOW_TYPE = T.MapType(T.StringType(), T.StringType())


@dataclass(frozen=True)
class Leaf:
    column: Column
    dtype: T.DataType


def unify(a: T.DataType, b: T.DataType, number: T.DecimalType) -> T.DataType:
    """Type that holds both without loss; VARIANT when there is no closer one."""
    exact = (T.IntegralType, T.DecimalType)
    if same_type(a, b):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, exact) and isinstance(b, exact):
        if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
            return T.LongType()
        decimals = [t for t in (a, b) if isinstance(t, T.DecimalType)]
        if all(same_type(t, number) for t in decimals) and number.precision - number.scale >= 19:
            return number
        return VARIANT
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        element = unify(a.elementType, b.elementType, number)
        return VARIANT if is_variant(element) else T.ArrayType(element)
    return VARIANT


def convert(leaf: Leaf, target: T.DataType) -> Column:
    if same_type(leaf.dtype, target):
        return leaf.column
    if is_variant(target):
        return to_variant(leaf.column, leaf.dtype)
    return leaf.column.cast(target)


def nest(leaves: dict[Path, Leaf], depth: int = 0) -> Column:
    """Object holding ``leaves``; an inner object without any value is NULL."""
    heads: dict[str, dict[Path, Leaf]] = {}
    for path, leaf in leaves.items():
        heads.setdefault(path[depth], {})[path] = leaf
    fields = []
    for head, group in heads.items():
        if len(group) == 1 and len(next(iter(group))) == depth + 1:
            field = next(iter(group.values())).column
        else:
            filled = reduce(Column.__or__, [leaf.column.isNotNull() for leaf in group.values()])
            field = F.when(filled, nest(group, depth + 1))
        fields.append(field.alias(head))
    return F.struct(*fields)


def _for_json(leaves: dict[Path, Leaf]) -> dict[Path, Leaf]:
    return {path: Leaf(*coerce.plain_decimals(leaf.column, leaf.dtype)) for path, leaf in leaves.items()}


def _variants(leaf: Leaf) -> Column:
    return F.transform(leaf.column, lambda x: to_variant(x, leaf.dtype.elementType))


def _distinct_variants(items: Column) -> Column:
    # Variants cannot be compared, their JSON can.
    texts = F.array_distinct(F.transform(items, lambda x: F.to_json(x)))
    return F.transform(texts, lambda t: F.parse_json(t))


def append(old: Leaf | None, new: Leaf, number: T.DecimalType) -> Leaf:
    """Set-append: an array grows and loses duplicates, another value starts an array
    of two, an absent one starts an array of one."""
    one = F.array(new.column)
    if not isinstance(new.dtype, T.StringType):
        one = F.array_compact(one)
    if old is None:
        return Leaf(one, T.ArrayType(new.dtype))
    if isinstance(old.dtype, T.ArrayType):
        element = unify(old.dtype.elementType, new.dtype, number)
        if not is_variant(element):
            target = T.ArrayType(element)
            present = F.coalesce(old.column.cast(target), F.array().cast(target))
            return Leaf(F.array_union(present, one.cast(target)), target)
        items = F.concat(F.coalesce(_variants(old), F.array().cast(T.ArrayType(VARIANT))), _variants(Leaf(one, T.ArrayType(new.dtype))))
        return Leaf(_distinct_variants(items), T.ArrayType(VARIANT))
    if is_variant(old.dtype):
        added = _variants(Leaf(one, T.ArrayType(new.dtype)))
        items = F.try_variant_get(old.column, "$", "array<variant>")
        grown = (
            F.when(old.column.isNull(), added)
            .when(items.isNull(), F.concat(F.array(old.column), added))
            .otherwise(_distinct_variants(F.concat(items, added)))
        )
        return Leaf(grown, T.ArrayType(VARIANT))
    element = unify(old.dtype, new.dtype, number)
    first = F.array_compact(F.array(convert(old, element)))
    added = _variants(Leaf(one, T.ArrayType(new.dtype))) if is_variant(element) else one.cast(T.ArrayType(element))
    return Leaf(F.concat(first, added), T.ArrayType(element))


@dataclass(frozen=True)
class Scope:
    """``leaves`` by path, ``ctx`` by raw name (``ctx_map`` for names known only at run
    time), ``overflow`` JSON texts of fields whose *name* came from data, ``faults`` the
    record's count of values that became NULL."""

    options: FlowOptions
    leaves: dict[Path, Leaf]
    ctx: dict[str, Column]
    ctx_map: Column | None = None
    overflow: Column | None = None
    faults: Column | None = None

    # -- lookups ---------------------------------------------------------------

    def subtree(self, path: Path) -> dict[Path, Leaf]:
        return {p: leaf for p, leaf in self.leaves.items() if len(p) > len(path) and p[: len(path)] == path}

    def _typed(self, path: Path) -> Leaf | None:
        """Value at a path by the typed leaves alone."""
        if path in self.leaves:
            return self.leaves[path]
        below = self.subtree(path)
        if below:
            kept = {p[len(path):]: leaf for p, leaf in below.items()}
            filled = reduce(Column.__or__, [leaf.column.isNotNull() for leaf in below.values()])
            return Leaf(F.when(filled, nest(kept)), T.StructType())
        for cut in range(len(path) - 1, 0, -1):
            holder = self.leaves.get(path[:cut])
            if holder is None:
                continue
            rest = path[cut:]
            if is_variant(holder.dtype):
                inner = "$" + "".join("['" + key.replace("'", "\\'") + "']" for key in rest)
                return Leaf(F.try_variant_get(holder.column, inner, "variant"), VARIANT)
            if isinstance(holder.dtype, T.MapType) and len(rest) == 1:
                return Leaf(F.try_element_at(holder.column, F.lit(rest[0])), holder.dtype.valueType)
            return None
        return None

    def value(self, path: Path) -> Leaf | None:
        """Value at a path, fields set under data-made names included."""
        leaf = self._typed(path)
        if self.overflow is None:
            return leaf
        late = F.try_parse_json(F.try_element_at(self.overflow, F.lit(dotted(path))))
        if leaf is None:
            return Leaf(late, VARIANT)
        early = F.when(~self._shadowed(path), to_variant(leaf.column, leaf.dtype))
        return Leaf(F.coalesce(late, early), VARIANT)

    def _shadowed(self, path: Path) -> Column:
        return F.exists(F.map_keys(self.overflow), lambda key: _touching(key, path))

    def event_text(self, path: Path) -> Column | None:
        """Text of an event value, NULL where absent; None if it never exists."""
        leaf = self._typed(path)
        early = None if leaf is None else coerce.to_text(leaf.column, leaf.dtype)
        if self.overflow is None:
            return early
        late = coerce.json_to_text(F.try_element_at(self.overflow, F.lit(dotted(path))))
        return late if early is None else F.coalesce(late, F.when(~self._shadowed(path), early))

    def plain_leaf(self, name: str) -> Leaf | None:
        """The typed column behind a name, if nothing else can answer for it."""
        path = parse_path(name)
        if self.overflow is None and self.ctx_map is None and name not in self.ctx:
            return self.leaves.get(path)
        return None

    def lookup(self, name: str) -> Column:
        """Event value, else context value, else empty text."""
        found = [self.event_text(parse_path(name)), self.ctx.get(name)]
        if self.ctx_map is not None:
            found.append(F.try_element_at(self.ctx_map, F.lit(name)))
        return F.coalesce(*[c for c in found if c is not None], F.lit(""))

    def _by_name(self, name: Column, render) -> Column:
        # One CASE branch per known path: only the chosen one is evaluated.
        branches = F.when(F.lit(False), F.lit(None).cast("string"))
        inner = {path[:n] for path in self.leaves for n in range(1, len(path))}
        for path in [*self.leaves, *sorted(inner)]:
            leaf = self._typed(path)
            branches = branches.when(name == dotted(path), render(leaf.column, leaf.dtype))
        for path, leaf in self.leaves.items():
            start = dotted(path) + "."
            if isinstance(leaf.dtype, T.MapType):
                key = F.substring(name, F.lit(len(start) + 1), F.length(name))
                item = F.try_element_at(leaf.column, key)
                branches = branches.when(name.startswith(start), render(item, leaf.dtype.valueType))
            elif is_variant(leaf.dtype):
                rest = F.substring(name, F.lit(len(start)), F.length(name))
                item = F.call_function("get_json_object", F.to_json(leaf.column), F.concat(F.lit("$"), rest))
                branches = branches.when(name.startswith(start), item)
        return branches

    def _event_by(self, name: Column, as_json: bool) -> Column:
        typed = self._by_name(name, coerce.to_json_text if as_json else coerce.to_text)
        if self.overflow is None:
            return typed
        late = F.try_element_at(self.overflow, name)
        hidden = F.exists(F.map_keys(self.overflow), lambda key: _overlapping(key, name))
        return F.coalesce(late if as_json else coerce.json_to_text(late), F.when(~hidden, typed))

    def lookup_by(self, name: Column) -> Column:
        """:meth:`lookup` under a name that only the record knows."""
        found = [self._event_by(_normal(name), False)]
        if self.ctx:
            branches = F.when(F.lit(False), F.lit(None).cast("string"))
            for key, col in self.ctx.items():
                branches = branches.when(name == key, col)
            found.append(branches)
        if self.ctx_map is not None:
            found.append(F.try_element_at(self.ctx_map, name))
        return F.coalesce(*found, F.lit(""))

    # -- macros ----------------------------------------------------------------

    def names_read(self, text: str) -> set[str] | None:
        """Names a template may read; None means any."""
        template = parse_template(text)
        if template.text is None and self.options.macros == "recursive":
            return None
        return template.names

    def expand(self, text: str) -> Column:
        """Text with its macros replaced by what they name."""
        template = parse_template(text)
        if template.text is not None:
            return F.lit(template.text)
        if self.options.macros == "recursive":
            return self._expand_again(text)
        return self._expand_once(template)

    def _expand_once(self, template: Template) -> Column:
        parts = [self._part(part) for part in template.parts]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def _part(self, part: str | Macro) -> Column:
        if isinstance(part, str):
            return F.lit(part)
        name = part.name.text
        return self.lookup(name) if name is not None else self.lookup_by(self._expand_once(part.name))

    def _expand_again(self, text: str) -> Column:
        def one_pass(current: Column, _: Column) -> Column:
            name = F.regexp_extract(current, LAST_MACRO, 1)
            macro = F.concat(F.lit("${"), name, F.lit("}"))
            return F.when(name == "", current).otherwise(F.replace(current, macro, self.lookup_by(name)))

        passes = F.sequence(F.lit(1), F.lit(self.options.max_passes))
        expanded = F.aggregate(passes, F.lit(text), one_pass)
        if self.options.on_error != "fail":
            return expanded
        left = F.raise_error(F.concat(F.lit(f"Macros left after {self.options.max_passes} passes: "), expanded)).cast("string")
        return F.when(expanded.rlike(LAST_MACRO), left).otherwise(expanded)

    def expansion_fault(self, text: str, expanded: Column) -> Column | None:
        """True where a macro is left after the last pass."""
        if self.options.macros != "recursive" or parse_template(text).text is not None:
            return None
        return expanded.rlike(LAST_MACRO)

    # -- assignments -----------------------------------------------------------

    def coerce(self, text: Column, code: str) -> tuple[Leaf, Column | None]:
        """Typed value of a text and, if it can fail, where it did."""
        kind, number = code[-1], self.options.number
        if kind == "s":
            return Leaf(text, T.StringType()), None
        if kind == "n":
            return Leaf(coerce.text_to_number(text, number, self.options.on_error), number), coerce.number_fault(text, number)
        value = coerce.text_to_boolean(text, self.options.on_error)
        return Leaf(value, T.BooleanType()), coerce.boolean_fault(text)

    def with_fault(self, fault: Column | None, cond: Column | None) -> "Scope":
        if fault is None or self.faults is None:
            return self
        hit = fault if cond is None else cond & fault
        return replace(self, faults=self.faults + F.when(hit, 1).otherwise(0))

    def assign(self, path: Path, text: Column, code: str, cond: Column | None = None) -> "Scope":
        """Coerce a text and set it at a path, where ``cond`` holds."""
        value, fault = self.coerce(text, code)
        return self.put(path, value, code, cond).with_fault(fault, cond)

    def put(self, path: Path, value: Leaf, code: str, cond: Column | None = None) -> "Scope":
        """Set a typed value at a path, where ``cond`` holds."""
        holder = self._map_holder(path)
        if holder is not None and is_variant(self.leaves[holder].dtype):
            return self._put_in_variant(holder, path[len(holder) :], value, code, cond)
        if holder is not None:
            return self._put_in_map(holder, path[-1], value, code, cond)
        clashes = [p for p in self.leaves if p != path and overlaps(p, path)]
        if clashes and cond is not None:
            if self.overflow is not None:
                raise FlowConfigError(
                    f"{dotted(path)!r}: a set cannot replace {dotted(clashes[0])!r}, which has another shape, in some records only, beside fields whose names come from data"
                )
            return self.loosened(min([path, *clashes], key=len)).put(path, value, code, cond)
        if len(code) == 2:
            # A plain value above the path is replaced, not appended to.
            above = any(p == path[: len(p)] for p in clashes)
            value = append(None if above else self._old_value(path), value, self.options.number)
        old = self.leaves.get(path)
        if cond is not None:
            if old is None:
                value = Leaf(F.when(cond, value.column), value.dtype)
            else:
                target = unify(old.dtype, value.dtype, self.options.number)
                column = F.when(cond, convert(value, target)).otherwise(convert(old, target))
                value = Leaf(column, target)
        leaves = {p: leaf for p, leaf in self.leaves.items() if p not in clashes}
        leaves[path] = value
        overflow = self.overflow
        if overflow is not None:
            kept = F.map_filter(overflow, lambda k, _: ~_touching(k, path))
            overflow = kept if cond is None else F.when(cond, kept).otherwise(overflow)
        return replace(self, leaves=leaves, overflow=overflow)

    def _old_value(self, path: Path) -> Leaf | None:
        below = self.subtree(path)
        if below and self.overflow is None:
            leaf = self._typed(path)
            return Leaf(F.to_variant_object(leaf.column), VARIANT)
        return self.value(path)

    def _map_holder(self, path: Path) -> Path | None:
        for cut in range(1, len(path)):
            holder = self.leaves.get(path[:cut])
            if holder is not None and (is_variant(holder.dtype) or isinstance(holder.dtype, T.MapType)):
                if not is_variant(holder.dtype) and cut != len(path) - 1:
                    raise FlowConfigError(f"{dotted(path)!r}: {dotted(path[:cut])!r} is a map and holds no objects")
                return path[:cut]
        return None

    def loosened(self, top: Path) -> "Scope":
        """Scope in which a field and all below it are one value without a fixed shape."""
        leaf = self._typed(top) or Leaf(F.lit(None).cast(VARIANT), VARIANT)
        if is_variant(leaf.dtype):
            column = leaf.column
        elif isinstance(leaf.dtype, (T.StructType, T.MapType)):  # by way of JSON, which leaves absent fields out
            column = F.try_parse_json(F.to_json(leaf.column))
        else:
            column = to_variant(leaf.column, leaf.dtype)
        leaves = {p: other for p, other in self.leaves.items() if p[: len(top)] != top}
        return replace(self, leaves={**leaves, top: Leaf(column, VARIANT)})

    def _put_in_variant(self, holder: Path, rest: Path, value: Leaf, code: str, cond: Column | None) -> "Scope":
        """Set a value below a field without a fixed shape. What is no object there becomes
        one; other keys stay."""
        leaf = self.leaves[holder]
        if len(code) == 2:
            value = append(self._old_value((*holder, *rest)), value, self.options.number)
        objects = T.MapType(T.StringType(), VARIANT)

        def grown(before: Column, keys: Path) -> Column:
            fields = F.coalesce(F.try_variant_get(before, "$", "map<string,variant>"), F.create_map().cast(objects))
            inner = convert(value, VARIANT) if len(keys) == 1 else grown(F.try_element_at(fields, F.lit(keys[0])), keys[1:])
            others = F.map_filter(fields, lambda k, _: k != keys[0])
            return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(keys[0]), inner)))

        column = grown(leaf.column, rest)
        column = column if cond is None else F.when(cond, column).otherwise(leaf.column)
        return replace(self, leaves={**self.leaves, holder: Leaf(column, VARIANT)})

    def _put_in_map(self, holder: Path, key: str, value: Leaf, code: str, cond: Column | None) -> "Scope":
        leaf = self.leaves[holder]
        if len(code) == 2:
            value = append(Leaf(F.try_element_at(leaf.column, F.lit(key)), leaf.dtype.valueType), value, self.options.number)
        if not same_type(leaf.dtype.valueType, value.dtype):
            raise FlowConfigError(
                f"Cannot set {key!r} of {dotted(holder)!r}: its values are {leaf.dtype.valueType.simpleString()}, "
                f"not {value.dtype.simpleString()}"
            )
        others = F.map_filter(F.coalesce(leaf.column, F.create_map().cast(leaf.dtype)), lambda k, _: k != key)
        grown = F.map_concat(others, F.create_map(F.lit(key), value.column))
        column = grown if cond is None else F.when(cond, grown).otherwise(leaf.column)
        return replace(self, leaves={**self.leaves, holder: Leaf(column, leaf.dtype)})

    def assign_by(self, name: Column, text: Column, code: str, cond: Column | None = None) -> "Scope":
        """:meth:`assign` at a path that only the record knows."""
        key = _normal(name)
        value, fault = self.coerce(text, code)
        if len(code) == 1:
            json = coerce.to_json_text(value.column, value.dtype)
        else:
            old = self._event_by(key, True)
            items = T.ArrayType(value.dtype)
            grown = F.array_union(F.from_json(old, items.simpleString()), F.array(value.column))
            pair = F.concat(F.lit("["), old, F.lit(","), coerce.to_json_text(value.column, value.dtype), F.lit("]"))
            json = (
                F.when(old.isNull(), F.to_json(F.array(value.column)))
                .when(old.startswith("["), F.to_json(grown))
                .otherwise(pair)
            )
        before = self.overflow if self.overflow is not None else F.create_map().cast(OVERFLOW_TYPE)

        def put(new: Column) -> Column:
            others = F.map_filter(before, lambda k, _: ~_overlapping(k, new["key"]))
            return F.map_concat(others, F.create_map(new["key"], new["json"]))

        after = _let(F.struct(key.alias("key"), F.coalesce(json, F.lit("null")).alias("json")), put)
        if self.overflow is None:
            after = F.create_map(key, F.coalesce(json, F.lit("null")))
        overflow = after if cond is None else F.when(cond, after).otherwise(before)
        return replace(self, overflow=overflow).with_fault(fault, cond)

    # -- results ---------------------------------------------------------------

    def visible_leaves(self) -> dict[Path, Leaf]:
        """Leaves without those that a data-made name has overwritten."""
        if self.overflow is None:
            return self.leaves
        return {p: Leaf(F.when(~self._shadowed(p), leaf.column), leaf.dtype) for p, leaf in self.leaves.items()}

    def event_json(self) -> Column:
        """The whole event as JSON text."""
        if self.overflow is None:
            return F.to_json(nest(_for_json(self.leaves))) if self.leaves else F.lit("{}")
        typed = self.visible_leaves()
        heads = sorted({path[0] for path in typed if len(path) > 1})
        keys = F.map_keys(self.overflow)
        # Late fields only go into a typed object if they share its name.
        shared = F.exists(keys, lambda k: k.contains(".") & F.substring_index(k, ".", 1).isin(heads)) if heads else None
        apart = _merged(F.to_json(nest(_for_json(typed))) if typed else F.lit("{}"), self._late_members())
        if shared is None:
            return apart
        rows = [
            F.struct(
                F.array(*[F.lit(key) for key in path]).alias("path"),
                coerce.to_json_text(leaf.column, leaf.dtype).alias("json"),
            ).cast(ENTRY)
            for path, leaf in typed.items()
        ]
        present = F.filter(F.array(*rows), lambda e: e["json"].isNotNull())
        return F.when(shared, F.concat(F.lit("{"), _assemble(F.concat(present, self._late_entries())), F.lit("}"))).otherwise(
            apart
        )

    def _late_entries(self) -> Column:
        return F.transform(
            F.map_entries(self.overflow),
            lambda e: F.struct(F.split(e["key"], r"\.").alias("path"), e["value"].alias("json")).cast(ENTRY),
        )

    def _late_members(self) -> Column:
        """Late fields as the inside of a JSON object."""
        keys = F.map_keys(self.overflow)
        inner = F.exists(keys, lambda k: k.contains("."))
        deep = F.exists(keys, lambda k: F.length(F.replace(k, F.lit("."), F.lit(""))) < F.length(k) - 1)
        return (
            F.when(~inner, F.array_join(_members(F.map_entries(self.overflow)), ","))
            .when(deep, _assemble(self._late_entries()))
            .otherwise(_let(F.map_entries(self.overflow), _two_levels))
        )


def _normal(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("."))


def _overlapping(a: Column, b: Column) -> Column:
    dot = F.lit(".")
    return (a == b) | a.startswith(F.concat(b, dot)) | b.startswith(F.concat(a, dot))


def _touching(key: Column, path: Path) -> Column:
    """:func:`_overlapping` with a fixed path."""
    same_or_above = [dotted(path[:n]) for n in range(1, len(path) + 1)]
    return key.isin(same_or_above) | key.startswith(dotted(path) + ".")


def _key(name: Column) -> Column:
    """``"name":`` of a JSON member."""
    special = name.rlike(r'["\\\x00-\x1f]')
    quoted = F.when(special, F.to_json(name.cast("variant"))).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    return F.concat(quoted, F.lit(":"))


def _members(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.concat(_key(e["key"]), e["value"]))


def _two_levels(entries: Column) -> Column:
    """Members of fields at the top and one level below."""
    flat = F.filter(entries, lambda e: ~e["key"].contains("."))
    heads = F.array_distinct(
        F.transform(F.filter(entries, lambda e: e["key"].contains(".")), lambda e: F.substring_index(e["key"], ".", 1))
    )

    def object_of(head: Column) -> Column:
        own = F.filter(entries, lambda e: e["key"].startswith(F.concat(head, F.lit("."))))
        inside = F.transform(
            own, lambda e: F.concat(_key(F.substring(e["key"], F.length(head) + 2, F.length(e["key"]))), e["value"])
        )
        return F.concat(_key(head), F.lit("{"), F.array_join(inside, ","), F.lit("}"))

    return F.array_join(F.concat(_members(flat), F.transform(heads, object_of)), ",")


def _member(entry: Column) -> Column:
    return F.concat(_key(F.element_at(entry["path"], -1)), entry["json"])


def _merged(object_text: Column, members: Column) -> Column:
    """JSON object with more members."""
    inside = _let(object_text, lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inside, F.lit("")), F.nullif(members, F.lit(""))), F.lit("}"))


def _assemble(entries: Column) -> Column:
    """Inside of the JSON object of ``(path, json)`` entries, folded from the deepest
    level up."""

    def fold(rows: Column, depth: Column) -> Column:
        def folded(deep: Column) -> Column:
            parents = F.array_distinct(F.transform(deep, lambda e: F.slice(e["path"], F.lit(1), depth - 1)))

            def children(parent: Column) -> Column:
                own = F.filter(deep, lambda e: F.slice(e["path"], F.lit(1), depth - 1) == parent)
                return F.concat(F.lit("{"), F.array_join(F.transform(own, _member), ","), F.lit("}"))

            objects = F.transform(parents, lambda p: F.struct(p.alias("path"), children(p).alias("json")))
            return F.concat(F.filter(rows, lambda e: F.size(e["path"]) < depth), objects)

        return _let(F.filter(rows, lambda e: F.size(e["path"]) == depth), folded)

    def whole(rows: Column) -> Column:
        deepest = F.array_max(F.transform(rows, lambda e: F.size(e["path"])))
        levels = _let(deepest, lambda n: F.when(n > 1, F.sequence(n, F.lit(2), F.lit(-1))))
        top = F.aggregate(F.coalesce(levels, F.array().cast("array<int>")), rows, fold)
        return F.array_join(F.transform(top, _member), ",")

    return _let(entries, whole)


def _let(value: Column, body) -> Column:
    """Evaluate once what ``body`` uses many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


TYPE_CODES = ("s", "n", "b", "as", "an", "ab")


def check_type(code: str) -> str:
    if code not in TYPE_CODES:
        raise FlowConfigError(f"Unknown field type {code!r}; known types: {', '.join(TYPE_CODES)}")
    return code

