"""The working form of a table: one column per event leaf and per context key.

Flat columns keep a long pipeline cheap to plan and let Catalyst prune and push down
each field by itself; the nested event is built once, at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FlowConfigError
from millrace.functions.paths import Path, ctx_column, leaf_column, quoted
from millrace.options import FlowOptions
from millrace.plans.scope import Leaf, Scope, nest

CTX_MAP, OVERFLOW, FAULTS = "x:ctx", "x:overflow", "x:faults"
OVERFLOW_FIELD = "dynamic"
SOURCE_ID = "source.id"


def _flatten(prefix: Path, source: Column, dtype: T.DataType) -> list[tuple[Path, Column, T.DataType]]:
    if isinstance(dtype, T.StructType) and dtype.fields:
        return [
            item
            for f in dtype.fields
            for item in _flatten((*prefix, f.name), source.getField(f.name), f.dataType)
        ]
    return [(prefix, source, dtype)]


def flatten(fields: list[T.StructField]) -> list[tuple[Path, Column, T.DataType]]:
    """Leaves of a table's columns."""
    return [item for f in fields for item in _flatten((f.name,), quoted(f.name), f.dataType)]


def table_columns(leaves: dict[Path, Leaf]) -> list[Column]:
    """One column per top-level field."""
    heads: dict[str, dict[Path, Leaf]] = {}
    for path, leaf in leaves.items():
        heads.setdefault(path[0], {})[path] = leaf
    return [
        (group[(head,)].column if (head,) in group else nest(group).getField(head)).alias(head)
        for head, group in heads.items()
    ]


@dataclass(frozen=True)
class Frame:
    """A DataFrame in working form. ``extra`` are columns that ride along untouched."""

    df: DataFrame
    options: FlowOptions
    leaves: dict[Path, T.DataType]
    ctx: tuple[str, ...] = ()
    ctx_map: bool = False
    overflow: bool = False
    extra: tuple[str, ...] = ()
    enveloped: bool = False
    bound: int = 0
    logs: tuple = field(default=())

    @classmethod
    def of(cls, df: DataFrame, options: FlowOptions | None = None) -> "Frame":
        """A table with ``event`` and ``ctx`` columns is a table of frames; in any other
        table each row is one event without context."""
        options = options or FlowOptions()
        schema = df.schema
        types = {f.name: f.dataType for f in schema.fields}
        enveloped = isinstance(types.get("event"), T.StructType) and "ctx" in types
        if enveloped:
            items = _flatten((), F.col("event"), types["event"])
        else:
            items = flatten(schema.fields)
        columns = [col.alias(leaf_column(path)) for path, col, _ in items]
        leaves = {path: dtype for path, _, dtype in items}
        ctx: tuple[str, ...] = ()
        extra: tuple[str, ...] = ()
        ctx_map = overflow = False
        if enveloped:
            if isinstance(types["ctx"], T.StructType):
                ctx = tuple(types["ctx"].names)
                columns += [F.col("ctx").getField(n).cast("string").alias(ctx_column(n)) for n in ctx]
            elif isinstance(types["ctx"], T.MapType):
                ctx_map = True
                columns.append(F.col("ctx").cast("map<string,string>").alias(CTX_MAP))
            else:
                raise FlowConfigError("Column 'ctx' must be a struct or a map")
            overflow = OVERFLOW_FIELD in types
            if overflow:
                empty = F.create_map().cast("map<string,string>")
                columns.append(F.coalesce(F.col(OVERFLOW_FIELD), empty).alias(OVERFLOW))
            extra = tuple(n for n in types if n not in ("event", "ctx", OVERFLOW_FIELD))
            columns += [quoted(n) for n in extra]
        if options.track_faults:
            columns.append(F.lit(0).alias(FAULTS))
        return cls(df.select(*columns), options, leaves, ctx, ctx_map, overflow, extra, enveloped)

    @property
    def scope(self) -> Scope:
        return Scope(
            self.options,
            {path: Leaf(quoted(leaf_column(path)), dtype) for path, dtype in self.leaves.items()},
            {name: quoted(ctx_column(name)) for name in self.ctx},
            quoted(CTX_MAP) if self.ctx_map else None,
            quoted(OVERFLOW) if self.overflow else None,
            quoted(FAULTS) if self.options.track_faults else None,
        )

    def commit(self, before: Scope, after: Scope) -> "Frame":
        """Turn what changed between two scopes into one projection."""
        new: dict[str, Column] = {}
        for path, leaf in after.leaves.items():
            if before.leaves.get(path) is not leaf:
                new[leaf_column(path)] = leaf.column
        for name, col in after.ctx.items():
            if before.ctx.get(name) is not col:
                new[ctx_column(name)] = col
        if after.overflow is not before.overflow:
            new[OVERFLOW] = after.overflow
        if after.faults is not before.faults:
            new[FAULTS] = after.faults
        return replace(
            self,
            df=self.df.withColumns(new) if new else self.df,
            leaves={path: leaf.dtype for path, leaf in after.leaves.items()},
            ctx=tuple(after.ctx),
            overflow=after.overflow is not None,
        )

    def bind(self, **named: Column) -> tuple["Frame", dict[str, Column]]:
        """Evaluate expressions on the record as it is now, under private names."""
        columns = {f"x:{key}{self.bound}": col for key, col in named.items()}
        frame = replace(self, df=self.df.withColumns(columns), bound=self.bound + 1)
        return frame, {key: quoted(f"x:{key}{self.bound}") for key in named}

    def with_df(self, df: DataFrame) -> "Frame":
        return replace(self, df=df)

    # -- results ---------------------------------------------------------------

    def event(self) -> Column:
        return nest(self.scope.visible_leaves())

    def context(self) -> Column:
        """Context as one struct, whose keys are known when a plan is made, so a condition on
        any other name is one on the event alone and reaches the files. As a map, absent keys
        left out, if it came as one or if keys differ only in case."""
        if not self.ctx_map and len({n.lower() for n in self.ctx}) == len(self.ctx):
            if not self.ctx:  # files hold no empty structs
                return F.struct(F.lit(None).cast("string").alias(SOURCE_ID))
            return F.struct(*[quoted(ctx_column(n)).alias(n) for n in self.ctx])
        pairs = [c for n in self.ctx for c in (F.lit(n), quoted(ctx_column(n)))]
        own = F.create_map(*pairs).cast("map<string,string>")
        own = F.map_filter(own, lambda _, v: v.isNotNull())
        if not self.ctx_map:
            return own
        inherited = F.map_filter(
            F.coalesce(quoted(CTX_MAP), F.create_map().cast("map<string,string>")),
            lambda k, _: ~F.array_contains(F.map_keys(own), k),
        )
        return F.map_concat(inherited, own) if self.ctx else inherited

    def to_envelope(self) -> DataFrame:
        columns = [self.event().alias("event"), self.context().alias("ctx")]
        if self.overflow:
            columns.append(quoted(OVERFLOW).alias(OVERFLOW_FIELD))
        return self.df.select(*columns, *self._trailing())

    def to_json(self) -> DataFrame:
        return self.df.select(self.scope.event_json().alias("event"), *self._trailing())

    def to_table(self) -> DataFrame:
        columns = table_columns(self.scope.visible_leaves())
        if self.overflow:
            columns.append(quoted(OVERFLOW).alias(OVERFLOW_FIELD))
        return self.df.select(*columns, *self._trailing())

    def _trailing(self) -> list[Column]:
        faults = [quoted(FAULTS).alias("faults")] if self.options.track_faults else []
        return [quoted(n) for n in self.extra] + faults
