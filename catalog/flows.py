"""Pipelines over tables: conditions, instructions, macros and coercions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

import millrace as m
from catalog.steps import all_of, any_of, drop, enrich, field, grok, joined, log, since_epoch, table, tag, whole
from millrace.functions import coerce
from millrace.functions.paths import safe_id_column

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


FLAGSHIP = [
    drop(field("event_type", is_="^view$")),
    grok("props", r'"k": (\d+)', "k", "k", "${k}", "n"),
    enrich(("label", "${event_type}:${k}")),
    enrich(tags=["err"], when=field("event_type", is_="^error$")),
]


def flagship_columns(df):
    return df.select("event_id", "event_type", whole("k").alias("k"), "label", joined("tags").alias("tags"))


FLAGSHIP_SQL = r"""
    SELECT event_id, event_type, CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k,
           event_type || ':' || regexp_extract(props, '"k": (\d+)', 1) AS label,
           CASE WHEN event_type = 'error' THEN 'err' END AS tags
    FROM events WHERE NOT regexp_matches(event_type, '^view$')
"""


@query(FLAGSHIP_SQL)
def flow_flagship(spark, sf):
    """A whole flow config: the tap and sink are checked, the pipeline is applied."""
    config = {
        "tap": {"class": "gate", "props": {"name": "in"}},
        "pipeline": FLAGSHIP,
        "sink": {"class": "blackhole", "props": {}},
    }
    m.parse_flow(config)
    return flagship_columns(m.apply_flow(table(spark, sf, "events"), config))


# -- conditions ------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE NOT regexp_matches(coalesce(event_type, ''), '^err')")
def drop_field_is(spark, sf):
    return m.apply_flow(table(spark, sf, "events"), [drop(field("event_type", is_="^err"))]).select(
        "event_id", "event_type"
    )


@query(
    """SELECT event_id, CASE WHEN NOT regexp_matches(event_type, '(err|view)') THEN 'yes' END AS quiet FROM events"""
)
def cond_field_isnot(spark, sf):
    steps = [enrich(("quiet", "yes"), when=field("event_type", isnot="(err|view)"))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "quiet")


@query(
    """SELECT event_id, event_type FROM events
       WHERE NOT (regexp_matches(event_type, 'c.*k') AND NOT regexp_matches(event_type, '^x'))"""
)
def cond_field_both(spark, sf):
    steps = [drop(field("event_type", is_="c.*k", isnot="^x"))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE NOT regexp_matches(CAST(user_id AS VARCHAR), '^(1|2|33)$')")
def cond_number_field(spark, sf):
    steps = [drop(field("user_id", is_="^(1|2|33)$"))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' OR CAST(user_id AS VARCHAR) LIKE '7%')")
def cond_any(spark, sf):
    steps = [drop(any_of(field("event_type", is_="^error$"), field("user_id", is_="^7")))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND CAST(user_id AS VARCHAR) LIKE '7%')")
def cond_all(spark, sf):
    steps = [drop(all_of(field("event_type", is_="^error$"), field("user_id", is_="^7")))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id")


@query("SELECT event_id FROM events WHERE NOT FALSE")
def cond_any_empty(spark, sf):
    return m.apply_flow(table(spark, sf, "events"), [drop(any_of())]).select("event_id")


@query("SELECT event_id, 'hit' AS mark FROM events")
def cond_all_empty(spark, sf):
    """``all`` of nothing holds."""
    return m.apply_flow(table(spark, sf, "events"), [enrich(("mark", "hit"), when=all_of())]).select("event_id", "mark")


@query(
    """SELECT event_id, CASE WHEN (event_type = 'error' AND (user_id = 5 OR regexp_matches(props, ': [0-4]')))
                              OR regexp_matches(event_type, '^sign') THEN 'hit' END AS mark
       FROM events"""
)
def cond_nested(spark, sf):
    test = any_of(
        all_of(field("event_type", is_="^error$"), any_of(field("user_id", is_="^5$"), field("props", is_=": [0-4]"))),
        field("event_type", is_="^sign"),
    )
    return m.apply_flow(table(spark, sf, "events"), [enrich(("mark", "hit"), when=test)]).select("event_id", "mark")


@query(
    """SELECT event_id,
              CASE WHEN regexp_matches(CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE props END, '7')
                   THEN 'seven' END AS mark
       FROM events"""
)
def cond_field_name_macro(spark, sf):
    """The name of the tested field comes from the record."""
    steps = [
        enrich(("which", "props")),
        enrich(("which", "user_id"), when=field("event_type", is_="^view$")),
        enrich(("mark", "seven"), when=field("${which}", is_="7")),
    ]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "mark")


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def cond_tag(spark, sf):
    steps = [enrich(tags=["english"], when=field("lang", is_="^en$")), drop(tag("english", is_="glish"))]
    return m.apply_flow(table(spark, sf, "documents"), steps).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def cond_tag_isnot(spark, sf):
    steps = [enrich(tags=["english"], when=field("lang", is_="^en$")), drop(tag("english", isnot="."))]
    return m.apply_flow(table(spark, sf, "documents"), steps).select("doc_id", "lang")


@query("SELECT doc_id, 'hit' AS mark FROM documents")
def cond_tag_name_only(spark, sf):
    """A tag condition without a pattern holds for every record."""
    steps = [enrich(("mark", "hit"), when=tag("nobody-has-it"))]
    return m.apply_flow(table(spark, sf, "documents"), steps).select("doc_id", "mark")


@query("SELECT count(*) AS n, 0 AS kept FROM events")
def drop_all(spark, sf):
    """``drop`` without a condition leaves nothing of what there was."""
    events = table(spark, sf, "events")
    kept = m.apply_flow(events, [drop()]).select(F.lit(0).alias("n"), F.lit(1).alias("kept"))
    both = events.select(F.lit(1).alias("n"), F.lit(0).alias("kept")).unionAll(kept)
    return both.agg(F.sum("n").alias("n"), F.sum("kept").cast("int").alias("kept"))


# -- enrich and macros -------------------------------------------------------------------


@query(
    """SELECT event_id,
              event_type || ':' || user_id || ':' || json_extract_string(props, '$.k') || ':' AS label
       FROM events"""
)
def enrich_fields_macro(spark, sf):
    events = m.from_json_frames(table(spark, sf, "events"), "props", "k bigint")
    steps = [enrich(("label", "${event_type}:${user_id}:${props.k}:${nothing}"))]
    return m.apply_flow(events, steps).select("event_id", "label")


@query(
    """SELECT event_id, event_type || '!' AS a, event_type || '!-' || event_type || '!' AS b FROM events"""
)
def enrich_later_sees_earlier(spark, sf):
    steps = [enrich(("a", "${event_type}!"), ("b", "${a}-${a}"))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "a", "b")


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'V' WHEN 'error' THEN 'E' ELSE '' END AS letter FROM events"""
)
def macro_nested(spark, sf):
    steps = [enrich(("for_view", "V"), ("for_error", "E"), ("letter", "${for_${event_type}}"))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "letter")


@query(
    """SELECT event_id, '<' || CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE event_type END || '>' AS out
       FROM events"""
)
def macro_recursive(spark, sf):
    """Macros that the data itself holds are expanded too, when asked for."""
    is_view = F.col("event_type") == "view"
    named = F.concat(F.lit("<${"), F.when(is_view, "user_id").otherwise("event_type"), F.lit("}>"))
    events = table(spark, sf, "events").withColumn("template", named)
    return m.apply_flow(events, [enrich(("out", "${template}"))], macros="recursive").select("event_id", "out")


@query(
    """SELECT event_id, '<${' || CASE WHEN event_type = 'view' THEN 'user_id' ELSE 'event_type' END || '}>' AS out
       FROM events"""
)
def macro_single_pass(spark, sf):
    """By default data is never taken for a template."""
    is_view = F.col("event_type") == "view"
    named = F.concat(F.lit("<${"), F.when(is_view, "user_id").otherwise("event_type"), F.lit("}>"))
    events = table(spark, sf, "events").withColumn("template", named)
    return m.apply_flow(events, [enrich(("out", "${template}"))]).select("event_id", "out")


@query(
    """SELECT page_id,
              CAST(coalesce(try_cast(regexp_extract(url, '([^/]*)$', 1) AS DECIMAL(38,18)), 0) AS DOUBLE) AS tail,
              CAST(0 AS DOUBLE) AS nothing, CAST(12.5 AS DOUBLE) AS fixed
       FROM pages"""
)
def enrich_number(spark, sf):
    """What is no number counts as 0."""
    steps = [
        grok("url", "([^/]*)$", "t", "tail_text", "${t}", "s"),
        grok("url", "([^/]+)$", "last", "tail", "${last}", "n"),
        enrich(("nothing", "${absent}", "n"), ("fixed", "12.5", "n")),
    ]
    out = m.apply_flow(table(spark, sf, "pages"), steps)
    tail = F.coalesce(F.col("tail").cast("double"), F.lit(0.0))
    return out.select(
        "page_id", tail.alias("tail"), F.col("nothing").cast("double"), F.col("fixed").cast("double")
    )


@query(
    """SELECT doc_id, quality = 1 AS good, toxic = 1 AS bad FROM labels"""
)
def enrich_bool(spark, sf):
    steps = [
        enrich(("good", "FALSE", "b"), ("bad", "false", "b")),
        enrich(("good", "True", "b"), when=field("quality", is_="^1$")),
        enrich(("bad", "true", "b"), when=field("toxic", is_="^1$")),
    ]
    return m.apply_flow(table(spark, sf, "labels"), steps).select("doc_id", "good", "bad")


@query(
    """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(['turn', role, 'seen'])), '|') AS tags
       FROM conversations"""
)
def enrich_tags_union(spark, sf):
    steps = [enrich(tags=["turn", "${role}", "turn"]), enrich(tags=["seen", "${role}"])]
    return m.apply_flow(table(spark, sf, "conversations"), steps).select("conv_id", "turn", joined("tags").alias("tags"))


@query("SELECT event_id, event_type || ',' || event_type AS pair FROM events")
def array_append_scalar(spark, sf):
    """A plain value and a new one become an array of two, equal or not."""
    steps = [enrich(("event_type", "${event_type}", "as"))]
    out = m.apply_flow(table(spark, sf, "events"), steps)
    return out.select("event_id", F.array_join("event_type", ",").alias("pair"))


@query(
    """SELECT event_id, CASE WHEN user_id = 7 THEN 1 ELSE 2 END AS n,
              CASE WHEN user_id = 7 THEN 7 ELSE user_id + 7 END AS total
       FROM events"""
)
def array_append_number(spark, sf):
    steps = [enrich(("ids", "${user_id}", "an"), ("ids", "7", "an"), ("ids", "7.0", "an"))]
    out = m.apply_flow(table(spark, sf, "events"), steps)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return out.select("event_id", F.size("ids").alias("n"), total.alias("total"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN '"many"' ELSE CAST(user_id AS VARCHAR) END AS json,
              CASE WHEN event_type = 'view' THEN 'many' ELSE CAST(user_id AS VARCHAR) END AS text
       FROM events"""
)
def set_type_change(spark, sf):
    """A conditional set of another type keeps both types apart."""
    steps = [
        enrich(("user_id", "many", "s"), when=field("event_type", is_="^view$")),
        enrich(("text", "${user_id}")),
    ]
    out = m.apply_flow(table(spark, sf, "events"), steps)
    return out.select("event_id", F.to_json("user_id").alias("json"), "text")


@query(
    """SELECT event_id, event_type AS kind, user_id AS who,
              '{"kind":"' || event_type || '","id":' || user_id || '}' AS meta
       FROM events"""
)
def nested_path_set(spark, sf):
    steps = [enrich(("meta.kind", "${event_type}"), ("meta/id", "${user_id}", "n"), ("copy", "${meta.id}", "n"))]
    out = m.apply_flow(table(spark, sf, "events"), steps)
    meta = F.to_json(F.struct("meta.kind", whole("meta.id").alias("id")))
    return out.select("event_id", F.col("meta.kind").alias("kind"), whole("copy").alias("who"), meta.alias("meta"))


@query(
    """SELECT event_id, 'id ' || event_id AS first, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS kind,
              CASE WHEN event_type = 'view' THEN 'was view' END AS note
       FROM events"""
)
def condition_sees_input(spark, sf):
    """A condition is read once, before its own step changes the field it tests."""
    steps = [
        enrich(("first", "id ${event_id}")),
        enrich(("event_type", "seen"), ("note", "was view"), when=field("event_type", is_="^view$")),
    ]
    out = m.apply_flow(table(spark, sf, "events"), steps)
    return out.select("event_id", "first", F.col("event_type").alias("kind"), "note")


@query(
    """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id
              || ',"' || event_type || '":"x","by":{"' || event_type || '":' || user_id || '}}' AS event
       FROM events"""
)
def enrich_dynamic_name(spark, sf):
    """Field names made from data."""
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    steps = [enrich(("${event_type}", "x"), ("by.${event_type}", "${user_id}", "n"))]
    return m.apply_flow(events, steps, "json")


# -- grok ----------------------------------------------------------------------------------

URL = r"^https?://([^/]+)/(\w+)/(\d+)"


@query(
    rf"""SELECT page_id, nullif(regexp_extract(url, '{URL}', 1), '') AS host,
               nullif(regexp_extract(url, '{URL}', 2), '') AS lang,
               CAST(nullif(regexp_extract(url, '{URL}', 3), '') AS BIGINT) AS number
        FROM pages"""
)
def grok_scalar(spark, sf):
    steps = [grok("url", URL, "h,l,n", "host,lang,number", "${h},${l},${n}", "s,s,n")]
    out = m.apply_flow(table(spark, sf, "pages"), steps)
    return out.select("page_id", "host", "lang", whole("number").alias("number"))


@query(
    r"""SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1)[-1] AS last_link FROM pages"""
)
def grok_last_match(spark, sf):
    steps = [grok("html", r'<a href="/([^"]*)"', "link", "last_link", "${link}", "s")]
    return m.apply_flow(table(spark, sf, "pages"), steps).select("page_id", "last_link")


@query(
    r"""SELECT page_id, nullif(array_to_string(list_sort(list_distinct(
                   regexp_extract_all(html, '<a href="/([a-zA-Z]+)"', 1))), '|'), '') AS links
        FROM pages"""
)
def grok_array(spark, sf):
    steps = [grok("html", r'<a href="/([a-zA-Z]+)"', "link", "links", "${link}", "as")]
    return m.apply_flow(table(spark, sf, "pages"), steps).select("page_id", joined("links").alias("links"))


@query(
    r"""SELECT page_id, nullif(array_to_string(list_sort(list_distinct(list_transform(
                   regexp_extract_all(html, '<([a-z]+)[ >]', 1), lambda x: url || '#' || x))), '|'), '') AS marks
        FROM pages"""
)
def grok_array_composed(spark, sf):
    """An array of texts made from a group and a field."""
    steps = [grok("html", r"<([a-z]+)[ >]", "el", "marks", "${url}#${el}", "as")]
    return m.apply_flow(table(spark, sf, "pages"), steps).select("page_id", joined("marks").alias("marks"))


@query(
    r"""SELECT page_id, list_sum(list_distinct(list_transform(regexp_extract_all(url, '(\d)', 1), lambda x: CAST(x AS BIGINT))))::BIGINT AS total
        FROM pages"""
)
def grok_array_numbers(spark, sf):
    steps = [grok("url", r"(\d)", "d", "digits", "${d}", "an")]
    out = m.apply_flow(table(spark, sf, "pages"), steps)
    total = F.aggregate("digits", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return out.select("page_id", total.alias("total"))


@query(
    r"""SELECT doc_id, nullif(array_to_string(regexp_extract_all(text, '(?m)^(\w)', 1), ''), '') AS initials FROM documents"""
)
def grok_fold(spark, sf):
    """Each match adds to what the match before it has set."""
    steps = [grok("text", r"(?m)^(\w)", "c", "initials", "${initials}${c}", "s")]
    return m.apply_flow(table(spark, sf, "documents"), steps).select("doc_id", "initials")


@query(
    """SELECT event_id, CASE WHEN n % 2 = 1 THEN event_type END AS plain, CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) END AS k,
              CASE WHEN n % 2 = 0 THEN n || '+' || n END AS twice
       FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS n FROM events)"""
)
def grok_structure(spark, sf):
    """A match makes an object of a field that stays a text in other records."""
    steps = [grok("props", r": (\d*[02468])\}", "n", "event_type.k,event_type.twice", "${n},${event_type.k}+${event_type.k}", "s,s")]
    out = m.apply_flow(table(spark, sf, "events").select("event_id", "event_type", "props"), steps, "json")
    pick = lambda path: F.get_json_object("event", path)
    k = pick("$.event_type.k")
    return out.select(
        pick("$.event_id").cast("bigint").alias("event_id"), F.when(k.isNull(), pick("$.event_type")).alias("plain"), k.alias("k"), pick("$.event_type.twice").alias("twice")
    )


@query(
    r"""SELECT doc_id, nullif(regexp_extract(text, '(?m)^(\w)', 1), '') AS initial FROM documents"""
)
def grok_same_name(spark, sf):
    """An event field hides the group of its name, so the first match stays."""
    steps = [grok("text", r"(?m)^(\w)", "initial", "initial", "${initial}", "s")]
    return m.apply_flow(table(spark, sf, "documents"), steps).select("doc_id", "initial")


@query(
    rf"""SELECT page_id, regexp_extract(url, '{URL}', 2) || '@' || regexp_extract(url, '{URL}', 1) AS address FROM pages"""
)
def grok_ctx_later_step(spark, sf):
    """Groups stay in the context for later steps."""
    steps = [grok("url", URL, "h,l,n", "host", "${h}", "s"), enrich(("address", "${l}@${h}"))]
    return m.apply_flow(table(spark, sf, "pages"), steps).select("page_id", "address")


@query(
    r"""SELECT page_id, coalesce(regexp_extract_all(url, '[?&]page=(\w+)', 1)[-1], '') AS page,
               coalesce(regexp_extract_all(url, '[?&]ref=(\w+)', 1)[-1], '') AS ref
        FROM pages"""
)
def grok_dynamic_names(spark, sf):
    """Names and values both from the matches: the parameters of a query string."""
    steps = [
        grok("url", r"[?&](\w+)=(\w+)", "k,v", "query.${k}", "${v}", "s"),
        enrich(("page", "${query.page}"), ("ref", "${query.ref}")),
    ]
    return m.apply_flow(table(spark, sf, "pages"), steps).select("page_id", "page", "ref")


@query(
    r"""SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) END AS k
        FROM events"""
)
def grok_conditional(spark, sf):
    steps = [grok("props", r"(\d+)", "k", "k", "${k}", "n", when=field("event_type", is_="^error$"))]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", whole("k").alias("k"))


@query(
    r"""SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE regexp_extract(props, '(\d+)', 1) END AS d
        FROM events"""
)
def grok_source_macro(spark, sf):
    """The field to search is named by the record."""
    steps = [
        enrich(("which", "props")),
        enrich(("which", "user_id"), when=field("event_type", is_="^view$")),
        grok("${which}", r"(\d+)", "k", "d", "${k}", "s"),
    ]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "d")


# -- json, coercions, small functions ------------------------------------------------------


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, 'a.' || event_type AS sub
       FROM events"""
)
def json_roundtrip(spark, sf):
    """JSON text in, a flow, JSON text out."""
    events = m.from_json_frames(table(spark, sf, "events"), "props", "k bigint")
    out = m.to_json_frames(m.apply_flow(events, [enrich(("props.sub", "a.${event_type}"))]), "body")
    schema = "event_id bigint, event_type string, props struct<k:bigint, sub:string>"
    back = m.from_json_frames(out, "body", schema)
    return back.select("body.event_id", "body.props.k", "body.event_type", "body.props.sub")


@query(
    """SELECT event_id, event_type AS kind, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type || '!' AS label,
              CASE WHEN event_type = 'error' THEN 'yes' END AS bad FROM events"""
)
def json_schemaless(spark, sf):
    """JSON text without a declared schema: fields are looked up, set and printed all the same."""
    body = F.to_json(F.struct("event_id", F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k bigint").alias("props")).alias("about")))
    frames = m.from_json_frames(table(spark, sf, "events").select(body.alias("v")), "v", "variant")
    steps = [
        enrich(("v.label", "${v.about.kind}!")),
        enrich(("v.about.bad", "yes"), when=field("v.about.kind", is_="^error$")),
    ]
    out = m.apply_flow(frames, steps, "json")
    pick = lambda path: F.get_json_object("event", f"$.v.{path}")
    return out.select(
        pick("event_id").cast("bigint").alias("event_id"), pick("about.kind").alias("kind"), pick("about.props.k").cast("bigint").alias("k"),
        pick("label").alias("label"), pick("about.bad").alias("bad"),
    )


@query(
    """SELECT event_id, CAST(user_id AS DOUBLE) AS of_number, CAST(0 AS DOUBLE) AS of_text,
              CAST(CASE WHEN user_id = 7 THEN 1 ELSE 0 END AS DOUBLE) AS of_flag, CAST(0 AS DOUBLE) AS of_array
       FROM events"""
)
def to_number_kinds(spark, sf):
    d = T.DecimalType(38, 18)
    return table(spark, sf, "events").select(
        "event_id",
        coerce.to_number(F.col("user_id"), T.LongType()).cast("double").alias("of_number"),
        coerce.to_number(F.col("event_type"), T.StringType(), d).cast("double").alias("of_text"),
        coerce.to_number(F.col("user_id") == 7, T.BooleanType(), d).cast("double").alias("of_flag"),
        coerce.to_number(F.array("user_id"), T.ArrayType(T.LongType()), d).cast("double").alias("of_array"),
    )


@query(
    """SELECT event_id, trunc(value) = 1 AS of_number, event_type = 'view' AS of_text, TRUE AS of_array, FALSE AS of_null
       FROM events"""
)
def to_boolean_kinds(spark, sf):
    text = F.when(F.col("event_type") == "view", "TRUE").otherwise("false")
    return table(spark, sf, "events").select(
        "event_id",
        coerce.to_boolean(F.col("value"), T.DoubleType()).alias("of_number"),
        coerce.to_boolean(text, T.StringType()).alias("of_text"),
        coerce.to_boolean(F.array("user_id"), T.ArrayType(T.LongType())).alias("of_array"),
        coerce.to_boolean(F.lit(None).cast("string"), T.StringType()).alias("of_null"),
    )


@query(
    """SELECT vec_id, label || ',' || (label + 1) AS numbers, '"' || label || '","x"' AS texts,
              len(embedding) AS places, sum_of AS total
       FROM embeddings, (SELECT vec_id AS v, CAST(round(sum(x), 3) AS DECIMAL(18, 3)) AS sum_of
                         FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id)
       WHERE v = vec_id"""
)
def array_to_text(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.array(F.col("label"), F.col("label") + 1).alias("a"),
        F.array(F.col("label").cast("string"), F.lit("x")).alias("b"),
        "embedding",
    )
    out = m.apply_flow(rows, [enrich(("numbers", "${a}"), ("texts", "${b}"), ("vector", "${embedding}"))])
    # The text of the whole vector, read back.
    parts = F.transform(F.split("vector", ","), lambda x: x.cast("double"))
    total = F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 3).cast("decimal(18,3)")
    return out.select("vec_id", "numbers", "texts", F.size(parts).cast("bigint").alias("places"), total.alias("total"))


@query(
    r"""SELECT page_id, replace(regexp_replace(url, '\W', '_', 'g'), '__', '_') AS id FROM pages"""
)
def id_sanitise(spark, sf):
    return table(spark, sf, "pages").select("page_id", safe_id_column(F.col("url")).alias("id"))


@query(
    """SELECT 'source' AS tags, doc_id AS id, text AS value, 'lib' AS source_id, 'a|b' AS source_tags,
              CAST(doc_id AS VARCHAR) AS ctx_id
       FROM documents"""
)
def gate_envelope(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value"))
    out = m.to_envelope(m.stamp_source(rows, "lib", ["a", "b"]))
    return out.select(
        F.array_join("event.tags", "|").alias("tags"),
        "event.id",
        "event.value",
        F.col("event.source.sourceId").alias("source_id"),
        F.array_join("event.source.tags", "|").alias("source_tags"),
        F.col("ctx")["source.id"].alias("ctx_id"),
    )


@query(
    """SELECT doc_id, 'undefined/' || doc_id || '/' || text AS label FROM documents"""
)
def envelope_flow(spark, sf):
    """A flow over gate records: nested event fields and the context."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value"))
    frames = m.to_envelope(m.stamp_source(rows))
    out = m.apply_flow(frames, [enrich(("label", "${source.sourceId}/${source.id}/${value}"))])
    return out.select(F.col("event.id").alias("doc_id"), F.col("event.label").alias("label"))


@query(
    """SELECT 'audit' AS logger, 'WARN' AS level, count(*) AS records FROM events WHERE event_type = 'error'
       UNION ALL SELECT 'default', 'INFO', count(*) FROM events WHERE event_type <> 'view'"""
)
def log_observe(spark, sf):
    """Log steps let every record pass; what they report once the result is written."""
    steps = [log(level="WARN", logger="audit", when=field("event_type", is_="^error$")), drop(field("event_type", is_="^view$")), log()]
    return _reported(spark, m.transform(table(spark, sf, "events"), steps), m.write_blackhole)


def _reported(spark, result, write):
    write(result.df)
    rows = [(s.logger, s.level, s.report()["records"]) for s in result.logs]
    return spark.createDataFrame(rows, "logger string, level string, records bigint")


@query("SELECT 'default' AS logger, 'INFO' AS level, count(*) AS records FROM events WHERE event_type <> 'view'")
def blackhole(spark, sf):
    """A blackhole computes every record: the step before it has counted them."""
    return _reported(spark, m.transform(table(spark, sf, "events"), [*FLAGSHIP, log()]), m.write_blackhole)


@query("SELECT event_id, upper(event_type) AS event_type FROM events WHERE event_type <> 'view'")
def custom_instruction(spark, sf):
    """An instruction of the user's own."""

    def shout(df, props, cond):
        name = props["field"]
        return df.withColumn(name, F.when(cond, F.upper(name)).otherwise(F.col(name)))

    m.unregister_instruction("shout")
    m.register_instruction("shout", shout)
    steps = [drop(field("event_type", is_="^view$")), {"class": "shout", "props": {"field": "event_type"}}]
    return m.apply_flow(table(spark, sf, "events"), steps).select("event_id", "event_type")


@query(
    """SELECT doc_id, source, min(lang) AS lang FROM
         (SELECT * FROM documents UNION ALL SELECT * FROM documents) GROUP BY doc_id, source"""
)
def gate_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return m.drop_duplicates(docs.unionAll(docs), ["source", "doc_id"])


@query("SELECT user_id, max_by(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_by_key(spark, sf):
    return m.latest_by_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_id"])


@query(
    """SELECT user_id, event_type, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(props, row(ts, event_id)) AS props
       FROM events GROUP BY user_id, event_type"""
)
def latest_row_by_key(spark, sf):
    events = table(spark, sf, "events")
    return m.latest_by_key(events, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "props"])


@query(
    """SELECT event_type, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS tick,
              max_by(event_id, row(ts, event_id)) AS event_id
       FROM events GROUP BY 1, 2"""
)
def conflate(spark, sf):
    out = m.conflate(table(spark, sf, "events"), ["event_type"], "ts", ["ts", "event_id"], ["event_id"], tick="1 hour")
    return out.select("event_type", since_epoch("SECOND", "tick_start").alias("tick"), "event_id")


@query(
    """SELECT event_type, epoch_us(ts) // 200000 AS tick, max_by(event_id, row(ts, event_id)) AS event_id
       FROM events GROUP BY 1, 2"""
)
def conflate_tick(spark, sf):
    """The console's own tick of 200 ms."""
    out = m.conflate(table(spark, sf, "events"), ["event_type"], "ts", ["ts", "event_id"], ["event_id"])
    return out.select("event_type", (since_epoch("MILLISECOND", "tick_start") / 200).cast("bigint").alias("tick"), "event_id")


@query(
    """SELECT event_id, event_type = 'view' AS bad,
              CASE WHEN event_type = 'error' THEN TRUE WHEN event_type = 'view' THEN NULL ELSE FALSE END AS flag,
              CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS faults
       FROM events"""
)
def fault_policy(spark, sf):
    """Values that cannot be coerced become NULL and are counted, when asked for."""
    text = F.when(F.col("event_type") == "error", "TRUE").when(F.col("event_type") == "view", "maybe").otherwise("no-t")
    events = table(spark, sf, "events").withColumn("raw", F.when(text == "no-t", "false").otherwise(text))
    out = m.apply_flow(events, [enrich(("flag", "${raw}", "b"))], on_error="null", track_faults=True)
    return out.select("event_id", (F.col("event_type") == "view").alias("bad"), "flag", "faults")
