"""Strict reading of annotated answers, and annotation of placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraglight.functions.text import located
from fraglight.operators.nodes import decided_kind, inclusion

#: Every leaf as it is, so that its type can be told.
_LOOSE = """`intro-structures` array<variant>, fragments array<struct<fragment: variant, criteria: variant, dependencies: array<variant>, node_kind: variant, placeholders: array<struct<placeholder: variant, node_kind: variant>>>>"""
DOCUMENT = "struct<intro:array<string>,fragments:array<struct<fragment:string,criteria:string,dependencies:array<string>,node_kind:string,placeholders:array<struct<placeholder:string,node_kind:string>>>>>"


def unfenced(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\A\s*```[a-z]*\s*|\s*```\s*\z", "")


def _is(x: Column, optional: bool = False) -> Column:
    kind = F.schema_of_variant(x)
    return F.coalesce((kind == "STRING") | (kind == "VOID") if optional else kind == "STRING", F.lit(optional))


def _text(x: Column) -> Column:
    return F.try_variant_get(x, "$", "string")


def _all(items: Column, good) -> Column:
    return items.isNotNull() & F.forall(items, lambda x: x.isNotNull() & good(x))


def strict_document(json: Column) -> Column:
    """The document of a JSON text as a struct, or null if it isn't of the whole schema: every field there, of its own type, but for the
    kinds of nodes, which may be null or missing. Fields beyond the schema don't matter; a repeated key does."""
    x = F.from_json(F.when(F.try_parse_json(json).isNotNull(), json), _LOOSE)
    placeholder = lambda p: _is(p.placeholder) & _is(p.node_kind, True)
    whole = lambda f: _is(f.fragment) & _is(f.criteria) & _is(f.node_kind, True) & _all(f.dependencies, _is) & _all(f.placeholders, placeholder)
    good = _all(x["intro-structures"], _is) & _all(x.fragments, whole)
    part = lambda f: F.struct(
        _text(f.fragment).alias("fragment"), _text(f.criteria).alias("criteria"), F.transform(f.dependencies, _text).alias("dependencies"), _text(f.node_kind).alias("node_kind"),
        F.transform(f.placeholders, lambda p: F.struct(_text(p.placeholder).alias("placeholder"), _text(p.node_kind).alias("node_kind"))).alias("placeholders"),
    )
    return F.when(good, F.struct(F.transform(x["intro-structures"], _text).alias("intro"), F.transform(x.fragments, part).alias("fragments"))).cast(DOCUMENT)


def strict_answers(df: DataFrame, body: str) -> DataFrame:
    """df with `document` and `status`: plain or fenced, as which it is JSON of the whole schema; schema if it is JSON but not of that;
    error if it isn't JSON; missing if it is null."""
    json = F.when(F.try_parse_json(body).isNotNull(), F.col(body)).otherwise(unfenced(F.col(body)))
    read = df.withColumn("document", strict_document(json))
    way = F.when(F.try_parse_json(body).isNotNull(), "plain").when(F.try_parse_json(unfenced(F.col(body))).isNotNull(), "fenced")
    status = F.when(F.col(body).isNull(), "missing").when(way.isNull(), "error").when(F.col("document").isNull(), "schema").otherwise(way)
    return read.withColumn("status", status)


def placeholder_kinds(found: DataFrame, nodes: DataFrame, files: DataFrame, on: str, text: str, fragments: DataFrame, key: str, placeholders: str) -> DataFrame:
    """found (on, key, s): the start of each fragment in a source -> (on, key, p, placeholder, node_kind) for the placeholders of fragments,
    array<string>: the kind of the first place of the placeholder at or after the fragment's start, which may lie beyond its
    end; null where there is none. Null and blank placeholders have none."""
    each = found.select(on, key, "s").join(fragments.select(key, F.posexplode(placeholders).alias("p", "placeholder")), key)
    each = each.withColumn("_id", F.concat_ws("#", F.col(on).cast("string"), F.col(key).cast("string"), F.col("p").cast("string")))
    pairs = each.filter("placeholder is not null").select(on, "_id", F.col("s").alias("start"))
    places = located(pairs, files, on, text, each.select("_id", "placeholder"), "_id", "placeholder", bound=2, start="start")
    spans = places.select(on, "_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    kinds = inclusion(nodes, spans, on, ["_id"]).select("_id", decided_kind().alias("node_kind"))
    return each.join(kinds, "_id", "left").select(on, key, F.col("p").cast("bigint").alias("p"), "placeholder", "node_kind")
