"""Queries of answers, reports and node kinds as records and texts, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglight.functions import families as fam
from fraglight.functions import text as tx
from fraglight.operators import diagnostics
from fraglight.operators.answers import placeholder_kinds, strict_answers
from fraglight.operators.ranking import indexed
from fraglight.plans.queries import _ENDED, _ICE, _ONE, _ended, _files, _fragments, _located, _nodes, _runs, _snippets, annotate_kinds
from fraglight.sources.tables import staged, table


def usable_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments without `main`, and their dependencies without main functions."""
    kept = _fragments(spark, d).filter("fragment is not null").filter(~tx.holds_main(F.col("fragment")))
    return kept.select("fragment_id", F.coalesce(F.array_join(tx.without_main(F.col("dependencies")), "\u0001"), F.lit("")).alias("dependencies"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "llm_outputs").filter("output_id is not null").dropDuplicates(["output_id"])
    return strict_answers(once, "body")


def answer_status(spark: SparkSession, d: str) -> DataFrame:
    """How each answer could be read: plain or fenced, of another schema, no JSON, or missing."""
    return _answers(spark, d).select("output_id", "status")


def answer_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of an ingest: read, couldn't be read, couldn't be parsed or were of another schema."""
    status = F.col("status")
    return _answers(spark, d).agg(
        F.count_if(status.isin("plain", "fenced")).alias("loaded"), F.count_if(status == "missing").alias("read_failures"), F.count_if(status.isin("schema", "error")).alias("parse_failures")
    )


def answer_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The fragments of the answers that are of the whole schema."""
    each = _answers(spark, d).select("output_id", F.posexplode("document.fragments").alias("frag_no", "f"))
    sizes = [F.size(f"f.{c}").cast("bigint").alias(c) for c in ("dependencies", "placeholders")]
    return each.select("output_id", F.col("frag_no").cast("bigint").alias("frag_no"), "f.fragment", "f.criteria", F.coalesce("f.node_kind", F.lit("")).alias("node_kind"), *sizes)


def sorted_parts(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies and placeholders of each snippet, sorted, each once; placeholders without a kind first."""
    deps = F.array_join(F.transform(F.array_sort(F.array_distinct(F.filter("deps", lambda x: x.isNotNull()))), lambda x: x.cast("string")), ",")
    kept = F.array_sort(F.array_distinct(F.filter("placeholders", lambda p: p.isNotNull() & p.ph.isNotNull())))
    named = F.array_join(F.transform(kept, lambda p: F.concat(p.ph, F.lit(":"), F.coalesce(p.kind, F.lit("")))), ",")
    return _snippets(spark, d).select("snippet_id", F.coalesce(deps, F.lit("")).alias("deps"), F.coalesce(named, F.lit("")).alias("placeholders"))


def union_compat(spark: SparkSession, d: str) -> DataFrame:
    """For each fragment how many kinds of snippets may stand for one of its placeholders: kinds are joined by bucket, not snippets."""
    asked = _fragments(spark, d).select("fragment_id", F.explode(fam.union_buckets(F.col("placeholders.node_kind"))).alias("bucket"))
    kinds = _snippets(spark, d).filter("kind is not null").select("kind").distinct().select("kind", F.explode(fam.buckets_of(F.col("kind"))).alias("bucket"))
    return asked.join(kinds, "bucket").groupBy("fragment_id").agg(F.count_distinct("kind").alias("kinds"))


def family_members(spark: SparkSession, d: str) -> DataFrame:
    """For each kind of snippet the kinds of its families, repeats kept, and itself."""
    kinds = _snippets(spark, d).filter("kind is not null").select("kind").distinct()
    members = F.array_sort(fam.members_of(F.col("kind")))
    return kinds.select("kind", F.size(members).cast("bigint").alias("members"), F.array_join(members, ",").alias("listed"))


def kind_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of kinds, line by line: the totals, then each kind by falling count with its families, its first three texts, and how many
    more there are. rank 0 is the head."""
    snippets = _snippets(spark, d).filter("kind is not null and fragment is not null")
    counts = staged(snippets.groupBy("kind").agg(F.count("*").alias("n")), "counts")
    ranked = indexed(counts.withColumn("least", -F.col("n")), ["least", "kind"], name="at").select("kind", "n", (F.col("at") + 1).alias("rank"))
    ranked = staged(ranked, "ranked")
    line = lambda no, text: [F.col("rank"), F.lit(no).cast("bigint").alias("no"), text.alias("line")]
    text = lambda c: F.col(c).cast("string")
    head = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")).select(F.lit(0).cast("bigint").alias("rank"), *line(0, F.concat(F.coalesce(text("n"), F.lit("0")), F.lit(" snippets across "), text("k"), F.lit(" node kinds")))[1:])
    own = fam.families_of(F.col("kind"))
    tag = F.when(F.size(own) > 0, F.concat(F.lit(" ["), F.array_join(own, ","), F.lit("]"))).otherwise("")
    titles = ranked.select(*line(0, F.concat("kind", tag, F.lit(": "), text("n"))))
    first = indexed(snippets.select("kind", "fragment", "snippet_id"), ["fragment", "snippet_id"], ["kind"], "at").filter("at < 3").join(ranked, "kind")
    previews = first.select("rank", (F.col("at") + 1).alias("no"), F.concat(F.lit("  "), tx.preview(F.col("fragment"))).alias("line"))
    more = ranked.filter("n > 3").select(*line(4, F.concat(F.lit("  ... and "), (F.col("n") - 3).cast("string"), F.lit(" more"))))
    return head.unionByName(titles).unionByName(previews).unionByName(more)


def _reported(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "outcomes").filter("run_id is not null").dropDuplicates(["run_id"])
    ices = diagnostics.compiler_only(diagnostics.crashes(F.col("stderr")))
    own = more.select("run_id", "file", "command_display", "timestamp_utc", ices.alias("ices"))
    return own.join(_ended(spark, d).select("run_id", "kind", "signal", "oom"), "run_id")


def run_stamps(spark: SparkSession, d: str) -> DataFrame:
    """The start of each run as it is written in reports."""
    return _runs(spark, d).filter("timestamp_utc is not null").select("run_id", tx.utc_stamp(F.col("timestamp_utc")).alias("stamp"))


def report_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object for each run: file, start, command, how it ended and its crashes."""
    fields = [
        F.col("file"), tx.utc_stamp(F.col("timestamp_utc")).alias("timestamp_utc"), F.col("command_display"), F.col("kind").alias("termination"), F.col("signal"),
        (F.size("ices") > 0).alias("is_ice"), F.array_sort("ices").alias("ices"),
    ]
    return _reported(spark, d).select("run_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole report in blocks of text: a head, one block for each run with or without a crash, and one for each unique place."""
    runs = staged(_reported(spark, d), "reported")
    kind, signal = F.col("kind"), F.col("signal")
    from fraglight.functions.termination import label

    nothing = lambda c: F.coalesce(F.col(c), F.lit(""))
    crash = F.array_join(F.transform(F.array_sort("ices"), lambda x: F.concat(F.lit("  "), x.location, F.lit("\n  "), x.reason, F.lit("\n"))), "")
    title = F.concat(F.when(F.size("ices") > 0, "ICE").otherwise("NO_ICE"), F.lit(" ["), label(kind, signal), F.lit("]\n"))
    oom = F.when(F.col("oom"), "  (stderr suggests OOM)\n").otherwise("")
    block = F.concat(title, F.lit("  "), nothing("file"), F.lit("\n  "), F.coalesce(tx.utc_stamp(F.col("timestamp_utc")), F.lit("")), F.lit("\n  "), nothing("command_display"), F.lit("\n"), crash, oom)
    blocks = runs.filter("kind is not null").select(F.lit("run").alias("section"), F.col("run_id").cast("string").alias("name"), block.alias("text"))
    count = lambda n: F.concat(F.lit(n + ": "))
    head = runs.agg(F.concat(count("Number of input files"), F.count_distinct("file").cast("string"), F.lit("\n"), count("Total runs"), F.count("*").cast("string"), F.lit("\n")).alias("text"))
    each = runs.select("run_id", F.posexplode("ices").alias("pos", "ice")).select("run_id", "pos", "ice.location", "ice.reason")
    unique = diagnostics.first_sightings(each, ["location"], ["run_id", "pos"])
    places = unique.select(F.lit("unique").alias("section"), F.col("location").alias("name"), F.concat(F.lit("  "), "location", F.lit(" — "), "reason", F.lit("\n")).alias("text"))
    return head.select(F.lit("head").alias("section"), F.lit("").alias("name"), "text").unionByName(blocks).unionByName(places)


def annotate_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """The kind that each placeholder of a snippet has in the files where the snippet stands."""
    files = _files(spark, d).filter("seed_file is not null and file_text is not null").select("file_id", "file_text")
    found = staged(_located(spark, d), "matches").filter("match_no = 0").select("file_id", "snippet_id", "s")
    snippets = _snippets(spark, d).select("snippet_id", F.transform("placeholders", lambda p: p.ph).alias("names"))
    kinds = placeholder_kinds(found, staged(_nodes(spark, d), "nodes"), files, "file_id", "file_text", snippets, "snippet_id", "names")
    return kinds.select("file_id", "snippet_id", "p", "placeholder", "node_kind")


def annotated_documents(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document for each file: the snippets that stand in it with their kinds and those of their placeholders."""
    kinds = staged(annotate_kinds(spark, d), "kinds").filter("file_id is not null")
    own = annotate_placeholders(spark, d).groupBy("file_id", "snippet_id").agg(F.array_sort(F.collect_list(F.struct("p", "placeholder", "node_kind"))).alias("named"))
    each = kinds.join(own, ["file_id", "snippet_id"], "left").join(_snippets(spark, d).select("snippet_id", "fragment"), "snippet_id")
    named = F.transform(F.coalesce("named", F.array()), lambda p: F.struct(p.placeholder.alias("placeholder"), p.node_kind.alias("node_kind")))
    fragment = F.struct("snippet_id", "fragment", "node_kind", named.alias("placeholders"))
    listed = each.groupBy("file_id").agg(F.array_sort(F.collect_list(fragment)).alias("fragments"))  # those of one file
    return listed.select("file_id", F.to_json(F.struct("fragments"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        usable_fragments, answer_status, answer_counters, answer_fragments, sorted_parts, union_compat, family_members, kind_report, run_stamps, report_json, report_text,
        annotate_placeholders, annotated_documents,
    )
}

_STRICT = r"""
    WITH o AS (SELECT output_id, any_value(body) AS body FROM llm_outputs WHERE output_id IS NOT NULL GROUP BY output_id),
    t AS (SELECT output_id, body, regexp_replace(body, '\A\s*```[a-z]*\s*|\s*```\s*\z', '', 'gs') AS bare FROM o),
    w AS (SELECT output_id, CASE WHEN body IS NULL THEN 'missing' WHEN json_valid(body) THEN 'plain' WHEN json_valid(bare) THEN 'fenced' ELSE 'error' END AS way,
                 CASE WHEN json_valid(body) THEN body::JSON WHEN json_valid(bare) THEN bare::JSON END AS j FROM t),
    parts AS (SELECT output_id, j, CASE WHEN json_type(j, '$.fragments') = 'ARRAY' THEN json_extract(j, '$.fragments[*]') END AS fs,
                     CASE WHEN json_type(j, '$."intro-structures"') = 'ARRAY' THEN json_extract(j, '$."intro-structures"[*]') END AS intro FROM w WHERE j IS NOT NULL),
    good AS (SELECT output_id, fs FROM parts WHERE fs IS NOT NULL AND intro IS NOT NULL AND len(list_filter(intro, lambda x: json_type(x) <> 'VARCHAR')) = 0
        AND len(list_filter(fs, lambda f: NOT (json_type(f) = 'OBJECT' AND coalesce(json_type(f, '$.fragment'), '') = 'VARCHAR' AND coalesce(json_type(f, '$.criteria'), '') = 'VARCHAR'
            AND coalesce(json_type(f, '$.dependencies'), '') = 'ARRAY' AND coalesce(json_type(f, '$.placeholders'), '') = 'ARRAY' AND coalesce(json_type(f, '$.node_kind'), 'NULL') IN ('NULL', 'VARCHAR')
            AND len(list_filter(json_extract(f, '$.dependencies[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0
            AND len(list_filter(json_extract(f, '$.placeholders[*]'), lambda p: NOT (json_type(p) = 'OBJECT' AND coalesce(json_type(p, '$.placeholder'), '') = 'VARCHAR'
                AND coalesce(json_type(p, '$.node_kind'), 'NULL') IN ('NULL', 'VARCHAR')))) = 0))) = 0),
    read AS (SELECT w.output_id, CASE WHEN way IN ('plain', 'fenced') AND g.output_id IS NULL THEN 'schema' ELSE way END AS status, g.fs FROM w LEFT JOIN good g USING (output_id))
"""
_REPORTED = _ENDED + """,
    began AS (SELECT run_id, any_value(timestamp_utc) AS moment, any_value(command_display) AS command FROM outcomes WHERE run_id IS NOT NULL GROUP BY run_id)"""

SQL: dict[str, str] = {
    "usable_fragments": """WITH f AS (SELECT fragment_id, any_value(fragment) AS fragment, any_value(dependencies) AS d FROM annotated_fragments WHERE fragment_id IS NOT NULL GROUP BY fragment_id)
        SELECT fragment_id, coalesce(array_to_string(list_filter(d, lambda x: x IS NOT NULL AND NOT contains(x, 'fn main')), chr(1)), '') AS dependencies FROM f WHERE NOT contains(fragment, 'main')""",
    "answer_status": _STRICT + "SELECT output_id, status FROM read",
    "answer_counters": _STRICT + """SELECT count(*) FILTER (status IN ('plain', 'fenced')) AS loaded, count(*) FILTER (status = 'missing') AS read_failures,
        count(*) FILTER (status IN ('schema', 'error')) AS parse_failures FROM read""",
    "answer_fragments": _STRICT + """, each AS (SELECT output_id, unnest(fs) AS f, generate_subscripts(fs, 1) - 1 AS frag_no FROM read)
        SELECT output_id, frag_no, f ->> '$.fragment' AS fragment, f ->> '$.criteria' AS criteria, coalesce(f ->> '$.node_kind', '') AS node_kind,
               json_array_length(f, '$.dependencies')::BIGINT AS dependencies, json_array_length(f, '$.placeholders')::BIGINT AS placeholders FROM each""",
    "sorted_parts": _ONE + """SELECT snippet_id, coalesce(array_to_string(list_sort(list_distinct(deps)), ','), '') AS deps,
        coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(placeholders, lambda p: p.ph IS NOT NULL),
            lambda p: {'ph': p.ph, 'has': p.kind IS NOT NULL, 'kind': coalesce(p.kind, '')}))), lambda p: p.ph || ':' || p.kind), ','), '') AS placeholders FROM snips""",
    "union_compat": _ONE + """, p AS (SELECT fragment_id, unnest(list_transform(placeholders, lambda p: p.node_kind)) AS kind FROM frags),
        a AS (SELECT DISTINCT fragment_id, unnest(coalesce(b.buckets, [p.kind])) AS bucket FROM p LEFT JOIN bucketed b ON p.kind = b.kind WHERE p.kind IS NOT NULL),
        s AS (SELECT DISTINCT s.kind AS kind, unnest(coalesce(b.buckets, [s.kind])) AS bucket FROM snips s LEFT JOIN bucketed b ON s.kind = b.kind WHERE s.kind IS NOT NULL)
        SELECT fragment_id, count(DISTINCT s.kind) AS kinds FROM a JOIN s USING (bucket) GROUP BY fragment_id""",
    "family_members": _ONE + """, k AS (SELECT DISTINCT kind FROM snips WHERE kind IS NOT NULL),
        m AS (SELECT k.kind, o.kind AS member FROM k JOIN fam f ON f.kind = k.kind JOIN fam o ON o.family = f.family UNION ALL SELECT kind, kind FROM k WHERE kind <> '')
        SELECT k.kind, count(member) AS members, coalesce(string_agg(member, ',' ORDER BY member), '') AS listed FROM k LEFT JOIN m ON k.kind = m.kind GROUP BY k.kind""",
    "kind_report": _ONE + """, t AS (SELECT kind, fragment, snippet_id FROM snips WHERE kind IS NOT NULL AND fragment IS NOT NULL),
        c AS (SELECT kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, kind) AS rank FROM t GROUP BY kind),
        r AS (SELECT kind, fragment, row_number() OVER (PARTITION BY kind ORDER BY encode(fragment), snippet_id) AS no FROM t)
        SELECT 0 AS rank, 0 AS no, coalesce(sum(n), 0)::BIGINT || ' snippets across ' || count(*) || ' node kinds' AS line FROM c
        UNION ALL SELECT rank, 0, c.kind || CASE WHEN b.buckets IS NULL THEN '' ELSE ' [' || array_to_string(b.buckets, ',') || ']' END || ': ' || n FROM c LEFT JOIN bucketed b ON c.kind = b.kind
        UNION ALL SELECT rank, no, '  ' || replace(CASE WHEN length(fragment) > 80 THEN fragment[1:80] || '...' ELSE fragment END, chr(10), '\\n') FROM r JOIN c USING (kind) WHERE no <= 3
        UNION ALL SELECT rank, 4, '  ... and ' || (n - 3) || ' more' FROM c WHERE n > 3""",
    "run_stamps": """SELECT run_id, strftime(any_value(timestamp_utc), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM outcomes WHERE run_id IS NOT NULL AND timestamp_utc IS NOT NULL GROUP BY run_id""",
    "report_json": _REPORTED + _ICE[len(_ONE):] + """, listed AS (SELECT run_id, list({'location': location, 'reason': reason} ORDER BY location, reason) AS ices FROM (SELECT DISTINCT run_id, location, reason FROM inside) GROUP BY run_id)
        SELECT run_id, to_json({'file': e.file, 'timestamp_utc': strftime(moment, '%Y-%m-%dT%H:%M:%SZ'), 'command_display': command, 'termination': kind, 'signal': signal,
            'is_ice': coalesce(len(ices), 0) > 0, 'ices': coalesce(ices, [])})::VARCHAR AS json FROM ended e JOIN began USING (run_id) LEFT JOIN listed USING (run_id)""",
    "report_text": _REPORTED + _ICE[len(_ONE):] + """, listed AS (SELECT run_id, string_agg('  ' || location || chr(10) || '  ' || reason || chr(10), '' ORDER BY location, reason) AS ices
            FROM (SELECT DISTINCT run_id, location, reason FROM inside) GROUP BY run_id),
        firsts AS (SELECT location, reason FROM inside QUALIFY row_number() OVER (PARTITION BY location ORDER BY run_id, place) = 1)
        SELECT 'head' AS section, '' AS name, 'Number of input files: ' || count(DISTINCT file) || chr(10) || 'Total runs: ' || count(*) || chr(10) AS text FROM ended
        UNION ALL SELECT 'run', run_id::VARCHAR, CASE WHEN ices IS NULL THEN 'NO_ICE' ELSE 'ICE' END || ' [' || label || ']' || chr(10) || '  ' || coalesce(e.file, '') || chr(10) || '  ' ||
            coalesce(strftime(moment, '%Y-%m-%dT%H:%M:%SZ'), '') || chr(10) || '  ' || coalesce(command, '') || chr(10) || coalesce(ices, '') || CASE WHEN oom THEN '  (stderr suggests OOM)' || chr(10) ELSE '' END
            FROM ended e JOIN began USING (run_id) LEFT JOIN listed USING (run_id) WHERE kind IS NOT NULL
        UNION ALL SELECT 'unique', location, '  ' || location || ' — ' || reason || chr(10) FROM firsts""",
}
