"""Queries of the training-data problems, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraglight.llm.ledger import formatting_ledger
from fraglight.llm.linkage import link_history
from fraglight.llm.mixing import mixed
from fraglight.llm.neardup import near_duplicate_groups
from fraglight.llm.spans import shared_clusters, shared_spans
from fraglight.llm.terms import marked_terms
from fraglight.llm.tokens import decode_column, encode_column
from fraglight.llm.toxicity import THRESHOLD, fit, labelled_documents, score_documents
from fraglight.sources.tables import table

FILE, SNIPPET = "file", "snippet"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Snippets have even numbers, mutant files odd ones."""
    snippets = table(spark, d, "snippets").select((F.col("snippet_id") * 2).alias("rec"), F.col("fragment").alias("text"))
    files = table(spark, d, "mutant_files").select((F.col("file_id") * 2 + 1).alias("rec"), F.col("file_text").alias("text"))
    return snippets.unionAll(files)


def _kind_of(rec: str) -> F.Column:
    return F.when(F.pmod(F.col(rec), F.lit(2)) == 0, SNIPPET).otherwise(FILE)


def _id_of(rec: str) -> F.Column:
    return F.shiftright(rec, 1)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    spans = shared_spans(_records(spark, d))
    return spans.select(
        _kind_of("rec").alias("record_kind"), _id_of("rec").alias("record_id"), F.col("s").cast("bigint").alias("span_start"), F.col("e").cast("bigint").alias("span_end")
    )


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every record with shared spans: the first record of its cluster, and how many of its characters are shared."""
    found = shared_clusters(_records(spark, d))
    return found.select(
        _kind_of("rec").alias("record_kind"), _id_of("rec").alias("record_id"), _kind_of("cluster").alias("first_kind"), _id_of("cluster").alias("first_id"), F.col("shared").alias("shared_chars")
    )


def _ledger(spark: SparkSession, d: str):
    return formatting_ledger(table(spark, d, "annotated_fragments"), "fragment_id", "fragment", "dependencies", "loaded_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).copies()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct record: its first id and the number of its copies, itself included."""
    return _ledger(spark, d).counts().select("first_id", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    annotated = table(spark, d, "annotated_fragments").select(F.lit("annotated_fragment").alias("record_kind"), F.col("fragment_id").alias("id"), "fragment")
    snippets = table(spark, d, "snippets").select(F.lit("snippet").alias("record_kind"), F.col("snippet_id").alias("id"), "fragment")
    found = near_duplicate_groups(annotated.unionAll(snippets), "id", "fragment", kind="record_kind")
    return found.withColumnRenamed("kind", "record_kind")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    linker, all_ = link_history(table(spark, d, "seen"), table(spark, d, "iterations"))
    return linker.repeated(all_).select(F.col("campaign").alias("campaign_id"), "iter", "pos")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of places that are linked, also through others: their representative and number of lines."""
    linker, _ = link_history(table(spark, d, "seen"), table(spark, d, "iterations"), clusters=True)
    return linker.clusters().groupBy(F.col("root").alias("representative")).agg(F.count("*").alias("lines"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    fragments = table(spark, d, "annotated_fragments")
    kinds = fragments.select(F.lit("fragment.node_kind").alias("field"), F.col("fragment_id").alias("id"), F.array("node_kind").alias("terms"))
    placeholders = fragments.select(F.lit("placeholder.node_kind"), "fragment_id", F.col("placeholders.node_kind"))
    locations = table(spark, d, "outcomes").select(F.lit("ice.location"), "run_id", F.col("ices.location"))
    return kinds.unionAll(placeholders).unionAll(locations)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(_fields(spark, d)).filter("mark is not null").select("field", "term", "mark")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """All terms with their counts."""
    return marked_terms(_fields(spark, d)).select("field", "term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids."""
    return decode_column(p8_ids(spark, d), "doc_id", "ids")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often they come."""
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of each source that was asked for and reached."""
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _scored(spark: SparkSession, d: str, also: str | None = None) -> DataFrame:
    documents = table(spark, d, "documents")
    model = fit(labelled_documents(documents, table(spark, d, "doc_labels")))
    return score_documents(documents, "doc_id", "text", model, also)


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score and the offsets of what offends."""
    return _scored(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("score") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and found ones of each source, and their rate. Documents without a source make a group of their own."""
    by = _scored(spark, d, "source").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= THRESHOLD).alias("found"))
    return by.withColumn("rate", F.col("found") / F.col("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_counts, p3_found, p4_found, p4_clusters, p7_found, p7_counts, p8_ids, p8_decoded, p9_documents, p9_shares, p10_found, p10_scores, p10_rates)
}

_KEYS = """
    WITH one AS (SELECT fragment_id, any_value(fragment) AS fragment, any_value(dependencies) AS dependencies
                 FROM annotated_fragments WHERE fragment_id IS NOT NULL GROUP BY fragment_id),
    keyed AS (SELECT fragment_id, lower(regexp_replace(fragment, '[^\\p{L}\\p{N}]+', '', 'g')) AS body,
                     list_sort(list_distinct(list_filter(list_transform(coalesce(dependencies, []),
                         lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]+', '', 'g'))), lambda x: x <> ''))) AS parts
              FROM one),
    grouped AS (SELECT body, parts, min(fragment_id) AS first_id, count(*) AS copies FROM keyed
                WHERE body <> '' GROUP BY body, parts)
"""

_PLACES = """
    WITH raw AS (
        SELECT campaign_id, iter, pos, location FROM (
            SELECT DISTINCT campaign_id, iter, unnest(range(len(new_locations))) AS pos, unnest(new_locations) AS location FROM iterations)
        UNION ALL SELECT campaign_id, -4611686018427387904, -1, location FROM (SELECT DISTINCT campaign_id, location FROM seen)),
    cleaned AS (SELECT campaign_id, iter, pos, regexp_replace(replace(lower(location), chr(92), '/'), '/(\\./|/)*', '/', 'g') AS p FROM raw),
    places AS (SELECT campaign_id, iter, pos, regexp_extract(p, '((compiler|library)/.*\\.rs)', 1) AS file,
                      try_cast(regexp_extract(p, '\\.rs[^0-9]*([0-9]+)', 1) AS BIGINT) AS line FROM cleaned)
"""

_TERMS = """
    WITH f AS (SELECT fragment_id AS id, any_value(node_kind) AS kind, any_value(list_transform(placeholders, lambda x: x.node_kind)) AS kinds
               FROM annotated_fragments GROUP BY fragment_id),
    o AS (SELECT run_id AS id, any_value(list_transform(ices, lambda x: x.location)) AS places FROM outcomes GROUP BY run_id),
    occurrence AS (SELECT 'fragment.node_kind' AS field, id, kind AS term FROM f
          UNION ALL SELECT 'placeholder.node_kind', id, unnest(kinds) FROM f
          UNION ALL SELECT 'ice.location', id, unnest(places) FROM o),
    every AS (SELECT * FROM occurrence WHERE term IS NOT NULL),
    total AS (SELECT field, count(DISTINCT id) AS n FROM every GROUP BY field),
    counted AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records,
                       CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(DISTINCT id) > 0.1 * any_value(n) THEN 'common' ELSE '' END AS mark
                FROM every JOIN total USING (field) GROUP BY field, term)
"""

_WINDOWS = """
    WITH RECURSIVE records AS (
        SELECT 'snippet' AS record_kind, snippet_id AS record_id, 2 * snippet_id AS rec, any_value(fragment) AS t FROM snippets WHERE fragment IS NOT NULL GROUP BY snippet_id
        UNION ALL SELECT 'file', file_id, 2 * file_id + 1, any_value(file_text) FROM mutant_files WHERE file_text IS NOT NULL GROUP BY file_id),
    windows AS MATERIALIZED (SELECT rec, i, t[i + 1:i + 160] AS x FROM (SELECT rec, t, unnest(range(0, length(t) - 159)) AS i FROM records WHERE length(t) >= 160)),
    held AS MATERIALIZED (SELECT x, min(rec) AS hub FROM windows GROUP BY x HAVING min(rec) <> max(rec)),
    hits AS MATERIALIZED (SELECT rec, i, hub FROM windows JOIN held USING (x)),
    steps AS (SELECT rec, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rec ORDER BY i) + 160 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT rec, i FROM hits)),
    runs AS (SELECT rec, i, sum(new) OVER (PARTITION BY rec ORDER BY i) AS run FROM steps),
    spans AS (SELECT rec, min(i) AS s, max(i) + 160 AS e FROM runs GROUP BY rec, run)
"""

_SIMILAR = """
    WITH RECURSIVE raw AS (
        SELECT 'annotated_fragment' AS record_kind, fragment_id AS id, lower(regexp_replace(any_value(fragment), '[^\\p{L}\\p{N}]+', '', 'g')) AS t FROM annotated_fragments GROUP BY fragment_id
        UNION ALL SELECT 'snippet', snippet_id, lower(regexp_replace(any_value(fragment), '[^\\p{L}\\p{N}]+', '', 'g')) FROM snippets GROUP BY snippet_id),
    texts AS (SELECT record_kind, t, min(id) AS id FROM raw WHERE length(t) >= 100 GROUP BY record_kind, t),
    grams AS MATERIALIZED (SELECT DISTINCT record_kind, id, t[i:i + 4] AS g FROM (SELECT *, unnest(range(1, length(t) - 3)) AS i FROM texts)),
    sizes AS MATERIALIZED (SELECT record_kind, id, count(*) AS n FROM grams GROUP BY ALL),
    links AS MATERIALIZED (SELECT m.record_kind, x, y FROM (SELECT a.record_kind, a.id AS x, b.id AS y, count(*) AS c FROM grams a JOIN grams b ON a.record_kind = b.record_kind AND a.g = b.g AND a.id <> b.id GROUP BY ALL) m
        JOIN sizes p ON p.record_kind = m.record_kind AND p.id = x JOIN sizes q ON q.record_kind = m.record_kind AND q.id = y WHERE c >= 0.7 * (p.n + q.n - c)),
    reach AS (SELECT record_kind, id AS x, id AS y FROM texts UNION SELECT r.record_kind, r.x, l.y FROM reach r JOIN links l ON l.record_kind = r.record_kind AND l.x = r.y),
    roots AS (SELECT record_kind, x, min(y) AS root FROM reach GROUP BY ALL)
    SELECT raw.record_kind, root AS first_id, raw.id AS other_id FROM raw JOIN texts USING (record_kind, t) JOIN roots ON roots.record_kind = raw.record_kind AND roots.x = texts.id WHERE raw.id <> root
"""

SQL: dict[str, str] = {
    "p1_found": _WINDOWS + "SELECT record_kind, record_id, s AS span_start, e AS span_end FROM spans JOIN records USING (rec)",
    "p1_clusters": _WINDOWS + """, pairs AS MATERIALIZED (SELECT DISTINCT rec AS a, hub AS b FROM hits WHERE rec <> hub),
    both_ways AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (SELECT DISTINCT a AS x, a AS y FROM both_ways UNION SELECT r.x, p.b FROM reach r JOIN both_ways p ON p.a = r.y),
    roots AS (SELECT x AS rec, min(y) AS root FROM reach GROUP BY x),
    sums AS (SELECT rec, sum(e - s)::BIGINT AS n FROM spans GROUP BY rec)
    SELECT r.record_kind, r.record_id, f.record_kind AS first_kind, f.record_id AS first_id, n AS shared_chars
    FROM sums JOIN roots USING (rec) JOIN records r USING (rec) JOIN records f ON f.rec = root""",
    "p3_found": _SIMILAR,
    "p4_clusters": _PLACES + """, l AS (SELECT DISTINCT campaign_id, file, line FROM places WHERE file <> '' AND line IS NOT NULL AND campaign_id IS NOT NULL AND iter IS NOT NULL),
        steps AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY campaign_id, file ORDER BY line) <= 3 THEN 0 ELSE 1 END AS new FROM l),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY campaign_id, file ORDER BY line) AS run FROM steps)
        SELECT campaign_id || ' ' || file || ' ' || lpad(min(line)::VARCHAR, 12, '0') AS representative, count(*) AS lines FROM runs GROUP BY campaign_id, file, run""",
    "p2_found": _KEYS + "SELECT first_id, fragment_id AS copy_id FROM keyed JOIN grouped USING (body, parts) WHERE fragment_id <> first_id",
    "p2_counts": _KEYS + "SELECT first_id, copies FROM grouped",
    "p4_found": _PLACES + """SELECT DISTINCT x.campaign_id, x.iter, x.pos FROM places x JOIN places y
        ON x.campaign_id = y.campaign_id AND x.file = y.file AND abs(x.line - y.line) <= 3
        AND (y.iter < x.iter OR (y.iter = x.iter AND y.pos < x.pos)) WHERE x.pos >= 0 AND x.file <> ''""",
    "p7_found": _TERMS + "SELECT field, term, mark FROM counted WHERE mark <> ''",
    "p7_counts": _TERMS + "SELECT field, term, occurrences, records, mark FROM counted",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
