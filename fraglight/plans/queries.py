"""Queries of the core operators over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraglight.functions import families as fam
from fraglight.functions import termination as term
from fraglight.functions import text as tx
from fraglight.operators import bundles, diagnostics, spans
from fraglight.operators.locate import candidates
from fraglight.operators.loglines import log_entries, parsed_lines
from fraglight.operators.campaign import Campaign
from fraglight.operators.mutate import PROFILES, attribute_mutants, branch, filled, finished, type_mutants, value_mutants
from fraglight.operators.nested import nested_children
from fraglight.operators.nodes import annotated, structures, syntax_nodes
from fraglight.operators.ranking import indexed, pick
from fraglight.operators.splicing import attempts, drawn_slots, drawn_snippets, mutants, snippet_pool
from fraglight.sources.files import by_content
from fraglight.sources.tables import new_path, staged, table
from fraglight.streaming.dedup import exploded, file_stream, first_seen

VARIANTS = [("emit-mir", ["--emit=mir"]), ("opt", ["-Copt-level=3"]), ("plain", [])]
FRONT, END = "Collect the fragments of this program.\n\n```\n", "```\n\nAnswer with one JSON object.\n"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run once."""
    return table(spark, d, "outcomes").filter("run_id is not null").dropDuplicates(["run_id"])


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mutant_files").filter("file_id is not null").dropDuplicates(["file_id"])


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotated_fragments").filter("fragment_id is not null").dropDuplicates(["fragment_id"])


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snippets").filter("snippet_id is not null").dropDuplicates(["snippet_id"])


def _crashes(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, file, pos, location, reason) of crashes in the compiler."""
    parsed = _runs(spark, d).select("run_id", "file", diagnostics.compiler_only(diagnostics.crashes(F.col("stderr"))).alias("ices"))
    return parsed.select("run_id", "file", F.posexplode("ices").alias("pos", "ice")).select("run_id", "file", F.col("pos").cast("bigint").alias("pos"), "ice.location", "ice.reason")


def ice_parse(spark: SparkSession, d: str) -> DataFrame:
    """Crash places and reasons of every diagnostic text."""
    parsed = _runs(spark, d).select("run_id", F.explode(diagnostics.crashes(F.col("stderr"))).alias("ice"))
    return parsed.select("run_id", "ice.location", "ice.reason")


def ice_compiler(spark: SparkSession, d: str) -> DataFrame:
    """Those in the compiler, from there on."""
    return _crashes(spark, d).select("run_id", "location", "reason").distinct()


def unique_locations(spark: SparkSession, d: str) -> DataFrame:
    """The first sighting of each place, whatever its reason later."""
    return diagnostics.first_sightings(_crashes(spark, d).drop("file"), ["location"], ["run_id", "pos"]).select("location", "run_id", "reason")


def campaign_progress(spark: SparkSession, d: str) -> DataFrame:
    """New places and running totals of each campaign and iteration."""
    where = _files(spark, d).filter("campaign_id is not null and iter is not null").select("file", "campaign_id", "iter")
    runs = _runs(spark, d).select("run_id", "file").join(where, "file")
    crashes = _crashes(spark, d).join(where, "file").select("campaign_id", "iter", "file", "location")
    return diagnostics.progress(crashes, runs).select("campaign_id", "iter", "runs", "ice_files", "new_locations", "cumulative")


def _ended(spark: SparkSession, d: str) -> DataFrame:
    kind, signal = F.col("termination.kind"), F.col("termination.signal")
    new = term.reclassified(kind, signal, F.col("stderr"))
    return _runs(spark, d).select("run_id", "file", new.alias("kind"), F.when(new == "Signal", signal).alias("signal"), term.hints_oom(F.col("stderr")).alias("oom"))


def termination_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How runs ended, with a row for each signal."""
    by = _ended(spark, d).groupBy("kind", "signal").agg(F.count("*").alias("runs"), F.count_if("oom").alias("oom_hints"))
    return by.select("kind", "signal", term.label(F.col("kind"), F.col("signal")).alias("label"), "runs", "oom_hints")


def abnormal_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs that didn't end by themselves, and what that may mean."""
    kind, signal = F.col("kind"), F.col("signal")
    return _ended(spark, d).filter("kind <> 'Normal'").select("run_id", "file", term.label(kind, signal).alias("label"), term.hint(kind, signal).alias("hint"))


def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a report for each variant."""
    ices = diagnostics.compiler_only(diagnostics.crashes(F.col("stderr")))
    runs = _runs(spark, d).select("variant_label", "file", ices.alias("ices"))
    totals = runs.groupBy("variant_label").agg(F.count("*").alias("runs"), F.count_distinct("file").alias("files"), F.count_if(F.size("ices") > 0).alias("ice_runs"), F.sum(F.size("ices")).cast("bigint").alias("ices"))
    places = runs.select("variant_label", F.explode("ices.location").alias("l")).groupBy("variant_label").agg(F.count_distinct("l").alias("unique_locations"))
    return totals.join(places, "variant_label", "left").fillna(0, ["unique_locations"])


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """A report line for each run with a crash, its places in order."""
    ices = diagnostics.compiler_only(diagnostics.crashes(F.col("stderr")))
    runs = _runs(spark, d).select("run_id", "file", "variant_label", ices.alias("ices")).filter(F.size("ices") > 0)
    line = F.concat(F.lit("ICE "), F.coalesce("file", F.lit("?")), F.lit(" ["), F.coalesce("variant_label", F.lit("?")), F.lit("] "), F.array_join(F.array_sort(F.array_distinct("ices.location")), "; "))
    return runs.select("run_id", line.alias("line"))


def debug_summary(spark: SparkSession, d: str) -> DataFrame:
    """The counts of how the runs of each variant ended as a text; lines of rare ends only where there are some."""
    ended = _ended(spark, d).join(_runs(spark, d).select("run_id", "variant_label"), "run_id").filter("variant_label is not null")
    return bundles.ending_summary(ended, "variant_label").select("variant_label", "summary")


def debug_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line for each run that didn't end by itself: how it ended, its memory, and whether it crashed or ran out of memory."""
    more = _runs(spark, d).select("run_id", "variant_label", "peak_rss_mb", (F.size(diagnostics.compiler_only(diagnostics.crashes(F.col("stderr")))) > 0).alias("is_ice"))
    return _ended(spark, d).filter("kind <> 'Normal'").join(more, "run_id").select("run_id", bundles.ending_line().alias("line"))


def file_locations(spark: SparkSession, d: str) -> DataFrame:
    """The places at which each file crashed, all its variants together."""
    each = _crashes(spark, d).filter("file is not null").groupBy("file").agg(F.array_sort(F.collect_set("location")).alias("locations"))
    return each.select("file", F.size("locations").cast("bigint").alias("n"), F.array_join("locations", "; ").alias("locations"))


def kept_ices(spark: SparkSession, d: str) -> DataFrame:
    """Crash files under the names that a campaign keeps them by, and whether one has a place that no file before it had."""
    where = _files(spark, d).filter("campaign_id is not null and iter is not null").select("file", "campaign_id", "iter")
    hit = _crashes(spark, d).join(where, "file").select("campaign_id", "iter", "file", "location").distinct()
    firsts = diagnostics.first_sightings(hit, ["campaign_id", "location"], ["iter", "file"]).groupBy("campaign_id", "iter", "file").agg(F.count("*").alias("new_locations"))
    every = hit.groupBy("campaign_id", "iter", "file").agg(F.count("*").alias("locations")).join(firsts, ["campaign_id", "iter", "file"], "left")
    name = F.concat(F.lit("iter"), F.col("iter").cast("string"), F.lit("_"), F.substring_index("file", "/", -1))
    return every.select("campaign_id", name.alias("name"), "file", "locations", F.coalesce("new_locations", F.lit(0)).alias("new_locations"))


def fragment_records(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of each kind as records; those of several files stand once for each."""
    each = _snippets(spark, d).filter("fragment is not null and kind is not null").select("filename", "kind", "fragment").distinct()
    return each.select("fragment", F.col("kind").alias("node_kind"))


def answer_match(spark: SparkSession, d: str) -> DataFrame:
    """How many answers have a source of their name, have none, or can't be read."""
    body = F.regexp_replace("body", r"(?s)\A\s*```[a-z]*\s*|\s*```\s*\z", "")
    answers = table(spark, d, "llm_outputs").filter("output_id is not null").dropDuplicates(["output_id"]).select("rel", F.try_parse_json(body).isNotNull().alias("readable"))
    sources = _files(spark, d).filter("seed_file is not null").select(F.col("seed_file").alias("rel"), F.lit(True).alias("known")).distinct()
    status = F.when(~F.col("readable"), "unreadable").when(F.col("known"), "matched").otherwise("no source")
    return answers.join(sources, "rel", "left").groupBy(status.alias("status")).agg(F.count("*").alias("answers"))


def synced_seeds(spark: SparkSession, d: str) -> DataFrame:
    """How many seeds have fragments, and how many have none."""
    counted = ingredient_join(spark, d)
    return counted.agg(F.count("*").alias("seeds"), F.count_if(F.col("fragments") > 0).alias("with_fragments"), F.coalesce(F.sum("fragments"), F.lit(0)).alias("fragments"))


def seed_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files that may be seeds."""
    kept = _files(spark, d).filter(F.col("file_text").isNotNull())
    return kept.filter(~tx.seed_ignored(F.col("file_text"), F.col("file"))).select("file_id")


def fp_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files without a word that feigns a crash."""
    return _files(spark, d).filter(F.col("file_text").isNotNull()).filter(~tx.contains_any(F.col("file_text"), tx.FALSE_POSITIVES)).select("file_id")


def _located(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, snippet_id, s, e, match_no): the places of snippets in the files of their seed."""
    files = _files(spark, d).filter("seed_file is not null and file_text is not null").select("file_id", "seed_file", "file_text")
    snippets = _snippets(spark, d).filter("filename is not null").select("snippet_id", F.col("filename").alias("seed_file"), "fragment")
    pairs = candidates(files, snippets, "seed_file", "file_id", "file_text", "snippet_id", "fragment")
    return tx.located(staged(pairs, "pairs"), files, "file_id", "file_text", snippets, "snippet_id", "fragment")


def fragment_locate(spark: SparkSession, d: str) -> DataFrame:
    """First place of each fragment in the files of its seed, white space and commas aside, in bytes."""
    return _located(spark, d).filter("match_no = 0").select("file_id", "snippet_id", "s", "e")


def fragment_locate_all(spark: SparkSession, d: str) -> DataFrame:
    """All places, nine at most of each: the bound is the operator's own."""
    return _located(spark, d)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, no, s, e) of the lines of all files, in bytes."""
    lines = _files(spark, d).filter("file_text is not null").select("file_id", F.posexplode(F.split("file_text", "\n")).alias("no", "line"))
    order = Window.partitionBy("file_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(order), F.lit(0))
    return lines.select("file_id", F.col("no").cast("bigint").alias("no"), before.cast("bigint").alias("s"), (before + F.octet_length("line")).cast("bigint").alias("e"))


def span_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files with what the fragments that overlap them depend on."""
    spans2 = staged(_located(spark, d), "matches").select("file_id", "snippet_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = spans.overlap_join(_lines(spark, d), spans2, ["file_id"]).select("file_id", "no", "snippet_id").distinct()
    met = met.join(_snippets(spark, d).select("snippet_id", "deps"), "snippet_id")
    each = met.select("file_id", "no", "snippet_id", F.explode_outer("deps").alias("dep"))
    return each.groupBy("file_id", "no").agg(F.count_distinct("snippet_id").alias("fragments"), F.count_distinct("dep").alias("dependencies"))


def span_containment(spark: SparkSession, d: str) -> DataFrame:
    """The deepest node that covers each fragment: its line, or the file."""
    found = staged(_located(spark, d), "matches").filter("match_no = 0")
    lines = _lines(spark, d).select("file_id", "s", "e", F.lit("line").alias("kind"), F.lit(1).alias("depth"))
    roots = _files(spark, d).filter("file_text is not null").select("file_id", F.lit(0).cast("bigint").alias("s"), F.octet_length("file_text").cast("bigint").alias("e"), F.lit("source_file").alias("kind"), F.lit(0).alias("depth"))
    targets = found.select("file_id", "snippet_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return spans.deepest_cover(lines.unionAll(roots), targets, ["file_id"], ["file_id", "snippet_id"]).select("file_id", "snippet_id", "kind", "s", "e")


def kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Snippets and distinct texts of each kind."""
    by = _snippets(spark, d).filter("kind is not null").groupBy("kind").agg(F.count("*").alias("snippets"), F.count_distinct("fragment").alias("texts"))
    return by.withColumn("possible", F.greatest(F.col("snippets") - 1, F.lit(0)))


def kind_previews(spark: SparkSession, d: str) -> DataFrame:
    """The three first texts of each kind by order, shortened."""
    texts = _snippets(spark, d).filter("kind is not null and fragment is not null").select("kind", "fragment").distinct()
    rank = indexed(texts, ["fragment"], ["kind"], "rank").filter("rank < 3")
    return rank.select("kind", "rank", tx.preview(F.col("fragment")).alias("preview"))


def family_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of each bucket; a kind of several families counts in each."""
    each = _snippets(spark, d).select(F.explode(fam.buckets_of(F.col("kind"))).alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias("snippets"))


def family_compat(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of fragments with the kinds of snippets that may take their place: kinds, not rows, are paired by bucket."""
    a = _fragments(spark, d).filter("node_kind is not null").select(F.col("node_kind").alias("kind")).distinct()
    b = _snippets(spark, d).filter("kind is not null").select(F.col("kind").alias("other")).distinct()
    left = a.select("kind", F.explode(fam.buckets_of(F.col("kind"))).alias("bucket"))
    right = b.select("other", F.explode(fam.buckets_of(F.col("other"))).alias("bucket"))
    return left.join(right, "bucket").select("kind", "other").distinct()


def family_with_parent(spark: SparkSession, d: str) -> DataFrame:
    """Families of placeholders, told apart by their fragment's kind."""
    each = _fragments(spark, d).select(F.col("node_kind").alias("parent"), F.explode("placeholders.node_kind").alias("kind"))
    found = each.select("kind", "parent", F.array_join(fam.families_with_parent(F.col("kind"), F.col("parent")), ",").alias("families"))
    return found.groupBy("families").agg(F.count("*").alias("placeholders"))


def ingredient_join(spark: SparkSession, d: str) -> DataFrame:
    """Seeds with the number of fragments that were collected from them; none for most."""
    seeds = _files(spark, d).filter("seed_file is not null").select("seed_file").distinct()
    counts = _fragments(spark, d).filter("rel is not null").groupBy("rel").agg(F.count("*").alias("n"))
    joined = seeds.join(counts, seeds["seed_file"] == counts["rel"], "left")
    return joined.select("seed_file", tx.json_name(F.col("seed_file")).alias("json_name"), F.coalesce("n", F.lit(0)).alias("fragments"))


def plain_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of each file after the plain ones (no dependencies or placeholders) are made distinct by kind and text."""
    all_ = _snippets(spark, d).withColumn("plain", (F.coalesce(F.size("deps"), F.lit(0)) <= 0) & (F.coalesce(F.size("placeholders"), F.lit(0)) <= 0))
    plain = all_.filter("plain").select("filename", "kind", "fragment").distinct().groupBy("filename").agg(F.count("*").alias("n"))
    others = all_.filter("not plain").groupBy("filename").agg(F.count("*").alias("n"))
    return plain.unionAll(others).groupBy("filename").agg(F.sum("n").alias("snippets"))


def variant_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The command of every file with every variant."""
    every = bundles.variants_of(_files(spark, d), VARIANTS)
    args = bundles.command("rustc", F.col("flags"), F.col("file_text"), F.col("file"))
    return every.select("file_id", "label", F.array_join(args, " ").alias("command"))


def dep_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies of fragments numbered by first sighting."""
    each = _fragments(spark, d).select("fragment_id", F.posexplode("dependencies").alias("pos", "dep")).filter("dep is not null")
    firsts = each.groupBy("dep").agg(F.min(F.struct("fragment_id", "pos")).alias("first")).select("dep", "first.fragment_id", F.col("first.pos").cast("bigint").alias("pos"))
    return indexed(firsts, ["fragment_id", "pos"], name="dep_id").select("dep_id", "dep")


def dependency_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """What goes before a fragment: its dependencies, sorted, each once; and the trailer that names its origin."""
    got = _fragments(spark, d).filter("rel is not null")
    return got.select("fragment_id", F.coalesce(tx.dependency_prefix(F.col("dependencies")), F.lit("")).alias("prefix"), tx.provenance(F.col("rel"), F.array(F.lit("deps"))).alias("trailer"))


def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer is JSON as it is, once its fences are off, or not at all."""
    got = table(spark, d, "llm_outputs").filter("output_id is not null and body is not null").dropDuplicates(["output_id"])
    inner = F.regexp_replace("body", r"(?s)\A\s*```[a-z]*\s*|\s*```\s*\z", "")
    status = F.when(F.try_parse_json("body").isNotNull(), "plain").when(F.try_parse_json(inner).isNotNull(), "fenced").otherwise("error")
    return got.select("output_id", status.alias("status"))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    """One to three lines of each file, picked by hash: three sevenths have one, three sevenths two."""
    draw = F.pmod(pick(F.col("file_id").cast("string"), F.lit("times")), F.lit(7))
    times = F.when(draw < 3, 1).when(draw < 6, 2).otherwise(3)
    lines = _lines(spark, d).filter("s < e").withColumn("h", pick(F.col("file_id").cast("string"), F.col("no").cast("string")))
    best = F.slice(F.array_sort(F.collect_list(F.struct("h", "no", "s", "e"))), 1, 3)
    by_file = lines.groupBy("file_id").agg(best.alias("best"))
    return by_file.select("file_id", F.posexplode(F.slice("best", F.lit(1), times)).alias("n", "x")).select("file_id", F.col("n").cast("bigint").alias("n"), "x.no", "x.s", "x.e")


def slot_sampling(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d)


def splice_mutants(spark: SparkSession, d: str) -> DataFrame:
    """Files with one picked line replaced by a picked snippet of the Expr family; ids are hashes of the content."""
    pool = _snippets(spark, d).filter("fragment is not null").select("snippet_id", "fragment", F.explode(fam.buckets_of(F.col("kind"))).alias("bucket")).filter("bucket = 'Expr'")
    pool = staged(indexed(pool, ["snippet_id"], ["bucket"], "at"), "pool")
    n = pool.groupBy("bucket").agg(F.count("*").alias("size"))
    slots = _slots(spark, d).filter("n = 0").withColumn("bucket", F.lit("Expr")).join(F.broadcast(n), "bucket")  # one row
    drawn = slots.withColumn("at", F.pmod(pick(F.col("file_id").cast("string"), F.lit("snippet")), F.col("size"))).join(pool, ["bucket", "at"])
    texts = _files(spark, d).select("file_id", "file_text")
    edit = F.array(F.struct(F.col("s"), F.col("e"), F.col("fragment").alias("t")))
    made = drawn.join(texts, "file_id").select("file_id", "snippet_id", tx.splice(F.col("file_text"), edit).alias("text"))
    made = made.filter(~tx.contains_any(F.col("text"), tx.FALSE_POSITIVES))
    return made.select("file_id", "snippet_id", F.sha2("text", 256).alias("id"))


def multi_splice(spark: SparkSession, d: str) -> DataFrame:
    """Files with all their picked lines replaced by `()` at once."""
    edits = _slots(spark, d).groupBy("file_id").agg(F.collect_list(F.struct("s", "e", F.lit("()").alias("t"))).alias("edits"))
    texts = _files(spark, d).select("file_id", "file_text")
    return edits.join(texts, "file_id").select("file_id", tx.splice(F.col("file_text"), F.col("edits")).alias("text"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return syntax_nodes(_files(spark, d), "file_id", "file_text")


def node_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Structures of each kind, and how many distinct files and texts have them."""
    nodes = structures(_nodes(spark, d))
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"), F.count_distinct("file_id").alias("files"))


def annotate_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind that each snippet has in the files of its seed where it stands, with or without comments; null where it has none. A
    snippet that stands in no file has one row, without a file and a kind."""
    commented = F.col("fragment").rlike(r"//|/\*")
    files = _files(spark, d).filter("seed_file is not null and file_text is not null").select("file_id", "seed_file", "file_text")
    snippets = _snippets(spark, d).filter("fragment is not null").select("snippet_id", F.col("filename").alias("seed_file"), "fragment")
    texts = files.withColumn("file_text", F.concat("file_text", F.lit("\u0000"), tx.without_comments(F.col("file_text"))))  # a gram of both is one key
    needles = snippets.unionAll(snippets.filter(commented).withColumn("fragment", tx.without_comments(F.col("fragment"))))
    held = candidates(texts, needles, "seed_file", "file_id", "file_text", "snippet_id", "fragment").distinct()
    found = annotated(staged(held, "pairs"), staged(_nodes(spark, d), "nodes"), files, "file_id", "file_text", snippets, "snippet_id", "fragment").filter("stands")
    return snippets.select("snippet_id").join(found, "snippet_id", "left").select("file_id", "snippet_id", "node_kind")


def edit_mutants(spark: SparkSession, d: str) -> DataFrame:
    """Mutants by one edit of a type, a value or an attribute; each file in the way that its hash gives."""
    files = _files(spark, d).filter("file_text is not null and seed_file is not null")
    ways = files.select("file_id", branch(PROFILES["edits_only"], F.col("file_id").cast("string")).alias("way"))
    nodes = staged(_nodes(spark, d), "nodes")
    attributes = indexed(_snippets(spark, d).filter("kind like '%attribute_item' and fragment is not null").select(F.col("fragment").alias("attribute")).distinct(), ["attribute"], name="n")
    made = {"type": type_mutants(nodes, files, "file_id", "file_text"), "value": value_mutants(nodes, files, "file_id", "file_text"), "attribute": attribute_mutants(nodes, files, "file_id", "file_text", attributes)}
    out = None
    for way, mutants in made.items():
        own = mutants.join(ways.filter(F.col("way") == way), "file_id")
        out = own if out is None else out.unionByName(own)
    return finished(out.join(files.select("file_id", "seed_file"), "file_id"), "mutant", F.col("seed_file"), F.array().cast("array<string>")).select("file_id", "way", "id")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    kept = _files(spark, d).filter("file_text is not null and seed_file is not null")
    return kept.filter(~tx.seed_ignored(F.col("file_text"), F.col("file"))).select("file_id", "seed_file", "file_text")


def _pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snippets and dependencies that mutants are made of: no collected fragment with `main`, no dependency that defines it."""
    snippets = _snippets(spark, d).filter(~(F.coalesce(F.col("source") == "fragment", F.lit(False)) & F.coalesce(tx.holds_main(F.col("fragment")), F.lit(False))))
    return snippets, table(spark, d, "deps").filter("dep is not null and not contains(dep, 'fn main')")


def _mutants(spark: SparkSession, d: str, profile: str) -> DataFrame:
    seeds = staged(_seeds(spark, d), "seeds")
    nodes, config = structures(syntax_nodes(seeds, "file_id", "file_text")), PROFILES[profile]
    if config.placeholders or config.splice < 100:  # else they are read once
        nodes = staged(nodes, "nodes")
    return mutants(nodes, seeds, *_pool(spark, d), config, "file_id", "file_text", "seed_file")


def corpus_mutants(spark: SparkSession, d: str) -> DataFrame:
    """Ten attempts at every file in the way that its hash gives: spliced with snippets of fitting families, their placeholders filled
    and dependencies in front, or edited once."""
    made = _mutants(spark, d, "full")
    return made.select("file_id", "attempt", "way", "id", F.octet_length("content").cast("bigint").alias("bytes"))


def baseline_mutants(spark: SparkSession, d: str) -> DataFrame:
    """Ten attempts at every file with two to nine slots, a third of them chaotic, nothing else adapted."""
    made = _mutants(spark, d, "baseline")
    return made.select("file_id", "attempt", "id", F.octet_length("content").cast("bigint").alias("bytes"))


def splice_draws(spark: SparkSession, d: str) -> DataFrame:
    """How often snippets of each bucket and domain take the place of each kind of node."""
    tries = attempts(_seeds(spark, d), "file_id", PROFILES["full"]).filter("way = 'splice'")
    slots = drawn_slots(staged(structures(_nodes(spark, d)), "nodes"), tries, "file_id")
    pool = snippet_pool(_snippets(spark, d).filter("fragment is not null"), "source", "kind", "snippet_id")
    return drawn_snippets(slots, pool, PROFILES["full"]).groupBy("kind", "domain", "bucket").agg(F.count("*").alias("slots"), F.count_distinct("snippet_id").alias("snippets"))


def placeholder_fill(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with every second placeholder, by hash, filled with a name of the file."""
    got = _fragments(spark, d).filter("fragment is not null and placeholders is not null")
    names = F.transform("placeholders", lambda p: p.placeholder)
    chosen = F.transform(names, lambda n: F.when(F.pmod(pick(F.col("fragment_id").cast("string"), n), F.lit(2)) == 0, F.concat(F.lit("filled_"), F.col("fragment_id").cast("string"))))
    return filled(got.select("fragment_id", "fragment", names.alias("names"), chosen.alias("chosen")), "fragment", "names", "chosen").select("fragment_id", "filled")


def campaign_loop(spark: SparkSession, d: str) -> DataFrame:
    """The places that a campaign holds after it took in all runs, a variant in each iteration."""
    runs = _runs(spark, d).select("file", "stderr", "variant_label")
    campaign = Campaign(spark, new_path(spark, "campaign"))
    for label in ("emit-mir", None):
        campaign.step(runs.filter(F.col("variant_label").eqNullSafe(label) if label else ~F.col("variant_label").eqNullSafe("emit-mir")))
    return campaign.seen().select("location", "first_iter")


def comment_removal(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).filter("file_text is not null").select("file_id", tx.without_comments(F.col("file_text")).alias("code"))


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    kept = _files(spark, d).filter(~tx.is_blank(F.col("file_text")))
    return kept.select("file_id", tx.prompt(F.col("file_text"), FRONT, END).alias("prompt"))


def hashed_files(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts by a hash of their content."""
    return by_content(_files(spark, d), "file_text").select("id", F.octet_length("text").cast("bigint").alias("bytes"))


def crash_files(spark: SparkSession, d: str) -> DataFrame:
    """Files to keep: those that made the compiler crash."""
    hit = _crashes(spark, d).select("file").distinct()
    return _files(spark, d).join(hit, "file", "left_semi").select("file_id", "file")


def dropped_files(spark: SparkSession, d: str) -> DataFrame:
    """Files to delete: they ran, and never crashed it."""
    ran = _runs(spark, d).select("file").distinct()
    hit = _crashes(spark, d).select("file").distinct()
    return _files(spark, d).join(ran, "file", "left_semi").join(hit, "file", "left_anti").select("file_id", "file")


def _new_places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "iterations").select("campaign_id", "iter", F.explode("new_locations").alias("location")).filter("campaign_id is not null and location is not null")


def unseen_locations(spark: SparkSession, d: str) -> DataFrame:
    """Logged places, as written, that the campaign's state before didn't hold."""
    return _new_places(spark, d).select("campaign_id", "location").distinct().join(table(spark, d, "seen"), ["campaign_id", "location"], "left_anti")


def iteration_log(spark: SparkSession, d: str) -> DataFrame:
    """The log text of each iteration."""
    got = table(spark, d, "iterations").filter("campaign_id is not null and iter is not null").dropDuplicates(["campaign_id", "iter"])
    return got.select("campaign_id", "iter", bundles.iteration_block(F.col("iter"), F.col("mutants"), F.col("ice_files"), F.col("cumulative"), F.col("new_locations")).alias("block"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each campaign's places once, from a stream of the files of iterations."""
    stream = exploded(file_stream(spark, d, "iterations"), "new_locations", "location", "campaign_id")
    return first_seen(stream, ["campaign_id", "location"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = nested_children(table(spark, d, "llm_outputs"), "output_id", "body")
    return found.select("output_id", "child", "frag_no", "item_no")


def p5_children(spark: SparkSession, d: str) -> DataFrame:
    """The child rows with their texts and kinds."""
    return nested_children(table(spark, d, "llm_outputs"), "output_id", "body")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = log_entries(table(spark, d, "outcomes"), "run_id", "stderr", "timestamp_utc")
    return found.select("run_id", "line_no", "level", "component", "logged_at")


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    """All entries with their messages."""
    return log_entries(table(spark, d, "outcomes"), "run_id", "stderr", "timestamp_utc")


def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    """The merged templates that begin entries, how many lines each has, and the parts of its places."""
    lines, templates = parsed_lines(table(spark, d, "outcomes"), "run_id", "stderr", "timestamp_utc")
    return lines.join(templates, "template").groupBy("merged", "roles").agg(F.count("*").alias("lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ice_parse, ice_compiler, unique_locations, campaign_progress, termination_histogram, abnormal_runs, report_totals, report_lines,
        debug_summary, debug_lines, file_locations, kept_ices, fragment_records, answer_match, synced_seeds,
        seed_filter, fp_filter, fragment_locate, fragment_locate_all, span_overlap_join, span_containment, kind_histogram, kind_previews,
        family_buckets, family_compat, family_with_parent, ingredient_join, plain_snippets, variant_matrix, dep_dictionary,
        dependency_prefixes, tolerant_json, slot_sampling, splice_mutants, multi_splice, node_kinds, annotate_kinds, edit_mutants, corpus_mutants, baseline_mutants, splice_draws, placeholder_fill, campaign_loop, comment_removal, prompt_build, hashed_files,
        crash_files, dropped_files, unseen_locations, iteration_log, stream_dedup, p5_found, p5_children, p6_found, p6_entries, p6_templates,
    )
}

_ONE = """
    WITH runs AS (SELECT run_id, any_value(file) AS file, any_value(variant_label) AS variant_label, any_value(termination) AS termination,
                         any_value(stderr) AS stderr FROM outcomes WHERE run_id IS NOT NULL GROUP BY run_id),
    files AS (SELECT file_id, any_value(file) AS file, any_value(campaign_id) AS campaign_id, any_value(iter) AS iter,
                     any_value(seed_file) AS seed_file, any_value(file_text) AS file_text FROM mutant_files WHERE file_id IS NOT NULL GROUP BY file_id),
    frags AS (SELECT fragment_id, any_value(rel) AS rel, any_value(node_kind) AS node_kind, any_value(dependencies) AS dependencies,
                     any_value(placeholders) AS placeholders FROM annotated_fragments WHERE fragment_id IS NOT NULL GROUP BY fragment_id),
    snips AS (SELECT snippet_id, any_value(filename) AS filename, any_value(kind) AS kind, any_value(fragment) AS fragment,
                     any_value(deps) AS deps, any_value(placeholders) AS placeholders FROM snippets WHERE snippet_id IS NOT NULL GROUP BY snippet_id),
    fam(kind, family, ord) AS (VALUES """ + fam.values_sql() + """),
    bucketed AS (SELECT kind, list(family ORDER BY ord) AS buckets FROM fam GROUP BY kind)
"""
_ICE = _ONE + r""",
    lines AS (SELECT run_id, unnest(string_split_regex(stderr, '\r?\n')) AS line, generate_subscripts(string_split_regex(stderr, '\r?\n'), 1) AS no FROM runs WHERE stderr IS NOT NULL),
    single AS (SELECT run_id, no, CASE
        WHEN regexp_matches(line, '^thread ''rustc''(?: \([0-9]+\))? panicked at .*?: .*$') THEN regexp_extract(line, '^thread ''rustc''(?: \([0-9]+\))? panicked at (.*?): (.*)$', ['location', 'reason'])
        WHEN regexp_matches(line, '^error: internal compiler error: .*?: .*$') THEN regexp_extract(line, '^error: internal compiler error: (.*?): (.*)$', ['location', 'reason'])
        WHEN regexp_matches(line, '^note: delayed at .*:\d+.*$') THEN regexp_extract(line, '^note: delayed at (.*:\d+)(.*)$', ['location', 'reason']) END AS ice FROM lines),
    heads AS (SELECT run_id, no, regexp_extract(line, '^thread ''rustc''(?: \([0-9]+\))? panicked at (.*?):$', 1) AS location,
                     trim(lead(line) OVER (PARTITION BY run_id ORDER BY no)) AS reason FROM lines),
    found AS (SELECT run_id, 0 AS pass, no, ice.location AS location, ice.reason AS reason FROM single WHERE ice IS NOT NULL
              UNION ALL SELECT run_id, 1, no, location, reason FROM heads WHERE location <> '' AND reason <> ''),
    ices AS (SELECT run_id, location, reason, min((pass, no)) AS place FROM found GROUP BY ALL),
    inside AS (SELECT run_id, substr(location, strpos(location, 'compiler')) AS location, reason, place FROM ices WHERE strpos(location, 'compiler') > 0)
"""
_ENDED = _ONE + """,
    hinted AS (SELECT run_id, file, termination.kind AS kind, termination.signal AS signal,
                      coalesce(regexp_matches(lower(stderr), 'memory allocation of|out of memory|alloc::oom|cannot allocate memory'), false) AS oom FROM runs),
    moved AS (SELECT run_id, file, oom, CASE WHEN kind = 'Signal' AND signal IN (6, 9) AND oom THEN 'MemoryExceeded' ELSE kind END AS kind, signal FROM hinted),
    ended AS (SELECT run_id, file, oom, kind, CASE WHEN kind = 'Signal' THEN signal END AS signal,
        CASE kind WHEN 'Signal' THEN CASE signal WHEN 1 THEN 'SIGHUP' WHEN 2 THEN 'SIGINT' WHEN 3 THEN 'SIGQUIT' WHEN 4 THEN 'SIGILL' WHEN 6 THEN 'SIGABRT'
                WHEN 8 THEN 'SIGFPE' WHEN 9 THEN 'SIGKILL' WHEN 11 THEN 'SIGSEGV' WHEN 13 THEN 'SIGPIPE' WHEN 14 THEN 'SIGALRM' WHEN 15 THEN 'SIGTERM'
                WHEN 24 THEN 'SIGXCPU' WHEN 25 THEN 'SIGXFSZ' ELSE 'SIG?' END || ' (' || signal || ')'
            WHEN 'Normal' THEN 'normal' WHEN 'WallTimeout' THEN 'WALL_TIMEOUT' WHEN 'MemoryExceeded' THEN 'MEMORY_EXCEEDED'
            WHEN 'SpawnFailed' THEN 'SPAWN_FAILED' ELSE 'UNKNOWN' END AS label,
        CASE kind WHEN 'WallTimeout' THEN 'compilation exceeded wall-clock timeout' WHEN 'MemoryExceeded' THEN 'RSS exceeded configured --memory limit'
            WHEN 'SpawnFailed' THEN 'could not start the compiler process'
            WHEN 'Signal' THEN CASE signal WHEN 24 THEN 'CPU time limit exceeded (RLIMIT_CPU)' WHEN 9 THEN 'killed — possibly OOM (RLIMIT_AS) or external kill'
                WHEN 6 THEN 'aborted — possibly OOM or assertion failure' WHEN 11 THEN 'segmentation fault' ELSE '' END ELSE '' END AS hint FROM moved)
"""
_WHITE = r"[\s,\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"
_LOCATE = _ONE + """,
    tight AS (SELECT file_id, seed_file, file_text, regexp_replace(file_text, '""" + _WHITE + """', '', 'g') AS h FROM files WHERE file_text IS NOT NULL),
    wanted AS (SELECT snippet_id, filename, deps, regexp_replace(fragment, '""" + _WHITE + """', '', 'g') AS w FROM snips WHERE fragment IS NOT NULL),
    hits AS MATERIALIZED (SELECT file_id, snippet_id, deps, file_text, strpos(h, w) AS spot, length(w) AS n FROM tight JOIN wanted ON seed_file = filename WHERE w <> '' AND contains(h, w)),
    texts AS MATERIALIZED (SELECT file_id, any_value(list_filter(range(1, length(file_text) + 1), lambda i: NOT regexp_matches(file_text[i], '""" + _WHITE + """'))) AS kept FROM hits GROUP BY file_id),
    located AS MATERIALIZED (SELECT file_id, snippet_id, deps, strlen(file_text[1:kept[spot] - 1]) AS s, strlen(file_text[1:kept[spot + n - 1]]) AS e FROM hits JOIN texts USING (file_id)),
    split AS (SELECT file_id, unnest(string_split(file_text, chr(10))) AS line, generate_subscripts(string_split(file_text, chr(10)), 1) - 1 AS no FROM files WHERE file_text IS NOT NULL),
    spots AS (SELECT file_id, no, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, strlen(line) AS n FROM split),
    rows_ AS (SELECT file_id, no, s, s + n AS e FROM spots)
"""
_PLACES = _LOCATE + """,
    pieces AS (SELECT file_id, snippet_id, deps, file_text, n, string_split(h, w) AS xs FROM (SELECT h.*, t.h, x.w FROM hits h JOIN tight t USING (file_id) JOIN wanted x USING (snippet_id))),
    every AS (SELECT file_id, snippet_id, deps, file_text, n, k - 1 AS match_no, list_sum(list_transform(xs[1:k], lambda x: length(x)))::BIGINT + (k - 1) * n + 1 AS spot
              FROM (SELECT *, unnest(range(1, least(len(xs), 10))) AS k FROM pieces)),
    places AS MATERIALIZED (SELECT file_id, snippet_id, deps, match_no, strlen(file_text[1:kept[spot] - 1]) AS s2, strlen(file_text[1:kept[spot + n - 1]]) AS e2 FROM every JOIN texts USING (file_id))
"""
_PICK = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_SLOTS = _LOCATE + """,
    ranked AS (SELECT file_id, no, s, e, row_number() OVER (PARTITION BY file_id ORDER BY """ + _PICK.format("file_id || '|' || no") + """, no) - 1 AS n,
                      """ + _PICK.format("file_id || '|times'") + """ % 7 AS draw FROM rows_ WHERE s < e),
    slots AS (SELECT file_id, n, no, s, e FROM ranked WHERE n < CASE WHEN draw < 3 THEN 1 WHEN draw < 6 THEN 2 ELSE 3 END)
"""
_FALSE = " AND ".join(f"NOT contains(text, '{w}')" for w in tx.FALSE_POSITIVES)
_BUCKETS = "CASE WHEN s.kind IS NULL THEN [''] ELSE coalesce(b.buckets, [s.kind]) END"

_ANSWERS = r"""
    WITH one AS (SELECT output_id, any_value(body) AS b FROM llm_outputs WHERE output_id IS NOT NULL AND body IS NOT NULL GROUP BY output_id),
    bare AS (SELECT output_id, trim(regexp_replace(regexp_replace(b, '^\s*```[A-Za-z0-9_-]*', ''), '```\s*$', ''), chr(65279) || chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM one),
    whole AS (SELECT output_id, t::JSON AS j FROM bare WHERE t <> '' AND json_valid(t)),
    member AS (SELECT output_id, lower(regexp_replace(k, '[-_ ]', '', 'g')) AS name, json_extract(j, '$."' || k || '"') AS v
               FROM (SELECT output_id, j, unnest(json_keys(j)) AS k FROM whole WHERE json_type(j) = 'OBJECT')),
    inner_member AS (SELECT output_id, lower(regexp_replace(k, '[-_ ]', '', 'g')) AS name, json_extract(v, '$."' || k || '"') AS v
               FROM (SELECT output_id, v, unnest(json_keys(v)) AS k FROM member WHERE json_type(v) = 'OBJECT'
                     AND output_id NOT IN (SELECT output_id FROM member WHERE name IN ('introstructures', 'fragments')))),
    listed AS (SELECT output_id, name, CASE json_type(v) WHEN 'ARRAY' THEN v ELSE json_array(v) END AS v
               FROM (FROM member UNION ALL FROM inner_member) WHERE name IN ('introstructures', 'fragments') AND json_type(v) <> 'NULL'),
    item AS (SELECT output_id, name, n, json_extract(v, n) AS x FROM (SELECT output_id, name, v, unnest(range(json_array_length(v)::BIGINT)) AS n FROM listed)),
    kept AS (SELECT * FROM item WHERE json_type(x) <> 'NULL'),
    part AS (SELECT output_id, n AS frag_no, lower(regexp_replace(k, '[-_ ]', '', 'g')) AS name, json_extract(x, '$."' || k || '"') AS v
             FROM (SELECT output_id, n, x, unnest(json_keys(x)) AS k FROM kept WHERE name = 'fragments' AND json_type(x) = 'OBJECT')),
    parts AS (SELECT output_id, frag_no, name, CASE json_type(v) WHEN 'ARRAY' THEN v ELSE json_array(v) END AS v
              FROM part WHERE name IN ('dependencies', 'placeholders') AND json_type(v) <> 'NULL'),
    nested AS (SELECT output_id, frag_no, name, n, json_extract(v, n) AS x FROM (SELECT output_id, frag_no, name, v, unnest(range(json_array_length(v)::BIGINT)) AS n FROM parts))
"""

SQL: dict[str, str] = {
    "ice_parse": _ICE + "SELECT run_id, location, reason FROM ices",
    "ice_compiler": _ICE + "SELECT DISTINCT run_id, location, reason FROM inside",
    "unique_locations": _ICE + """SELECT location, run_id, reason FROM inside
        QUALIFY row_number() OVER (PARTITION BY location ORDER BY run_id, place) = 1""",
    "campaign_progress": _ICE + """, sited AS (SELECT file, campaign_id, iter FROM files WHERE campaign_id IS NOT NULL AND iter IS NOT NULL),
        every AS (SELECT campaign_id, iter, count(*) AS runs FROM runs JOIN sited USING (file) GROUP BY ALL),
        hit AS (SELECT campaign_id, iter, file, location FROM inside JOIN runs USING (run_id) JOIN sited USING (file)),
        new AS (SELECT campaign_id, iter, count(*) AS n FROM (SELECT campaign_id, location, min(iter) AS iter FROM hit GROUP BY ALL) GROUP BY ALL),
        crashed AS (SELECT campaign_id, iter, count(DISTINCT file) AS n FROM hit GROUP BY ALL)
        SELECT e.campaign_id, e.iter, e.runs, coalesce(c.n, 0) AS ice_files, coalesce(new.n, 0) AS new_locations,
               sum(coalesce(new.n, 0)) OVER (PARTITION BY e.campaign_id ORDER BY e.iter ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative
        FROM every e LEFT JOIN crashed c USING (campaign_id, iter) LEFT JOIN new USING (campaign_id, iter)""",
    "termination_histogram": _ENDED + "SELECT kind, signal, label, count(*) AS runs, count(*) FILTER (oom) AS oom_hints FROM ended GROUP BY ALL",
    "abnormal_runs": _ENDED + "SELECT run_id, file, label, hint FROM ended WHERE kind <> 'Normal'",
    "report_totals": _ICE + """, per AS (SELECT r.run_id, r.variant_label, r.file, (SELECT count(*) FROM inside i WHERE i.run_id = r.run_id) AS n FROM runs r),
        places AS (SELECT variant_label, count(DISTINCT location) AS n FROM inside JOIN runs USING (run_id) GROUP BY ALL)
        SELECT p.variant_label, count(*) AS runs, count(DISTINCT p.file) AS files, count(*) FILTER (p.n > 0) AS ice_runs, sum(p.n)::BIGINT AS ices,
               any_value(coalesce(places.n, 0)) AS unique_locations FROM per p LEFT JOIN places USING (variant_label) WHERE p.variant_label IS NOT NULL GROUP BY p.variant_label""",
    "report_lines": _ICE + """SELECT run_id, 'ICE ' || coalesce(any_value(file), '?') || ' [' || coalesce(any_value(variant_label), '?') || '] ' ||
        string_agg(DISTINCT location, '; ' ORDER BY location) AS line FROM inside JOIN runs USING (run_id) GROUP BY run_id""",
    "debug_summary": _ENDED + """, e AS (SELECT r.variant_label, ended.* FROM ended JOIN runs r USING (run_id) WHERE r.variant_label IS NOT NULL),
        sig AS (SELECT variant_label, string_agg('    ' || label || ': ' || n || chr(10), '' ORDER BY signal) AS lines FROM
                (SELECT variant_label, signal, label, count(*) AS n FROM e WHERE kind = 'Signal' GROUP BY ALL) GROUP BY variant_label),
        c AS (SELECT variant_label, count(*) AS total, count(*) FILTER (kind = 'Normal') AS normal, count(*) FILTER (kind = 'WallTimeout') AS wall, count(*) FILTER (kind = 'MemoryExceeded') AS memory,
                     count(*) FILTER (kind = 'Signal') AS signals, count(*) FILTER (kind = 'SpawnFailed') AS spawn, count(*) FILTER (kind = 'Unknown') AS unknown, count(*) FILTER (oom) AS oom FROM e GROUP BY variant_label)
        SELECT c.variant_label, '  Total runs:         ' || total || chr(10) || '  Completed normally: ' || normal || chr(10) || '  Wall-clock timeout: ' || wall || chr(10) ||
            '  Memory exceeded:    ' || memory || chr(10) || '  Killed by signal:   ' || signals || chr(10) || coalesce(sig.lines, '') ||
            CASE WHEN spawn > 0 THEN '  Spawn failed:       ' || spawn || chr(10) ELSE '' END || CASE WHEN unknown > 0 THEN '  Unknown:            ' || unknown || chr(10) ELSE '' END ||
            CASE WHEN oom > 0 THEN '  Stderr hints OOM:   ' || oom || chr(10) ELSE '' END AS summary FROM c LEFT JOIN sig USING (variant_label)""",
    "debug_lines": _ICE + _ENDED.removeprefix(_ONE) + """, rss AS (SELECT run_id, any_value(peak_rss_mb) AS mb FROM outcomes GROUP BY run_id)
        SELECT run_id, coalesce(e.file, '?') || ' [' || coalesce(r.variant_label, '?') || '] [' || label || ']' || CASE WHEN hint <> '' THEN ' — ' || hint ELSE '' END ||
            CASE WHEN mb IS NOT NULL THEN ' peak_rss=' || mb || 'MB' ELSE '' END || CASE WHEN run_id IN (SELECT run_id FROM inside) THEN ' ICE' ELSE '' END ||
            CASE WHEN oom THEN ' (stderr suggests OOM)' ELSE '' END AS line FROM ended e JOIN runs r USING (run_id) LEFT JOIN rss USING (run_id) WHERE kind <> 'Normal'""",
    "file_locations": _ICE + """, f AS (SELECT DISTINCT file, location FROM inside JOIN runs USING (run_id) WHERE file IS NOT NULL)
        SELECT file, count(*) AS n, string_agg(location, '; ' ORDER BY encode(location)) AS locations FROM f GROUP BY file""",
    "kept_ices": _ICE + """, hit AS (SELECT DISTINCT campaign_id, iter, file, location FROM inside JOIN runs USING (run_id) JOIN files USING (file) WHERE campaign_id IS NOT NULL AND iter IS NOT NULL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, location ORDER BY iter, encode(file)) = 1 AS first FROM hit)
        SELECT campaign_id, 'iter' || iter || '_' || regexp_replace(file, '.*/', '') AS name, file, count(*) AS locations, count(*) FILTER (first) AS new_locations FROM ranked GROUP BY campaign_id, iter, file""",
    "fragment_records": _ONE + "SELECT fragment, kind AS node_kind FROM (SELECT DISTINCT filename, kind, fragment FROM snips WHERE fragment IS NOT NULL AND kind IS NOT NULL)",
    "answer_match": _ONE + r""", o AS (SELECT output_id, any_value(rel) AS rel, any_value(regexp_replace(body, '\A\s*```[a-z]*\s*|\s*```\s*\z', '', 'gs')) AS body FROM llm_outputs WHERE output_id IS NOT NULL GROUP BY output_id)
        SELECT CASE WHEN NOT coalesce(json_valid(body), false) THEN 'unreadable' WHEN rel IN (SELECT seed_file FROM files WHERE seed_file IS NOT NULL) THEN 'matched' ELSE 'no source' END AS status, count(*) AS answers FROM o GROUP BY 1""",
    "synced_seeds": _ONE + """, n AS (SELECT rel, count(*) AS n FROM frags GROUP BY rel), j AS (SELECT seed_file, coalesce(n, 0) AS n FROM (SELECT DISTINCT seed_file FROM files WHERE seed_file IS NOT NULL) LEFT JOIN n ON seed_file = rel)
        SELECT count(*) AS seeds, count(*) FILTER (n > 0) AS with_fragments, coalesce(sum(n), 0)::BIGINT AS fragments FROM j""",
    "seed_filter": _ONE + """, cut AS (SELECT file_id, file, file_text, string_split_regex(regexp_replace(file_text, '\\r?\\n\\z', ''), '\\r?\\n') AS each FROM files WHERE file_text IS NOT NULL)
        SELECT file_id FROM cut WHERE len(each) <= 400 AND len(list_filter(each, lambda x: length(x) > 1000)) = 0
        AND NOT (contains(file_text, 'no_core') OR contains(file_text, 'lang_items') OR contains(file_text, 'mir!(') OR contains(file_text, 'break rust')
                 OR (contains(file_text, 'failure-status: 101') AND contains(file_text, 'known-bug')))
        AND NOT (""" + " OR ".join(f"contains(file, '{e}')" for e in tx.SEED_PATHS) + ")",
    "fp_filter": _ONE + ", t AS (SELECT file_id, file_text AS text FROM files WHERE file_text IS NOT NULL) SELECT file_id FROM t WHERE " + _FALSE,
    "fragment_locate": _LOCATE + "SELECT file_id, snippet_id, s, e FROM located",
    "span_containment": _LOCATE + """, nodes AS (SELECT file_id, s, e, 'line' AS kind, 1 AS depth FROM rows_
            UNION ALL SELECT file_id, 0, strlen(file_text), 'source_file', 0 FROM files WHERE file_text IS NOT NULL)
        SELECT l.file_id, l.snippet_id, n.kind, n.s, n.e FROM located l JOIN nodes n ON l.file_id = n.file_id AND n.s <= l.s AND l.e <= n.e
        QUALIFY row_number() OVER (PARTITION BY l.file_id, l.snippet_id ORDER BY n.depth DESC, n.s, n.e DESC) = 1""",
    "kind_histogram": _ONE + "SELECT kind, count(*) AS snippets, count(DISTINCT fragment) AS texts, greatest(count(*) - 1, 0) AS possible FROM snips WHERE kind IS NOT NULL GROUP BY kind",
    "kind_previews": _ONE + """, t AS (SELECT DISTINCT kind, fragment FROM snips WHERE kind IS NOT NULL AND fragment IS NOT NULL),
        r AS (SELECT kind, fragment, row_number() OVER (PARTITION BY kind ORDER BY encode(fragment)) - 1 AS rank FROM t)
        SELECT kind, rank, replace(CASE WHEN length(fragment) > 80 THEN fragment[1:80] || '...' ELSE fragment END, chr(10), '\\n') AS preview FROM r WHERE rank < 3""",
    "family_buckets": _ONE + "SELECT bucket, count(*) AS snippets FROM (SELECT unnest(" + _BUCKETS + ") AS bucket FROM snips s LEFT JOIN bucketed b ON s.kind = b.kind) GROUP BY bucket",
    "family_compat": _ONE + """, a AS (SELECT DISTINCT f.node_kind AS kind, coalesce(b.buckets, [f.node_kind]) AS x FROM frags f LEFT JOIN bucketed b ON f.node_kind = b.kind WHERE f.node_kind IS NOT NULL),
        o AS (SELECT DISTINCT s.kind AS other, coalesce(b.buckets, [s.kind]) AS y FROM snips s LEFT JOIN bucketed b ON s.kind = b.kind WHERE s.kind IS NOT NULL)
        SELECT kind, other FROM a, o WHERE list_has_any(x, y)""",
    "family_with_parent": _ONE + """, each AS (SELECT node_kind AS parent, unnest(list_transform(placeholders, lambda p: p.node_kind)) AS kind FROM frags),
        known AS (SELECT coalesce(a.buckets, []) AS a, coalesce(b.buckets, []) AS b FROM each LEFT JOIN bucketed a ON each.kind = a.kind LEFT JOIN bucketed b ON each.parent = b.kind)
        SELECT array_to_string(CASE WHEN len(a) = 1 THEN a WHEN len(a) > 0 AND len(b) > 0 THEN list_filter(a, lambda x: list_contains(b, x)) WHEN len(a) > 0 THEN a ELSE b END, ',') AS families,
               count(*) AS placeholders FROM known GROUP BY 1""",
    "ingredient_join": _ONE + """, n AS (SELECT rel, count(*) AS n FROM frags GROUP BY rel)
        SELECT seed_file, regexp_replace(seed_file, '\\.[^./]*$', '') || '.json' AS json_name, coalesce(n, 0) AS fragments
        FROM (SELECT DISTINCT seed_file FROM files WHERE seed_file IS NOT NULL) LEFT JOIN n ON seed_file = rel""",
    "plain_snippets": _ONE + """, p AS (SELECT *, coalesce(len(deps), 0) = 0 AND coalesce(len(placeholders), 0) = 0 AS plain FROM snips),
        u AS (SELECT filename, kind, fragment FROM p WHERE plain GROUP BY ALL UNION ALL SELECT filename, kind, fragment FROM p WHERE NOT plain)
        SELECT filename, count(*) AS snippets FROM u GROUP BY filename""",
    "variant_matrix": _ONE + """SELECT file_id, label, 'prlimit --as=1073741824 --cpu=10 rustc ' || flags ||
        CASE WHEN contains(coalesce(file_text, ''), 'fn main') THEN '' ELSE '--crate-type=lib ' END || file AS command
        FROM files, (VALUES ('emit-mir', '--emit=mir '), ('opt', '-Copt-level=3 '), ('plain', '')) v(label, flags)""",
    "dep_dictionary": _ONE + """, each AS (SELECT fragment_id, unnest(dependencies) AS dep, generate_subscripts(dependencies, 1) AS pos FROM frags),
        firsts AS (SELECT dep, min((fragment_id, pos)) AS first FROM each WHERE dep IS NOT NULL GROUP BY dep)
        SELECT row_number() OVER (ORDER BY first) - 1 AS dep_id, dep FROM firsts""",
    "dependency_prefixes": _ONE + """SELECT fragment_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(coalesce(dependencies, []), lambda x: encode(x)))),
            lambda x: decode(x) || CASE WHEN ends_with(decode(x), chr(10)) THEN '' ELSE chr(10) END), '') AS prefix,
            chr(10) || chr(10) || '// ' || rel || chr(10) || '// deps' || chr(10) AS trailer FROM frags WHERE rel IS NOT NULL""",
    "tolerant_json": r"""WITH o AS (SELECT output_id, any_value(body) AS body FROM llm_outputs WHERE output_id IS NOT NULL AND body IS NOT NULL GROUP BY output_id)
        SELECT output_id, CASE WHEN json_valid(body) THEN 'plain' WHEN json_valid(regexp_replace(body, '\A\s*```[a-z]*\s*|\s*```\s*\z', '', 'gs')) THEN 'fenced' ELSE 'error' END AS status FROM o""",
    "slot_sampling": _SLOTS + "SELECT file_id, n, no, s, e FROM slots",
    "splice_mutants": _SLOTS + """, pool AS (SELECT snippet_id, fragment, row_number() OVER (ORDER BY snippet_id) - 1 AS place
            FROM snips s JOIN fam USING (kind) WHERE fragment IS NOT NULL AND family = 'Expr'),
        drawn AS (SELECT file_id, s, e, """ + _PICK.format("file_id || '|snippet'") + """ % (SELECT count(*) FROM pool) AS place FROM slots WHERE n = 0),
        made AS (SELECT d.file_id, p.snippet_id, decode(encode(file_text)[1:d.s] || encode(p.fragment) || encode(file_text)[d.e + 1:]) AS text
                 FROM drawn d JOIN pool p USING (place) JOIN files USING (file_id))
        SELECT file_id, snippet_id, sha256(text) AS id FROM made WHERE """ + _FALSE,
    "campaign_loop": _ICE + """SELECT location, min(CASE WHEN variant_label = 'emit-mir' THEN 0 ELSE 1 END)::BIGINT AS first_iter
        FROM inside JOIN runs USING (run_id) GROUP BY location""",
    "comment_removal": _ONE + r"SELECT file_id, regexp_replace(file_text, '//[^\n]*|/\*(?s:.*?)(\*/|\z)', '', 'g') AS code FROM files WHERE file_text IS NOT NULL",
    "prompt_build": _ONE + "SELECT file_id, '" + FRONT + "' || file_text || chr(10) || '" + END + "' AS prompt FROM files WHERE file_text IS NOT NULL AND NOT regexp_matches(file_text, '^" + _WHITE.replace(",", "") + "*$')",
    "hashed_files": _ONE + "SELECT sha256(file_text) AS id, any_value(strlen(file_text)) AS bytes FROM files WHERE file_text IS NOT NULL GROUP BY 1",
    "crash_files": _ICE + "SELECT file_id, file FROM files WHERE file IN (SELECT file FROM inside JOIN runs USING (run_id))",
    "dropped_files": _ICE + "SELECT file_id, file FROM files WHERE file IN (SELECT file FROM runs) AND file NOT IN (SELECT file FROM inside JOIN runs USING (run_id) WHERE file IS NOT NULL)",
    "unseen_locations": """SELECT DISTINCT campaign_id, location FROM (SELECT campaign_id, unnest(new_locations) AS location FROM iterations) i
        WHERE campaign_id IS NOT NULL AND location IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.campaign_id = i.campaign_id AND s.location = i.location)""",
    "iteration_log": """WITH one AS (SELECT campaign_id, iter, any_value(mutants) AS mutants, any_value(ice_files) AS ice_files, any_value(cumulative) AS cumulative, any_value(new_locations) AS places
            FROM iterations WHERE campaign_id IS NOT NULL AND iter IS NOT NULL GROUP BY ALL)
        SELECT campaign_id, iter, CASE WHEN mutants IS NULL THEN '[' || iter || '] SKIPPED (mutator failure)' || chr(10)
            ELSE '[' || iter || '] mutants=' || mutants || ' ices=' || coalesce(ice_files, 0) || ' cumulative_locations=' || coalesce(cumulative, 0) || chr(10) ||
                 coalesce(array_to_string(list_transform(list_filter(places, lambda x: x IS NOT NULL), lambda x: 'NEW_LOCATION: ' || x || chr(10)), ''), '') END AS block FROM one""",
    "stream_dedup": "SELECT DISTINCT campaign_id, location FROM (SELECT campaign_id, unnest(new_locations) AS location FROM iterations) WHERE location IS NOT NULL",
    "p5_found": _ANSWERS + r"""
    SELECT output_id, CASE name WHEN 'fragments' THEN 'fragment' ELSE 'intro' END AS child, CASE name WHEN 'fragments' THEN n ELSE -1 END AS frag_no,
           CASE name WHEN 'fragments' THEN -1 ELSE n END AS item_no FROM kept
    UNION ALL
    SELECT output_id, CASE name WHEN 'dependencies' THEN 'dependency' ELSE 'placeholder' END, frag_no, n FROM nested WHERE json_type(x) <> 'NULL'""",
    "p5_children": _ANSWERS + r"""
    SELECT output_id, CASE name WHEN 'fragments' THEN 'fragment' ELSE 'intro' END AS child, CASE name WHEN 'fragments' THEN n ELSE -1 END AS frag_no, CASE name WHEN 'fragments' THEN -1 ELSE n END AS item_no,
           CASE WHEN json_type(x) <> 'OBJECT' THEN x ->> '$' WHEN name = 'fragments' THEN x ->> '$.fragment' END AS text,
           CASE WHEN name = 'fragments' AND json_type(x) = 'OBJECT' THEN (SELECT any_value(v ->> '$') FROM part p WHERE p.output_id = kept.output_id AND p.frag_no = kept.n AND p.name = 'nodekind') END AS node_kind FROM kept
    UNION ALL
    SELECT output_id, CASE name WHEN 'dependencies' THEN 'dependency' ELSE 'placeholder' END, frag_no, n,
           CASE WHEN json_type(x) <> 'OBJECT' THEN x ->> '$' WHEN name = 'dependencies' THEN x ->> '$.dependency' ELSE x ->> '$.placeholder' END,
           CASE WHEN name = 'placeholders' AND json_type(x) = 'OBJECT' THEN coalesce(x ->> '$.node_kind', x ->> '$."node-kind"', x ->> '$.nodeKind') END FROM nested WHERE json_type(x) <> 'NULL'""",
    "fragment_locate_all": _PLACES + "SELECT file_id, snippet_id, s2 AS s, e2 AS e, match_no FROM places",
    "span_overlap_join": _PLACES + """, met AS (SELECT DISTINCT file_id, no, snippet_id, deps FROM rows_ JOIN places USING (file_id) WHERE s < e AND s < e2 AND s2 < e),
        named AS (SELECT DISTINCT file_id, no, unnest(deps) AS dep FROM met),
        d AS (SELECT file_id, no, count(dep) AS n FROM named GROUP BY ALL)
        SELECT m.file_id, m.no, count(DISTINCT snippet_id) AS fragments, coalesce(any_value(d.n), 0) AS dependencies FROM met m LEFT JOIN d USING (file_id, no) GROUP BY m.file_id, m.no""",
    "multi_splice": _SLOTS + """SELECT file_id, string_agg(CASE WHEN slots.no IS NULL THEN line ELSE '()' END, chr(10) ORDER BY split.no) AS text
        FROM split LEFT JOIN slots USING (file_id, no) WHERE file_id IN (SELECT file_id FROM slots) GROUP BY file_id""",
    "p6_found": r"""
    WITH o AS (SELECT run_id, any_value(stderr) AS t, year(any_value(timestamp_utc)) AS y FROM outcomes WHERE run_id IS NOT NULL AND stderr <> '' GROUP BY run_id),
    l AS (SELECT run_id, y, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM o),
    c AS (SELECT run_id, y, line_no, regexp_replace(raw, '\r$', '') AS x FROM l),
    h AS (SELECT *, coalesce(regexp_matches(lag(x) OVER (PARTITION BY run_id ORDER BY line_no), '^\S.*:\d+:$'), false) AS told FROM c),
    x AS (SELECT * FROM h WHERE regexp_matches(x, '^\S') AND NOT regexp_matches(x, '^\d+ *\|') AND NOT told),
    f AS (SELECT run_id, line_no, y, x, CASE
        WHEN regexp_matches(x, '^thread ''.*?''(?: \(\d+\))? panicked at .*?:(\s|$)') THEN ['panic', regexp_extract(x, ' panicked at (.*?):(?:\s|$)', 1), '']
        WHEN regexp_matches(x, '^error: internal compiler error: .*?:(\s|$)') THEN ['error', regexp_extract(x, '^error: internal compiler error: (.*?):(?:\s|$)', 1), '']
        WHEN regexp_matches(x, '^note: delayed at \S*:\d+') THEN ['note', regexp_extract(x, '^note: delayed at (\S*:\d+)', 1), '']
        WHEN regexp_matches(x, '^memory allocation of \d+ bytes failed') THEN ['error', 'rustc', '']
        WHEN regexp_matches(x, '^\{"timestamp": ') THEN [regexp_extract(x, '"level": "(\w+)"', 1), regexp_extract(x, '"target": "([^"]+)"', 1), regexp_extract(x, '"timestamp": "([^"]+)"', 1)]
        WHEN regexp_matches(x, '^ts=') THEN [regexp_extract(x, ' level=(\w+)', 1), regexp_extract(x, ' target=(\S+)', 1), regexp_extract(x, '^ts=(\S+)', 1)]
        WHEN regexp_matches(x, '^\[[\d-]+ [\d:.,]+\] \[[\w.-]+\] \[\w+\]') THEN [regexp_extract(x, '^\[([\d-]+ [\d:.,]+)\] \[([\w.-]+)\] \[(\w+)\]', 3), regexp_extract(x, '^\[([\d-]+ [\d:.,]+)\] \[([\w.-]+)\] \[(\w+)\]', 2), regexp_extract(x, '^\[([\d-]+ [\d:.,]+)\] \[([\w.-]+)\] \[(\w+)\]', 1)]
        WHEN regexp_matches(x, '^\[[\dT:.+Z-]+\s+\w+\s+[\w:]+\]') THEN [regexp_extract(x, '^\[([\dT:.+Z-]+)\s+(\w+)\s+([\w:]+)\]', 2), regexp_extract(x, '^\[([\dT:.+Z-]+)\s+(\w+)\s+([\w:]+)\]', 3), regexp_extract(x, '^\[([\dT:.+Z-]+)\s+(\w+)\s+([\w:]+)\]', 1)]
        WHEN regexp_matches(x, '^\d{4}-[\dT:.+Z-]+\s+\w+\s+\w+(::\w+)+:') THEN [regexp_extract(x, '^(\d{4}-[\dT:.+Z-]+)\s+(\w+)\s+(\w+(?:::\w+)+):', 2), regexp_extract(x, '^(\d{4}-[\dT:.+Z-]+)\s+(\w+)\s+(\w+(?:::\w+)+):', 3), regexp_extract(x, '^(\d{4}-[\dT:.+Z-]+)\s+(\w+)\s+(\w+(?:::\w+)+):', 1)]
        WHEN regexp_matches(x, '^\d{4}-\d\d-\d\d [\d:.,+-]+ \[\w+\] \S+ - ') THEN [regexp_extract(x, '^(\d{4}-\d\d-\d\d [\d:.,+-]+) \[(\w+)\] (\S+) - ', 2), regexp_extract(x, '^(\d{4}-\d\d-\d\d [\d:.,+-]+) \[(\w+)\] (\S+) - ', 3), regexp_extract(x, '^(\d{4}-\d\d-\d\d [\d:.,+-]+) \[(\w+)\] (\S+) - ', 1)]
        WHEN regexp_matches(x, '^(\d{13}|\d{10}) \w \w+(::\w+)+:') THEN [regexp_extract(x, '^(\d{13}|\d{10}) (\w) (\w+(?:::\w+)+):', 2), regexp_extract(x, '^(\d{13}|\d{10}) (\w) (\w+(?:::\w+)+):', 3), regexp_extract(x, '^(\d{13}|\d{10}) (\w) (\w+(?:::\w+)+):', 1)]
        WHEN regexp_matches(x, '^[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d \S+ [\w.-]+\[\d+\]: \w+:') THEN [regexp_extract(x, '^([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) \S+ ([\w.-]+)\[\d+\]: (\w+):', 3), regexp_extract(x, '^([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) \S+ ([\w.-]+)\[\d+\]: (\w+):', 2), regexp_extract(x, '^([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) \S+ ([\w.-]+)\[\d+\]: (\w+):', 1)]
        WHEN regexp_matches(x, '^[A-Z]\d{4} \d\d:\d\d:\d\d\S* +\d+ [\w.-]+:\d+\]') THEN [regexp_extract(x, '^([A-Z])(\d{4} \d\d:\d\d:\d\d)\S* +\d+ ([\w.-]+):\d+\]', 1), regexp_extract(x, '^([A-Z])(\d{4} \d\d:\d\d:\d\d)\S* +\d+ ([\w.-]+):\d+\]', 3), regexp_extract(x, '^([A-Z])(\d{4} \d\d:\d\d:\d\d)\S* +\d+ ([\w.-]+):\d+\]', 2)]
        WHEN regexp_matches(x, '^[A-Z]+ \w+(::\w+)+ ') THEN [regexp_extract(x, '^([A-Z]+) ', 1), regexp_extract(x, '^[A-Z]+ (\w+(?:::\w+)+) ', 1), '']
        WHEN regexp_matches(x, '^LLVM ERROR: ') THEN ['error', 'LLVM', '']
        WHEN regexp_matches(x, '^\w+(\[\w+\])?: ') THEN [regexp_extract(x, '^(\w+)', 1), 'rustc', ''] END AS v FROM x),
    m(word, level) AS (VALUES ('panic', 'panic'), ('error', 'error'), ('err', 'error'), ('e', 'error'), ('fatal', 'error'), ('f', 'error'), ('warn', 'warn'), ('warning', 'warn'), ('w', 'warn'),
        ('note', 'note'), ('n', 'note'), ('info', 'info'), ('i', 'info'), ('debug', 'debug'), ('dbg', 'debug'), ('d', 'debug'), ('trace', 'trace'), ('trc', 'trace'), ('t', 'trace')),
    p AS (SELECT run_id, line_no, level, v[2] AS component, y, regexp_replace(v[3], '[.,]\d+', '') AS at_ FROM f JOIN m ON lower(v[1]) = word WHERE v[2] <> '')
    SELECT run_id, line_no, level, component, coalesce(strftime(CASE
        WHEN regexp_matches(at_, '^\d{13}$') THEN make_timestamp(at_::BIGINT // 1000 * 1000000)
        WHEN regexp_matches(at_, '^\d{10}$') THEN make_timestamp(at_::BIGINT * 1000000)
        WHEN regexp_matches(at_, '^\d{4} ') THEN try_strptime(y || at_, '%Y%m%d %H:%M:%S')
        WHEN regexp_matches(at_, '^[A-Z][a-z]') THEN try_strptime(y || ' ' || regexp_replace(at_, ' +', ' ', 'g'), '%Y %b %d %H:%M:%S')
        WHEN at_ <> '' THEN try_cast(replace(at_[1:19], 'T', ' ') AS TIMESTAMP)
            - CASE WHEN regexp_matches(at_, '[+-]\d\d:?\d\d$') THEN to_minutes((regexp_extract(at_, '([+-])\d\d:?\d\d$', 1) || '1')::BIGINT * (regexp_extract(at_, '(\d\d):?\d\d$', 1)::BIGINT * 60 + regexp_extract(at_, '(\d\d)$', 1)::BIGINT)) ELSE to_minutes(0) END
        END, '%Y-%m-%d %H:%M:%S'), '') AS logged_at FROM p""",
}
