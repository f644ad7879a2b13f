"""Mutants by splicing: slots of a source take snippets of a family that fits, with their placeholders filled from the
source and their dependencies put in front.

Every draw is by a number that a hash gives: snippets are numbered within (domain, bucket) and joined, so no list of them is
gathered, and a bucket that holds most snippets is spread like any other. The nodes of one text are an array beside it.

Tables of texts are never broadcast: their files are a fraction of what the texts take in memory, and it is the files that
Spark goes by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraglight.functions.families import buckets_of
from fraglight.functions.text import dependency_prefix, splice
from fraglight.operators.mutate import Config, attribute_mutants, branch, filled, identified, type_mutants, value_mutants
from fraglight.operators.ranking import indexed, pick
from fraglight.sources.tables import discard, staged

#: Slots that a mutant has at most, unless the config names passes.
SLOTS = 3
#: Draws by number for each slot of an attempt.
DRAWS = 6
#: Bits of a number that hold a node of one text.
NODE_BITS = 28
_SPAN = "struct<node_id:bigint,s:bigint,e:bigint,kind:string>"


def below(percent: int, *key: Column) -> Column:
    """True for that share of keys."""
    return F.pmod(pick(*key), F.lit(100)) < percent


def attempts(files: DataFrame, key: str, config: Config) -> DataFrame:
    """(key, attempt, way): so many attempts at each source, and the way that each goes."""
    each = files.select(key, F.explode(F.sequence(F.lit(0), F.lit(config.per_seed - 1))).alias("k"))
    named = each.select(key, F.concat_ws("#", F.col(key).cast("string"), "k").alias("attempt"))
    return named.withColumn("way", branch(config, F.col("attempt")))


def drawn_slots(nodes: DataFrame, tries: DataFrame, key: str, config: Config = Config()) -> DataFrame:
    """(attempt, key, n, s, e, kind): one slot (3 of 7 attempts), two (3 of 7) or three of each, or one of the config's passes, each
    as often; no two of an attempt overlap. Nodes are numbered in their source and drawn by number; a draw that overlaps an earlier
    one is passed over. Attempts for which so many draws don't do go on by the least hash of the nodes that are left. Attempts at
    sources without nodes have no slot, and there are fewer slots where nothing is left."""
    span = F.struct(F.col("node_id").cast("bigint").alias("node_id"), "s", "e", "kind")
    own = nodes.filter("s < e").groupBy(key).agg(F.sort_array(F.collect_list(span)).alias("own"))  # those of one text
    draw = F.pmod(pick(F.col("attempt"), F.lit("times")), F.lit(len(config.passes) or 7))
    times = F.get(F.array(*map(F.lit, config.passes)), draw.cast("int")) if config.passes else F.when(draw < 3, 1).when(draw < 6, 2).otherwise(SLOTS)
    most = max(config.passes, default=SLOTS)
    asked = tries.select(key, "attempt", times.alias("times")).join(own.hint("merge"), key)
    clash = lambda taken, m: F.exists(taken, lambda t: (t.s < m.e) & (m.s < t.e))
    full = lambda taken: F.size(taken) >= F.col("times")
    step = lambda taken, m: F.when(full(taken) | clash(taken, m), taken).otherwise(F.array_append(taken, m))
    node = lambda k: F.get("own", F.pmod(pick(F.col("attempt"), k.cast("string"), F.lit("slot")), F.size("own")).cast("int"))
    # a number is hashed only while slots are open; the array of one node keeps it from being hashed again for each span
    drawn = lambda taken, k: F.when(full(taken), taken).otherwise(F.aggregate(F.array(node(k)), taken, step))
    state = asked.withColumn("taken", F.aggregate(F.sequence(F.lit(0), F.lit(DRAWS * most - 1)), F.array().cast(f"array<{_SPAN}>"), drawn))
    ticket = lambda m: F.struct(F.xxhash64("attempt", m.node_id).bitwiseAND((1 << 63 - NODE_BITS) - 1).alias("h"), m.alias("m"))
    left = F.sort_array(F.transform(F.filter("own", lambda m: ~clash(F.col("taken"), m)), ticket))
    more = F.when(full(F.col("taken")), F.col("taken")).otherwise(F.aggregate(left, F.col("taken"), lambda taken, x: step(taken, x.m)))
    every = staged(state.select("attempt", key, more.alias("taken")), "slots")
    out = every.select("attempt", key, F.posexplode("taken").alias("n", "t")).select("attempt", key, "n", "t.s", "t.e", "t.kind")
    out.staged_at = every.staged_at
    return out


def snippet_pool(snippets: DataFrame, domain: str, kind: str, key: str) -> DataFrame:
    """(domain, bucket, at, key): snippets numbered in each bucket of their domain; one of several families is in each."""
    each = snippets.select(F.col(domain).alias("domain"), F.explode(buckets_of(F.col(kind))).alias("bucket"), key).filter("domain is not null")
    return staged(indexed(each, [key], ["domain", "bucket"], "at"), "pool")


def drawn_snippets(slots: DataFrame, pool: DataFrame, config: Config, base: str = "source", other: str = "fragment") -> DataFrame:
    """slots with the snippet that each takes: of one of its kind's buckets, or for some of any bucket of the domain. A bucket that
    is empty in the other domain is looked for in the base domain; slots without one drop out."""
    spot = (F.col("attempt"), F.col("n").cast("string"))
    own = buckets_of(F.col("kind"))
    domain = F.when(below(50, *spot, F.lit("domain")) if config.both else F.lit(True), base).otherwise(other)
    asked = slots.withColumn("domain", domain).withColumn("own", F.get(own, F.pmod(pick(*spot, F.lit("bucket")), F.size(own)).cast("int")))
    sizes = staged(pool.groupBy("domain", "bucket").agg(F.count("*").alias("size")), "sizes")
    numbered = indexed(sizes, ["bucket"], ["domain"], "b").select("domain", "b", F.col("bucket").alias("any"))
    asked = asked.join(sizes.groupBy("domain").agg(F.count("*").alias("buckets")), "domain", "left")
    asked = asked.withColumn("b", F.when(below(config.chaotic, *spot, F.lit("chaos")), F.coalesce(F.pmod(pick(*spot, F.lit("any")), F.col("buckets")), F.lit(-1))))
    asked = asked.join(numbered, ["domain", "b"], "left").withColumn("bucket", F.when(F.col("b").isNull(), F.col("own")).otherwise(F.col("any")))
    basic = sizes.filter(F.col("domain") == base).select("bucket", F.col("size").alias("base_size"))
    asked = asked.join(sizes, ["domain", "bucket"], "left").join(basic, "bucket", "left")
    asked = asked.withColumn("domain", F.when(F.col("size").isNull(), base).otherwise(F.col("domain"))).withColumn("size", F.coalesce("size", "base_size"))
    asked = asked.filter("size is not null").withColumn("at", F.pmod(pick(*spot, F.lit("snippet")), F.col("size")))
    return asked.join(pool.hint("merge"), ["domain", "bucket", "at"]).drop("own", "any", "b", "buckets", "size", "base_size", "at")


def placeholder_values(drawn: DataFrame, nodes: DataFrame, files: DataFrame, key: str, text: str) -> DataFrame:
    """(attempt, n, names, values) for the placeholders array<struct<ph,kind>> of drawn snippets: half of them get the text of one of
    the source's nodes that share a family with them, each such node alike. Those of no kind fit none."""
    spot = (F.col("attempt"), F.col("n").cast("string"), F.col("p").cast("string"))
    each = drawn.select("attempt", "n", key, F.posexplode("placeholders").alias("p", "x")).select("attempt", "n", key, "p", "x.ph", F.col("x.kind").alias("wanted"))
    each = each.filter("ph <> '' and wanted is not null").filter(below(50, *spot, F.lit("fill")))
    order = Window.partitionBy(key, "kind").orderBy("s", "e", "node_id")  # the nodes of one text at most
    numbered = nodes.select(key, "kind", "s", "e", (F.row_number().over(order) - 1).cast("bigint").alias("at"))
    counts = nodes.groupBy(key, "kind").agg(F.count("*").alias("count"))
    kinds = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "count", buckets_of(F.col("kind")).alias("buckets")))).alias("kinds"))
    fits = F.filter("kinds", lambda k: F.arrays_overlap(k["buckets"], buckets_of(F.col("wanted"))))
    asked = each.join(kinds, key).withColumn("kinds", fits).withColumn("total", F.aggregate("kinds", F.lit(0).cast("bigint"), lambda a, k: a + k["count"])).filter("total > 0")
    # the number falls to the kind in whose stretch it lies
    start = F.struct(F.try_mod(pick(*spot, F.lit("value")), F.col("total")).alias("at"), F.lit(None).cast("string").alias("kind"))
    walk = lambda a, k: F.when(a["kind"].isNotNull(), a).when(a["at"] < k["count"], F.struct(a["at"].alias("at"), k["kind"].alias("kind"))).otherwise(F.struct((a["at"] - k["count"]).alias("at"), a["kind"].alias("kind")))
    chosen = asked.withColumn("c", F.aggregate("kinds", start, walk)).select("attempt", "n", key, "p", "ph", "c.at", "c.kind")
    value = F.decode(F.substring(F.encode(F.col(text), "UTF-8"), (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")), "UTF-8")
    got = chosen.join(numbered, [key, "kind", "at"]).join(files.select(key, text).hint("merge"), key).select("attempt", "n", F.struct("p", "ph", value.alias("value")).alias("x"))
    listed = got.groupBy("attempt", "n").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # those of one snippet
    return listed.select("attempt", "n", F.col("xs.ph").alias("names"), F.col("xs.value").alias("values"))


def spliced(nodes: DataFrame, files: DataFrame, tries: DataFrame, snippets: DataFrame, deps: DataFrame, config: Config, key: str, text: str, seed: str | None = None) -> DataFrame:
    """(key, attempt, mutant, others): each attempt's source with snippets in its slots and their dependencies in front; others are
    the files the snippets come from; the seed, a column of files, comes along. snippets has snippet_id, filename, kind, fragment,
    deps, placeholders and source (its domain); deps has dep_id and dep. Null fragments are never drawn; attempts without a
    snippet, and empty mutants, give none."""
    usable = staged(snippets.filter("fragment is not null").select("snippet_id", "filename", "kind", "fragment", "deps", "placeholders", "source"), "usable")
    slots, pool = drawn_slots(nodes, tries, key, config), snippet_pool(usable, "source", "kind", "snippet_id")
    drawn = drawn_snippets(slots, pool, config).select("attempt", key, "n", "s", "e", "snippet_id")
    more = (["placeholders"] if config.placeholders else []) + (["deps"] if config.dependencies else [])
    drawn = staged(drawn.join(usable.select("snippet_id", "filename", "fragment", *more).hint("merge"), "snippet_id"), "drawn")
    for done in (usable, slots, pool):
        discard(done)
    parts = drawn.select("attempt", key, "n", "s", "e", "filename", "fragment")
    if config.placeholders:
        values = placeholder_values(drawn, nodes, files, key, text)
        parts = filled(parts.join(values, ["attempt", "n"], "left"), "fragment", "names", "values", "t")
    else:
        parts = parts.withColumn("t", F.col("fragment"))
    part = F.when(below(config.deleted, F.col("attempt"), F.col("n").cast("string"), F.lit("delete")), "").otherwise(F.col("t"))
    # by source, so that neither the parts nor the mutants are moved again for their text
    parts = parts.select("attempt", key, "n", "s", "e", "filename", part.alias("t")).repartition(key)
    edits = parts.groupBy("attempt", key).agg(F.collect_list(F.struct("s", "e", "t")).alias("edits"), F.array_sort(F.collect_list(F.struct("n", "filename"))).alias("from"))
    front = F.lit("")
    if config.dependencies:
        given = drawn.filter(below(config.dependencies, F.col("attempt"), F.lit("dependencies"))).select(key, "attempt", F.explode("deps").alias("dep_id")).distinct()
        prefixes = given.join(deps.select("dep_id", "dep"), "dep_id").groupBy(key, "attempt").agg(dependency_prefix(F.collect_set("dep")).alias("front"))
        edits, front = edits.join(prefixes.repartition(key).hint("merge"), [key, "attempt"], "left"), F.coalesce("front", F.lit(""))
    carried = [seed] if seed else []
    made = edits.join(files.select(key, text, *carried).hint("merge"), key)
    # as the output of a generator a mutant is made once; filters on it would make it again for each word they look for
    once = F.explode(F.array(splice(F.col(text), F.col("edits")))).alias("mutant")
    made = made.select("attempt", key, once, F.filter("from.filename", lambda f: f.isNotNull()).alias("others"), front.alias("front"), *carried)
    return made.filter("mutant <> ''").withColumn("mutant", F.concat("front", "mutant")).drop("front")


def mutants(nodes: DataFrame, files: DataFrame, snippets: DataFrame, deps: DataFrame, config: Config, key: str, text: str, seed: str) -> DataFrame:
    """(key, attempt, way, id, content) of all attempts at all sources that gave a mutant: by splicing, or by one edit of a type, a value
    or an attribute. Those with a word that feigns a crash are left out. Equal mutants have equal ids."""
    tries = staged(attempts(files, key, config), "attempts")
    made = [spliced(nodes, files, tries.filter("way = 'splice'"), snippets, deps, config, key, text, seed).withColumn("way", F.lit("splice"))]
    if config.splice < 100:
        kinds = snippets.filter("kind like '%attribute_item' and fragment is not null").select(F.col("fragment").alias("attribute")).distinct()
        attributes = indexed(kinds, ["attribute"], name="n")
        edits = {"type": type_mutants, "value": value_mutants, "attribute": lambda *a: attribute_mutants(*a, attributes)}
        for way, edit in edits.items():
            own = tries.filter(F.col("way") == way).select(key, "attempt")
            got = edit(nodes.join(own, key), files.hint("merge").join(own, key).select("attempt", text), "attempt", text)
            own = own.join(files.select(key, seed).hint("merge"), key)
            made.append(got.join(own, "attempt").withColumn("others", F.array().cast("array<string>")).withColumn("way", F.lit(way)))
    every = reduce(DataFrame.unionByName, (m.select("attempt", key, "mutant", "others", seed, "way") for m in made))
    return identified(every, "mutant", F.coalesce(F.col(seed), F.lit("")), F.col("others")).select(key, "attempt", "way", "id", "content")
