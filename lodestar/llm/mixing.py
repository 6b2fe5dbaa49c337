"""Mixing sources to target weights by pivotal dependent rounding, in Spark expressions only.

Each source has a target number of words. Its documents share the fractional
number of copies ``target / size of the source``: the whole part is taken by
every document, the rest is a probability. Probabilities are rounded by pivots:
of two documents, mass moves at random from one to the other, counted in words,
until one probability is 0 or 1. The expected copies of each document stay what
they were and so does the sum of words, but for the document left at the end.

The rounding is a reduction tree. Documents of a source fall into chunks of
about ``CHUNK`` by a hash; each chunk leaves one document with a fraction; these
are paired within chunks of the next level, until a source has one, which takes
as many of its words as still fit the target. Only ids, sizes and fractions are
shuffled, in chunks whose size doesn't depend on the source's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import Scratch, partitions, positions

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix in terms of all words, and of a source's share in terms of its words.
TOTAL_SHARE, MOST_COPIES = 1.5, 2
#: Documents of a chunk, on average.
CHUNK = 64
#: Rows alike that one task numbers.
ALIKE = 4096
#: White space that parts words.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, n, target`` from rows ``source, size`` and, if they stand for several, ``alike``.

    Targets go by weight, and stop at ``MOST_COPIES`` times the source's size;
    what they leave is shared again by weight, until no other source stops.
    Each round is one aggregate of the sources, and their places for the
    weights come from sorted ranges, so they never come together. A null
    source is a source of its own, the last.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    alike = F.col("alike") if "alike" in sizes.columns else F.lit(1)
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * alike).cast("bigint").alias("source_size"), F.sum(alike).cast("bigint").alias("n"))
    per = positions(per, [F.col("source").asc_nulls_last()], scratch, "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("position", F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("room", F.col("source_size") * MOST_COPIES)
    # The level is what a weight of one gets; sources whose room is less stop, which raises it for the others.
    level, stopped = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("room") < level * F.col("weight")
        sums = per.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("room"))), F.sum(F.when(~stops, F.col("weight"))), F.count_if(stops)).first()
        if sums[3] == stopped or not sums[2]:
            break
        level, stopped = (TOTAL_SHARE * (sums[0] or 0) - (sums[1] or 0)) / sums[2], sums[3]
    target = F.least(F.col("room").cast("double"), F.lit(level) * F.col("weight")) if level is not None else F.col("room").cast("double")
    return per.select("source", "source_size", "n", target.alias("target"))


def _uniform(*of: Column) -> Column:
    """A number from [0, 1) that its arguments fix."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / float(1 << 53)


def _pivots(items: Column, level: int) -> Column:
    """Round the fractions of an array of ``order, key, size, mass, open`` in turn.

    ``mass`` is the fraction in words. The result has ``done``, the keys with
    the words that they take, and ``rest``, the one item left with a fraction.
    """
    kind = "struct<order:bigint,key:bigint,size:bigint,mass:double>"
    start = F.struct(F.expr("cast(array() as array<struct<key:bigint,words:bigint>>)").alias("done"), F.lit(None).cast(kind).alias("rest"))

    def closed(x: Column, words: Column) -> Column:
        return F.array(F.struct(x["key"].alias("key"), words.cast("bigint").alias("words")))

    def step(state: Column, x: Column) -> Column:
        held = state["rest"]
        # What can move to the new item until either is settled, and the other way round.
        there = F.least(held["mass"], x["size"] - x["mass"])
        back = F.least(x["mass"], held["size"] - held["mass"])
        moves_there = _uniform(held["order"], x["order"], held["key"], x["key"], F.lit(level)) * (there + back) < back
        a = F.when(moves_there, held["mass"] - there).otherwise(held["mass"] + back)
        b = F.when(moves_there, x["mass"] + there).otherwise(x["mass"] - back)
        held_settles = F.when(moves_there, held["mass"] <= x["size"] - x["mass"]).otherwise(held["size"] - held["mass"] <= x["mass"])
        new = lambda y, m: F.struct(y["order"].alias("order"), y["key"].alias("key"), y["size"].alias("size"), m.alias("mass")).cast(kind)
        settled = F.when(held_settles, closed(held, F.when(moves_there, F.lit(0)).otherwise(held["size"]))).otherwise(closed(x, F.when(moves_there, x["size"]).otherwise(F.lit(0))))
        left = F.when(held_settles, new(x, b)).otherwise(new(held, a))
        first = F.struct(state["done"].alias("done"), new(x, x["mass"]).alias("rest"))
        return F.when(held.isNull(), first).otherwise(F.struct(F.concat(state["done"], settled).alias("done"), left.alias("rest")))

    return F.aggregate(items, start, step)


def row_hash(doc_id: Column, text: Column) -> Column:
    """What tells rows apart in the mix."""
    return F.xxhash64(doc_id, text)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The words that the mix takes of each document.

    Columns: ``doc_id, size, source_size, target`` (of its source), ``taken``
    and ``row_hash`` (of id and text). A document is taken whole, once, twice
    or not at all; one document of each source may be taken in part, so that
    the source's words meet its target to the word.

    Null texts have no words and take none. Null sources are one source; null
    ids are ids like any other and repeated rows are rounded row by row, told
    apart by a number. Other columns are not read. An empty
    table gives no rows. Reruns agree, however the rows are partitioned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    col = lambda name: F.col(f"`{name}`")
    sized = docs.select(col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), words_in(col(text_col).cast("string")).alias("size"), row_hash(col(id_col), col(text_col)).alias("row_hash"))
    # Rows that are the same in every respect get numbers, so that a hash spreads them like any others.
    alike = scratch.write(sized.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("alike")), "alike")
    upto = lambda first, last: F.explode(F.sequence(first, last))
    few = alike.where(F.col("alike") <= ALIKE).withColumn("number", upto(F.lit(1).cast("bigint"), F.col("alike")))
    # Of many, tasks number blocks.
    blocks = alike.where(F.col("alike") > ALIKE).withColumn("block", upto(F.lit(0).cast("bigint"), F.floor((F.col("alike") - 1) / ALIKE))).repartition(partitions(spark), "row_hash", "block")
    many = blocks.withColumn("number", upto(F.col("block") * ALIKE + 1, F.least(F.col("alike"), (F.col("block") + 1) * ALIKE))).drop("block")
    rows = few.unionByName(many).drop("alike").withColumn("order", F.xxhash64("row_hash", "source", "number"))
    shares = scratch.write(targets(alike.select("source", "size", "alike")), "targets")
    renamed = shares.select(F.col("source").alias("of_source"), "source_size", "n", "target")
    rows = rows.join(renamed, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chunk = F.pmod(F.xxhash64("order", F.lit(0)), F.ceil(F.col("n") / CHUNK))
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("chunk", chunk)
    rows = rows.withColumn("mass", (copies - F.col("whole")) * F.col("size"))

    # First level: the chunk's documents in an order of their own, each known by its place.
    member = F.struct("order", "doc_id", "row_hash", "size", "whole", "mass")
    grouped = rows.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(member)).alias("members"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    placed = F.transform("members", lambda m, k: F.struct(m["order"].alias("order"), k.cast("bigint").alias("key"), m["size"].alias("size"), m["mass"].alias("mass")))
    open_ = F.filter(placed, lambda m: (m["mass"] > 0) & (m["mass"] < m["size"]))
    first = scratch.write(grouped.withColumn("rounded", _pivots(open_, 0)), "level0")

    # The tree above: the one open document of each chunk, with the chunk as its key.
    rest = first.where("rounded.rest is not null").select("source", F.col("chunk").alias("key"), F.col("rounded.rest.order").alias("order"), F.col("rounded.rest.size").alias("size"), F.col("rounded.rest.mass").alias("mass"))
    settled, level = [], 0
    most = shares.agg(F.max(F.ceil(F.col("n") / CHUNK))).first()[0] or 0
    while most > 1:
        level += 1
        most = -(-most // CHUNK)
        # Neighbouring chunks meet, so that their number shrinks by a factor each level, whatever the hash did.
        up = rest.withColumn("group", F.floor(F.col("key") / CHUNK**level))
        items = F.array_sort(F.collect_list(F.struct("order", "key", "size", "mass")))
        stage = scratch.write(up.groupBy("source", "group").agg(_pivots(items, level).alias("rounded")), f"level{level}")
        settled.append(stage.select("source", F.explode("rounded.done").alias("x")).select("source", F.col("x.key").alias("key"), F.col("x.words").alias("words")))
        rest = stage.where("rounded.rest is not null").select("source", *[F.col(f"rounded.rest.{k}").alias(k) for k in ("key", "order", "size", "mass")])
    settled.append(rest.select("source", "key", F.round("mass").cast("bigint").alias("words")))

    outcome = settled[0]
    for more in settled[1:]:
        outcome = outcome.union(more)
    outcome = outcome.select(F.col("source").alias("of_source"), F.col("key").alias("of_chunk"), F.col("words").alias("rest_words"))
    chunks = first.join(outcome, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("chunk") == F.col("of_chunk")), "left")
    # The places that the first level settled, and the one that the tree did.
    taken_at = F.map_from_entries(F.transform("rounded.done", lambda d: F.struct(d["key"], d["words"])))
    taken_at = F.when(F.col("rest_words").isNull(), taken_at).otherwise(F.map_concat(taken_at, F.map_from_arrays(F.array("rounded.rest.key"), F.array("rest_words"))))
    each = chunks.select("source_size", "target", taken_at.alias("extra"), F.posexplode("members").alias("place", "m"))
    extra = F.coalesce(F.col("extra")[F.col("place").cast("bigint")], F.when(F.col("m.mass") >= F.col("m.size"), F.col("m.size")), F.lit(0))
    return each.select("m.doc_id", "m.size", "source_size", "target", (F.col("m.whole") * F.col("m.size") + extra).cast("bigint").alias("taken"), "m.row_hash")


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken.

    The one document of a source that is taken in part comes with its first
    words only, with the white space between them as it was; if texts
    have to stay ``whole``, it is taken or left instead, by a hash, with the
    probability of that part. Documents without
    words aren't in the mix.
    """
    outcome = mixed(docs, id_col, text_col, source_col)
    if whole:
        chance = F.pmod(F.xxhash64("row_hash", F.lit("whole")), F.lit(1 << 53)) / F.lit(float(1 << 53))
        part = F.pmod("taken", "size")
        outcome = outcome.withColumn("taken", F.when(part > 0, F.col("taken") - part + F.when(chance * F.col("size") < part, F.col("size")).otherwise(F.lit(0))).otherwise(F.col("taken")))
    by_row = outcome.groupBy("doc_id", "row_hash").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("n"))
    by_row = Scratch(docs.sparkSession, "sampled").write(by_row.where("taken > 0").withColumnRenamed("doc_id", "of_id").withColumnRenamed("row_hash", "of_row"), "taken")
    text = F.col(f"`{text_col}`")
    # The row goes along as one struct, so that its columns can have any names. Id and hash together tell it.
    id_ = F.col(f"`{id_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_.alias("id"), text.cast("string").alias("text"), row_hash(id_, text).alias("row_hash"))
    if not by_row.where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "row_hash"])
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.pmod("taken", "size").cast("int")), "")
    copies = F.array_repeat("text", F.floor(F.col("taken") / F.col("size")).cast("int"))
    copies = F.when(F.pmod("taken", "size") > 0, F.concat(copies, F.array(part))).otherwise(copies)
    joined = rows.join(by_row.drop("n"), (F.col("row_hash") == F.col("of_row")) & F.col("id").eqNullSafe(F.col("of_id"))).withColumn("copy", F.explode(copies))
    return joined.select(*[F.col("copy").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
