"""Operator 10, mixing sources to target weights by systematic sampling.

Sources (by code point, null last) weigh 1, 2, 3, repeating, and share all words. A target
stops at ``MOST_COPIES`` times its source's size; what it can't take is shared again by
weight until no target is above its stop.

Within a source, documents are put in order of size, then of a digest of their id; each
document's expected copies are added up in that order, plus one random offset per source,
and the document is emitted once for every integer crossed. Documents of more than
``1 / LARGE`` of the target come first: their expected copies are target / size of the
source; those of all others are what is then left of the target, over their own size. So
the taken words stay within about one ordinary document of the target, although every
document is expected as often as the others.

Running numbers in a source come from one range partitioning of (source, size, digest),
stored in the shared folder, and one small row per (partition, source): a source holding a
third of all rows is spread over as many tasks as its rows need.

Defined cases: null and blank texts have size 0 and are copied like all others; sources
without words have target 0 and are never copied; a null source is a source of its own;
rows repeating a doc_id are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutique.llm.frames import as_rows, stored

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
LARGE = 20
#: Rows (one per partition and source) up to which the running offsets are broadcast.
BROADCAST_CELLS = 1_000_000
SEED = "mix-1"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources that stop early are those of the smallest stop per weight. With the sources in
    that order, the level of the others after the first j have stopped is
    (total - their stops) / (total weight - their weights); the sources that stop are those
    whose stop per weight is below the level left by all before them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", weight).withColumn("stop", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("stop") / F.col("w"), "k")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("open", F.col("stop") / F.col("w") > F.col("level"))
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    stops = ~F.bool_or("open").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = ranked.withColumns({"free": free, "stops": stops})
    return ranked.select(
        "source", "source_size",
        F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(F.col("free") * F.col("w")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The random number in [0, 1) of a source: 20 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / float(1 << 20)


def copies(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """``row`` (the document's columns), size, source_size, target, copies, taken."""
    rows = documents.select("row", "doc_id", "source", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest"))
    key = ["source", "size", "digest", "doc_id"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranged = stored(
        rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
        .select("row", "source", "size", place.alias("place")), "mix-order")
    part = F.shiftright("place", 33)
    cells = ranged.groupBy("source", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    cells = stored(cells, "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    goal = targets(sizes, weights, most)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    cells = cells.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.*", "source_size", "target")
    cells = stored(cells, "mix-offsets")
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    joined = ranged.withColumn("part", part).alias("r").join(
        (F.broadcast(cells) if few else cells).alias("c"),
        (F.col("r.part") == F.col("c.part")) & F.col("r.source").eqNullSafe(F.col("c.source")))
    rank = F.col("earlier") + F.col("place") - F.col("first")
    large = F.col("size") * LARGE > F.col("target")
    joined = joined.select("row", "r.source", "size", "source_size", "target", rank.alias("rank"), large.alias("large"), offset(F.col("r.source"), seed).alias("start"))

    def crossed(rate: Column) -> Column:
        return (F.floor(F.col("start") + rate * (F.col("rank") + 1)) - F.floor(F.col("start") + rate * F.col("rank"))).cast("long")

    common = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    first = joined.filter("large").groupBy("source").agg(
        F.sum(crossed(common) * F.col("size")).alias("large_taken"), F.sum("size").alias("large_size"))
    joined = joined.alias("j").join(stored(first, "mix-large").alias("f"), F.col("j.source").eqNullSafe(F.col("f.source")), "left")
    size_left = F.col("source_size") - F.coalesce("large_size", F.lit(0))
    words_left = F.greatest(F.col("target") - F.coalesce("large_taken", F.lit(0)), F.lit(0.0))
    rest = F.when(size_left > 0, F.least(words_left / size_left, F.lit(float(most)))).otherwise(F.lit(0.0))
    times = F.when(F.col("large"), crossed(common)).otherwise(crossed(rest))
    return joined.select("row", "size", "source_size", "target", times.alias("copies"), (times * F.col("size")).alias("taken"))


def sized(documents: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The input of :func:`copies`: row, doc_id, source, size."""
    rows = as_rows(documents, text)
    return rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col(f"row.{source}").alias("source"), word_count("text").alias("size"))


def mix_sizes(documents: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, copies."""
    slim = documents.select("doc_id", "source", word_count("text").alias("size")).select(
        F.struct("doc_id").alias("row"), "doc_id", "source", "size")
    return copies(slim).select("row.doc_id", "size", "source_size", "target", "taken", "copies")


def mix_documents(documents: DataFrame) -> DataFrame:
    """The mixed corpus: every document's row as often as it is copied, columns unchanged."""
    mixed = copies(sized(documents)).filter(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
