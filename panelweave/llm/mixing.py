"""Mixing sources to target weights by a low-discrepancy schedule.

In DataFrame functions only.  The mix is a sequence of slots.  Slot t maps the
golden-ratio point frac((t + 1/2) * phi) through the cumulative target shares to
a source, and the slots of a source are ranked.  The documents of a source are
shuffled by a hash and laid on a line of words; its target length, which may
wrap around the line, is cut into as many equal blocks as the source has slots.
Slot of rank r takes block r; a source that the points miss gets one slot more.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and
share all words; a target stops at ``most`` times its source's size and the
excess is shared again by weight.  Blocks are cut from the target length, so the
words taken of a source are its target, rounded, and no document goes beyond
``most`` times its size.

Defined cases: null text has size 0 and takes nothing; a source without words
has target 0; repeated rows and doc_ids are documents of their own, at places of
their own; null doc_ids are allowed; an empty table gives an empty mix; the
result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import quoted
from panelweave.storage import stage

# Fixed values of the contract.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3

BLOCK_WORDS = 4096
DOCS_A_BUCKET = 1024
SLOTS_A_CHUNK = 1024
CELLS = 4096
PHI = 0.6180339887498949


def word_count(text: Column) -> Column:
    """Runs of characters other than the space and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, goal (whole words), from (source, size).

    Filling goes from the source that meets its limit first: with sources
    ordered by size over weight, the first j are limited exactly as long as the
    rest's share per weight stands above their limit.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row a source
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # as long as sources are limited the level rises; the first free source has the final one
    free = F.col("level") * F.col("weight") <= F.col("limit")
    final = F.min(F.when(free, F.struct("nth", "level"))).over(everything)["level"]
    first = F.min(F.when(free, F.col("nth"))).over(everything)
    filled = (
        weighed.withColumn("level", level).withColumn("nth", F.row_number().over(by_ratio)).withColumn("final", final).withColumn("first", first)
        .withColumn("target", F.when(F.col("nth") >= F.col("first"), F.col("final") * F.col("weight")).otherwise(F.col("limit")).cast("double"))
    )
    return filled.select(
        "source", "source_size", "weight", "target",
        F.least(F.round("target").cast("long"), F.col("limit")).alias("goal"),
    )


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_nr, rank and slots of the source; a row for each slot.

    Points meet cumulative shares by an equal-width cell, so no task sees all
    slots; ranks are counted in chunks of slots.
    """
    total = targets.agg(F.sum("goal")).first()[0] or 0
    slots = -(-total // block_words)
    by_nr = Window.orderBy("source_nr")  # a row a source
    edges = (
        targets.where("goal > 0").withColumn("hi", F.sum("goal").over(by_nr) / F.lit(float(max(total, 1))))
        .withColumn("lo", F.lag("hi", 1, 0.0).over(by_nr))
        .select("source_nr", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    )
    turn = (F.col("slot") + 0.5) * PHI
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"))
    points = points.withColumn("u", turn - F.floor(turn)).withColumn("cell", F.floor(F.col("u") * CELLS))
    placed = points.join(edges, "cell").where("u >= lo and u < hi").select("source_nr", "slot")
    missed = targets.where("goal > 0").join(placed.select("source_nr").distinct(), "source_nr", "left_anti")
    placed = placed.unionByName(missed.select("source_nr", (F.lit(slots) + F.col("source_nr")).alias("slot")))
    placed = placed.withColumn("chunk", F.floor(F.col("slot") / SLOTS_A_CHUNK))
    counts = placed.groupBy("source_nr", "chunk").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source_nr").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "source_nr", "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy("source_nr")).alias("slots"),
    )
    own = F.row_number().over(Window.partitionBy("source_nr", "chunk").orderBy("slot")) - 1
    return placed.withColumn("own", own).join(bases, ["source_nr", "chunk"]).select(
        "slot", "source_nr", (F.col("base") + F.col("own")).alias("rank"), "slots"
    )


def document_lines(sized: DataFrame, seed: int = 0) -> DataFrame:
    """``sized`` with ``start``: the words of its source before each document, in shuffled order.

    Sums run inside hash buckets of a source, and over the buckets' totals.
    """
    n, digits = sized.count(), 1
    while 16**digits * DOCS_A_BUCKET < n:
        digits += 1
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    hashed = sized.withColumn("h", h).withColumn("bucket", F.substring("h", 1, digits))
    totals = hashed.groupBy("source_nr", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source_nr").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source_nr", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_nr", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(bases, ["source_nr", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("h", "bucket", "base", "inside")


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    seed: int = 0,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(lines, pieces) of the mix.

    lines: a row a document with doc_id, source, size, source_size, target, goal
    and its place (source_nr, start); places of documents with words are unique.
    pieces: slot, source_nr, start, epoch, first_word (from 0) and words; in
    order of slot and place they are the mixed sequence.
    """
    sized = stage(
        docs.select(quoted(doc_id).alias("doc_id"), quoted(source).cast("string").alias("source"), word_count(quoted(text)).alias("size")), "sizes"
    )
    nr = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row a source
    targets = stage(source_targets(sized).withColumn("source_nr", nr), "targets")
    names = targets.select(F.col("source").alias("name"), "source_nr", "source_size", "target", "goal")
    numbered = sized.join(names, sized["source"].eqNullSafe(names["name"])).drop("name")
    lines = stage(document_lines(numbered, seed), "lines")
    slots = stage(schedule(targets, block_words), "slots")
    of_source = slots.groupBy("source_nr").agg(F.first("slots").alias("slots"))

    epochs = F.sequence(F.lit(0), F.expr("cast((goal - 1) div source_size as int)"))
    laid = lines.where("size > 0 and goal > 0").withColumn("epoch", F.explode(epochs))
    laid = laid.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size"))
    laid = laid.withColumn("b", F.least(F.col("a") + F.col("size"), "goal")).where("a < b").join(of_source, "source_nr")
    # block r holds the words from floor(r * goal / slots) up to floor((r + 1) * goal / slots)
    block = "(cast({} + 1 as decimal(19)) * cast(slots as decimal(18)) - 1) div goal"
    edge = "(cast({} as decimal(18)) * cast(goal as decimal(19))) div slots"
    cut = laid.withColumn("rank", F.explode(F.sequence(F.expr(block.format("a")), F.expr(block.format("(b - 1)")))))
    cut = cut.withColumn("from", F.greatest("a", F.expr(edge.format("rank")))).withColumn("to", F.least("b", F.expr(edge.format("(rank + 1)"))))
    pieces = cut.drop("slots").join(slots.select("source_nr", "rank", "slot"), ["source_nr", "rank"])
    return lines, pieces.select(
        "slot", "source_nr", "start", "epoch", (F.col("from") - F.col("a")).alias("first_word"), (F.col("to") - F.col("from")).alias("words")
    )


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes of each document."""
    lines, pieces = mix(docs, **options)
    taken = pieces.groupBy("source_nr", "start").agg(F.sum("words").alias("taken"), F.countDistinct("epoch").alias("copies"))
    lines = lines.withColumn("at", F.when(F.col("size") > 0, F.col("start")))  # empty documents meet no piece
    joined = lines.join(taken.withColumnRenamed("start", "at"), ["source_nr", "at"], "left")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix comes to them, whole each time.

    A document is not cut: the one at the end of a source's target counts whole,
    so a source is over its target by less than that document.
    """
    keys = ["k_id", "k_source", "k_size"]
    row = docs.select(
        F.struct("*").alias("row"), quoted(doc_id).alias("k_id"), quoted(source).cast("string").alias("k_source"),
        word_count(quoted(text)).alias("k_size"), F.xxhash64(quoted(text)).alias("k_hash"),
    )
    row = row.withColumn("k_nr", F.row_number().over(Window.partitionBy(*keys).orderBy("k_hash")))
    taken = taken_words(docs, text=text, doc_id=doc_id, source=source, **options)
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "copies").where("copies > 0")
    taken = taken.withColumn("t_nr", F.row_number().over(Window.partitionBy("t_id", "t_source", "t_size").orderBy("copies")))
    same = [row[f"k_{c}"].eqNullSafe(taken[f"t_{c}"]) for c in ("id", "source", "size", "nr")]
    found = row.join(taken, same[0] & same[1] & same[2] & same[3])
    repeated = found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
