"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a hashed order and their token stream is
cut into blocks of equal tokens. Slot i of the mix has the golden-ratio point
u = i * 2654435769 mod 2**32 (the integer nearest 2**32 over the golden
ratio); the source whose interval of cumulative target weights holds u gets
the slot. The r-th slot of a source takes its block r mod (its blocks), so a
source with too few blocks starts over (``epoch``) and one with too many
gives the first of its shuffled blocks. There are as many slots as blocks in
the input: the token budget stays, the shares become the targets.

Default targets: tokens ** 0.75, made from square roots so that any engine
gets the same numbers. A token is a run between single white-space characters
(their number plus one), counted over whole texts; pass ``tokens`` to use
other counts.

Running sums are two-level (4096 ranges per source by hash, then within a
range; the same for slots), so no task sees a whole source.

Defined results: a null source counts as ''; null and empty texts have no
tokens and sit where the stream stands; a source without tokens has one
block and the weight 0, so it gets no slot unless ``targets`` gives it one; a
null doc_id is ordered as ''; repeated rows are rows of their own; other
columns are ignored by ``schedule`` and passed on by ``mix``. An empty table
gives an empty schedule. A target for a source that doesn't occur is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared

BLOCK_TOKENS = 16_384
GOLDEN = 2_654_435_769
SPAN = 1 << 32
SEED = "mix-1"
RANGES = 4096


def token_count(text: Column) -> Column:
    """White-space characters plus one; 0 for null and empty texts."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.translate(text, " \n\r\t", "")) + 1).cast("bigint")


def _streams(docs: DataFrame, tokens: Column | None, block_tokens: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in their source's stream, and (source, total, blocks)."""
    _shared.require(docs, "doc_id", "text", "source")
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (token_count(text) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("bigint")).alias("n_tokens"),
        F.xxhash64(text).alias("mark"),
    )
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = _shared.cut(rows.withColumn("part", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")))
    parts = rows.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)))
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "n_tokens", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts.select("source", "part", "ahead"), ["source", "part"])
    rows = rows.select("doc_id", "source", "n_tokens", "mark", (F.col("ahead") + F.col("inside")).alias("begin"))
    sources = parts.groupBy("source").agg(F.sum("part_tokens").alias("total"))
    return rows, sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)))


def _bounds(sources: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """(source, blocks, low, high): intervals of [0, 2**32) in the order of source names. One row per source."""
    if targets is None:
        root = F.sqrt(F.col("total").cast("double"))
        weight = F.floor(root * F.sqrt(root) * 1000)
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, int(v * 10**9))]), F.col("source")) if targets else F.lit(0), F.lit(0))
    sources = sources.withColumn("weight", weight.cast("bigint"))
    whole = Window.partitionBy(F.lit(1))
    running = whole.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    sources = sources.withColumn("upto", F.sum("weight").over(running)).withColumn("all", F.sum("weight").over(whole))
    edge = lambda c: F.floor(F.try_divide(c.cast("double"), F.col("all").cast("double")) * SPAN)
    return sources.select("source", "blocks", edge(F.col("upto") - F.col("weight")).alias("low"), edge(F.col("upto")).alias("high")).where("high > low")


def _slots(sources: DataFrame, bounds: DataFrame) -> DataFrame:
    """(slot, source, epoch, block) of every slot."""
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % SPAN).alias("u"))
    slots = slots.withColumn("cell", F.shiftright("u", 20))
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.shiftright("low", 20), F.shiftright(F.col("high") - 1, 20))))
    slots = slots.join(cells, "cell").where("u >= low and u < high").select("slot", "source", "blocks", F.expr("slot div 65536").alias("span"))
    spans = slots.groupBy("source", "span").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("source", "span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "span").orderBy("slot")
    slots = slots.withColumn("inside", F.row_number().over(inside) - 1).join(spans, ["source", "span"])
    rank = F.col("ahead") + F.col("inside")
    return slots.select("slot", "source", (rank / F.col("blocks")).cast("bigint").alias("epoch"), (rank % F.col("blocks")).alias("block"))


def _pieces(docs: DataFrame, targets: dict[str, float] | None, tokens: Column | None, block_tokens: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Pieces of documents in their slots, and the (doc_id, text) that occur more than once."""
    rows, sources = _streams(docs, tokens, block_tokens, seed)
    sources = _shared.cut(sources)
    slots = _slots(sources, _bounds(sources, targets))
    last = F.greatest(F.col("begin"), F.col("begin") + F.col("n_tokens") - 1)
    rows = rows.join(sources.select("source", F.col("blocks").alias("_blocks")), "source")
    final = F.col("_blocks") - 1  # texts without tokens at the end of a stream stay in its last block
    rows = rows.withColumn("block", F.explode(F.sequence(F.least(F.floor(F.col("begin") / block_tokens), final), F.least(F.floor(last / block_tokens), final))))
    start = F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("begin"))
    end = F.least(F.col("n_tokens"), (F.col("block") + 1) * block_tokens - F.col("begin"))
    rows = rows.select("source", "block", "doc_id", "mark", start.alias("token_from"), end.alias("token_to"))
    repeats = rows.where("token_from = 0").groupBy("source", "doc_id", "mark").count().where("count > 1")
    return slots.join(rows, ["source", "block"]), repeats


def schedule(docs: DataFrame, targets: dict[str, float] | None = None, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """(slot, source, epoch, block, doc_id, token_from, token_to): the pieces of documents in every slot."""
    return _pieces(docs, targets, tokens, block_tokens, seed)[0].select("slot", "source", "epoch", "block", "doc_id", "token_from", "token_to")


def mix(docs: DataFrame, targets: dict[str, float] | None = None, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """Whole documents in the order of the schedule: one comes with each slot whose block holds its beginning."""
    spark, names = docs.sparkSession, docs.columns
    pieces, repeats = _pieces(docs, targets, tokens, block_tokens, seed)
    chosen = pieces.where("token_from = 0")
    slot, key, mark = _shared.fresh(names, "_slot", "_id", "_mark")
    keys = _shared.cut(chosen.select(F.col("slot").alias(slot), F.col("doc_id").alias(key), F.col("mark").alias(mark)))
    # a repeated row is scheduled as often as it occurs, so it is joined once
    once = docs if repeats.isEmpty() else docs.dropDuplicates(["doc_id", "text"])
    joined = once.join(keys, F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(mark)))
    n = max(1, (keys.agg(F.max(slot)).first()[0] or 0) + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = joined.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col(slot) * parts / n)).cast("int")).sortWithinPartitions(slot, key)
    return ordered.select(*[F.col(f"`{c}`") for c in names])
