"""Operator 6: mixing sources to target weights [DataFrame functions only].

The words of a source, its documents in a pseudorandom order, form one stream that is cut into blocks of a fixed
length. How many slots each output shard has of each source is drawn first: a multinomial draw given the sources'
totals, so that targets are met. Slots are numbered on from shard to shard, and a slot's number is mapped to a block
through a pseudorandom permutation of the source's block indices, a new one for each time that the source is used up;
each row computes that for itself. Blocks are joined by index. The last slot of a source is cut to its target.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last one;
rows that repeat a doc_id, or have none, are documents of their own; an empty table gives an empty mix; other columns of
the input are not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, prefix_sums, staged, whole_row

SEED, ROUNDS = "mix", 24


def word_count(text: Column) -> Column:
    """The number of runs of characters other than blanks."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+", -1))).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """One row (source, source_size, target) for each source of sizes (source, size).

    Sources in the order of their code points, null last, get the weights in turn; together they take `share` of all
    words. A target stops at `most` times its source's size and the excess goes to the others by weight. That is a
    common level x with target = min(most * size, x * weight): in the order of cap per weight, the sources before a
    point are capped and the rest share what is left. One row for each source is all that is ordered here.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(every) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    full = per.withColumn("goal", F.sum("source_size").over(whole) * F.lit(float(share)))
    full = full.withColumn("caps", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    full = full.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    full = full.withColumn("level", (F.col("goal") - F.coalesce("caps", F.lit(0.0))) / F.col("open"))
    # The first source in this order that its level doesn't fill fixes the level of all that follow.
    full = full.withColumn("fixed", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole))
    target = F.least("cap", F.coalesce(F.col("fixed.level"), F.lit(float("inf"))) * F.col("weight"))
    return full.select("source", F.col("source_size").cast("bigint"), target.cast("double").alias("target"))


def shuffled(index: Column, size: Column, keys: list[Column], inverse: bool = False) -> Column:
    """The place of `index` in a pseudorandom permutation of 0 .. size - 1 that `keys` choose, or the index at a place.

    In each of ROUNDS rounds an index and its partner, the key of the round less the index, swap if a hash of the larger
    of them says so. A round is its own inverse, so the inverse takes the rounds backwards; no row looks at another.
    """
    order = F.lit(list(range(ROUNDS))[:: -1 if inverse else 1])
    long = lambda c: c.cast("bigint")
    start = F.struct(long(index).alias("x"), long(size).alias("n"))

    def step(s: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *keys, r), s["n"]) - s["x"], s["n"])
        top = F.greatest(s["x"], partner)
        swaps = F.xxhash64(F.lit("swap"), *keys, r, top) % 2 == 0
        return F.struct(F.when(swaps, partner).otherwise(s["x"]).alias("x"), s["n"].alias("n"))

    return F.aggregate(order, start, step)["x"]


def _unrolled(rows: DataFrame, n: str, name: str, rows_each: int) -> DataFrame:
    """A row for each of 0 .. n - 1, as `name`; chunks of numbers are spread before they are unrolled."""
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(n) - 1).cast("bigint"), F.lit(rows_each).cast("bigint"))).alias("from")
    spread = rows.where(F.col(n) > 0).select("*", chunk).repartition(partitions(rows.sparkSession), F.xxhash64(*map(F.col, rows.columns), F.col("from")))
    return spread.select(*rows.columns, F.explode(F.sequence("from", F.least(F.col("from") + rows_each, n) - 1)).alias(name))


def slot_plan(targets: DataFrame, block_words: int) -> DataFrame:
    """targets with n_blocks, last (words of the last block) and slots: how many slots fill the goal.

    An epoch uses each block once. In the last one the short block counts only if the permutation puts it early enough.
    """
    n = targets.where("goal > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("bigint"))
    n = n.withColumn("last", F.col("source_size") - (F.col("n_blocks") - 1) * block_words).withColumn("epochs", F.expr("goal div source_size"))
    n = n.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    n = n.withColumn("short_at", shuffled(F.col("n_blocks") - 1, F.col("n_blocks"), [F.col("source"), F.col("epochs")], inverse=True))
    whole = F.ceil(F.col("rest") / F.lit(block_words)).cast("bigint")
    more = F.ceil((F.col("rest") + block_words - F.col("last")) / F.lit(block_words)).cast("bigint")
    n = n.withColumn("slots", F.col("epochs") * F.col("n_blocks") + F.when(F.col("rest") == 0, F.lit(0)).when(F.col("short_at") >= whole, whole).otherwise(more))
    return n.drop("rest", "short_at", "epochs")


def shard_counts(plan: DataFrame, shard_slots: int, least_shards: int, rows_each: int = 65_536, draw: str = "draw") -> DataFrame:
    """The draw: one row (source, shard, n_slots, first_slot) for each output shard that gets slots of a source.

    All slots' tickets, a source's ones in a row, are dealt to shards through one pseudorandom permutation, so a shard's
    counts by source are a multinomial draw given the sources' totals, and shards are of one size. first_slot numbers a
    source's slots on from shard to shard. One row for each source is all that the totals order.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    told = plan.select("source", "slots", (F.sum("slots").over(every) - F.col("slots")).alias("ticket"), F.sum("slots").over(Window.partitionBy()).alias("all_slots"))
    told = told.withColumn("shards", F.greatest(F.lit(least_shards), F.ceil(F.col("all_slots") / F.lit(shard_slots))).cast("bigint"))
    draws = _unrolled(told, "slots", "own", rows_each)
    shard = F.pmod(shuffled(F.col("ticket") + F.col("own"), F.col("all_slots"), [F.lit(draw)]), F.col("shards"))
    counts = draws.select("source", shard.alias("shard")).groupBy("source", "shard").agg(F.count("*").alias("n_slots"))
    along = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(along), F.lit(0)))


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 512, shard_slots: int = 65_536, least_shards: int = 8, row_id: Column | None = None, draw: str = "draw") -> tuple[DataFrame, DataFrame]:
    """Returns (uses, sizes).

    uses: one row (source, shard, slot, epoch, block, take) for each slot, take being how many of the block's words it
    holds; blocks are the source's by number. sizes: one row (doc_id, row_id, source, size, source_size, target, first) for
    each document, first being its place in its source's stream. row_id is the number of a row; by default rows get one
    as they are written. An output shard has about shard_slots slots, or there are least_shards of them.
    """
    # The number of a row, kept in a written table, tells rows apart that have no words and repeat a doc_id.
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id")), "sizes")
    targets = staged(source_targets(sizes, list(weights), share, most), "targets").withColumn("goal", F.round("target").cast("bigint"))
    placed = prefix_sums(sizes, "source", [F.coalesce("doc_id", F.lit(-1)), F.col("text_hash")], "size", sizes.count(), SEED)
    named = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    sizes = placed.join(named, F.col("source").eqNullSafe(F.col("t_source"))).select("doc_id", "row_id", "source", "size", "source_size", "target", F.col("before").alias("first"))

    plan = staged(slot_plan(targets, block_words), "slot-plan")
    counts = staged(shard_counts(plan, shard_slots, least_shards, draw=draw), "shard-counts")
    slots = _unrolled(counts, "n_slots", "own", 4096).select("source", "shard", (F.col("first_slot") + F.col("own")).alias("slot"))
    told = plan.select(F.col("source").alias("p_source"), "source_size", "goal", "n_blocks", "last")
    slots = slots.join(told, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("epoch", F.expr("slot div n_blocks")).withColumn("turn", F.pmod("slot", "n_blocks"))
    key = [F.col("source"), F.col("epoch")]
    slots = slots.withColumn("block", shuffled(F.col("turn"), F.col("n_blocks"), key))
    # Words of the source that come before a slot: whole blocks, less what a short one before it lacks.
    short_at = shuffled(F.col("n_blocks") - 1, F.col("n_blocks"), key, inverse=True)
    lacks = F.when(short_at < F.col("turn"), block_words - F.col("last")).otherwise(F.lit(0))
    before = F.col("epoch") * F.col("source_size") + F.col("turn") * block_words - lacks
    words = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("last")).otherwise(F.lit(block_words))
    uses = slots.select("source", "shard", "slot", "epoch", "block", F.least(words, F.col("goal") - before).cast("bigint").alias("take"))
    return uses, sizes


def _uses_of_documents(uses: DataFrame, sizes: DataFrame, block_words: int) -> DataFrame:
    """sizes' rows, one for each use of each block that a document reaches into, with the words [low, high) of the
    document that are used; one row without use (epoch and shard null, low = high) for a block that no slot has."""
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(f"first div {block_words}"), F.expr(f"(first + size - 1) div {block_words}"))).otherwise(F.array(F.lit(None).cast("bigint")))
    parts = sizes.select("*", F.explode(spans).alias("block"))
    # The slots are unrolled from a small table of sources, so their size is no guide: they are never broadcast.
    by_index = uses.select(F.col("source").alias("u_source"), F.col("block").alias("u_block"), "epoch", "shard", "take").hint("merge")
    joined = parts.join(by_index, F.col("source").eqNullSafe(F.col("u_source")) & (F.col("block") == F.col("u_block")), "left")
    at = F.col("block") * block_words - F.col("first")  # the document's word at which the block begins
    low = F.greatest(at, F.lit(0))
    high = F.greatest(F.least(at + F.coalesce("take", F.lit(0)), F.col("size")), low)
    return joined.withColumn("low", F.coalesce(low, F.lit(0))).withColumn("high", F.coalesce(F.when(F.col("block").isNotNull(), high), F.lit(0)))


def taken(docs: DataFrame, block_words: int = 512, **options) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, taken, first_shard) for each document.

    taken is how many words the mix takes of it, first_shard the first output shard that gets some, null if none does.
    """
    uses, sizes = mix(docs, block_words=block_words, **options)
    keys = ["doc_id", "row_id", "source", "size", "source_size", "target"]
    used = F.col("high") - F.col("low")
    rows = _uses_of_documents(uses, sizes, block_words).groupBy(*keys).agg(F.sum(used).cast("bigint").alias("taken"), F.min(F.when(used > 0, F.col("shard"))).alias("first_shard"))
    return rows.drop("row_id")


def shard_contents(docs: DataFrame, block_words: int = 512, **options) -> DataFrame:
    """One row (source, shard, n_slots, words) for each output shard and source: what the draw gives it."""
    uses, _ = mix(docs, block_words=block_words, **options)
    return uses.groupBy("source", "shard").agg(F.count("*").alias("n_slots"), F.sum("take").alias("words"))


def mixed_documents(docs: DataFrame, block_words: int = 512, shard: str | None = None, **options) -> DataFrame:
    """The mix as documents: docs' columns, one row for each time that the mix uses a document, with the words it uses.

    A text that is used whole stays as it is; of one that is used in part, the words used are joined by single spaces. A
    use belongs to the output shard of the slot that holds its first words; `shard` names a column for its number. Rows are
    joined by their written numbers, so rows that repeat a doc_id keep their own sources and other columns.
    """
    rows = staged(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("own_id")), "numbered")
    uses, sizes = mix(rows.select("row.doc_id", "row.source", "row.text", "own_id"), block_words=block_words, row_id=F.col("own_id"), **options)
    used = _uses_of_documents(uses, sizes, block_words).where("high > low")
    spans = used.groupBy("row_id", "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("low", "high", "shard"))).alias("spans"), F.sum(F.col("high") - F.col("low")).alias("n"))
    spans = spans.select("row_id", "size", "n", "spans").hint("merge")
    both = rows.join(spans, F.col("own_id") == F.col("row_id"))
    words = F.split(F.btrim("row.text", F.lit(" \t\n\x0b\x0c\r")), "[ \\t\\n\\x0B\\f\\r]+", -1)
    some = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))), " ")
    text = F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(some)
    own = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != shard]
    at = F.element_at("spans", 1)["shard"].alias(shard or "shard")
    return both.select(*own, at) if shard else both.select(*own)
