"""One mixture of several sources in target shares, sized in tokens.

Method: a low-discrepancy schedule. Slot k of the mixture takes point k of a Kronecker
sequence with a golden-ratio step through the cumulative weights and so gets its source; slots are ranked
within their source, and the source's stream (its documents in shuffled order, again and again
up to ``max_repeats`` times) is cut into blocks of equally many tokens; slot of rank r takes
block r. Every prefix of the mixture is close to the target shares, and any two runs agree.

A block has ``block`` tokens, whatever the size of the input. Each source has a quota of
tokens; it takes as many blocks as that needs, the last one cut to the quota, and blocks that the
sequence gives it no slot for (it may be a few short) come at the end. So the actual shares are
the target shares to a token.

How long the mixture is: by default as long as it can be with every source exactly at its share
of those that have tokens, ``min over sources of tokens * max_repeats / share``; the scarcest source
then sets the length. With ``total`` it has that many tokens (``total="corpus"``: as many as the
sources have); where a source's repeats run out it gives all it has and the others share the rest
by their weights, which is the nearest to the target shares at that length.

Nothing is gathered: running sums over a source's documents, and ranks over its slots, are
taken in two levels (within hashed buckets or ranges of slots, then over the buckets), so a
source with a third of all rows is no hot group. Sums per source are as many rows as feeds.

Defined results: feeds without tokens have an actual share of 0 and their weight counts only
in the target; documents without tokens, of null or unknown source are in no block; a feed
listed twice counts once (its greatest weight); null weights and repeats count as 0 and 1; an
empty side gives an empty mixture; a ``total`` beyond what the sources have gives all of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.session import checkpoint_dir

#: Tokens of a block.
BLOCK = 1024
#: Buckets of a source's documents, and slots of a range, for two-level running sums.
BUCKETS = 1024
RANGE = 1 << 16
#: The sequence's modulus and step (the odd number next to modulus / golden ratio).
MODULUS = 1 << 31
STEP = int(MODULUS * (math.sqrt(5) - 1) / 2) | 1


def sized(documents: DataFrame, vocabulary: str = tokens.BYTE_BPE_50K, folder: str = tokens.FOLDER) -> DataFrame:
    """doc_id, source, n_tokens of each document of a source; kept as a checkpoint, as later steps read it more than once."""
    checkpoint_dir(documents.sparkSession)
    counted = documents.where(F.col("source").isNotNull()).select("doc_id", "source", tokens.n_ids(F.col("text"), vocabulary, folder).alias("n_tokens"))
    return counted.checkpoint()


def plan(sizes: DataFrame, feeds: DataFrame, total: int | str | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each feed: target share, tokens, quota of the mixture's tokens, limits of its points, blocks, number of slots."""
    own = feeds.where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.max("target_weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("bigint").alias("max_repeats"))
    has = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    both = own.join(has, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    every = Window.partitionBy(F.lit(1))  # as many rows as feeds
    live = (F.col("tokens") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") > 0)
    w = F.when(live, F.col("weight")).otherwise(0.0)
    rows = both.withColumn("target_share", F.try_divide("weight", F.sum("weight").over(every))).withColumn("share", F.coalesce(F.try_divide(w, F.sum(w).over(every)), F.lit(0.0)))
    rows = rows.withColumn("most", F.when(live, F.col("tokens") * F.col("max_repeats")).otherwise(0)).withColumn("reach", F.when(live, F.col("most") / F.col("share")))
    if total is None:
        rows = rows.withColumn("level", F.min("reach").over(every))
    else:
        # filled by shares up to a level; sources whose tokens end below it give all: the level that makes the total
        want = F.sum(F.when(live, F.col("tokens"))).over(every) if total == "corpus" else F.lit(int(total))
        filled = every.orderBy(F.asc_nulls_last("reach"), "source").rowsBetween(Window.unboundedPreceding, -1)
        gone, left = F.coalesce(F.sum("most").over(filled), F.lit(0)), 1 - F.coalesce(F.sum("share").over(filled), F.lit(0.0))
        rows = rows.withColumn("_level", F.when(live, (want - gone) / left))
        # the first source in that order that needn't give all has it; if all must, there is none
        rows = rows.withColumn("level", F.coalesce(F.min(F.when(F.col("_level") <= F.col("reach"), F.struct("reach", "source", "_level"))).over(every)["_level"], F.max("reach").over(every))).drop("_level")
    rows = rows.withColumn("quota", F.when(live, F.least(F.col("most"), F.floor(F.greatest(F.col("level"), F.lit(0.0)) * F.col("share") + 1e-6))).otherwise(0).cast("bigint"))
    rows = rows.withColumn("block", F.lit(block).cast("bigint")).withColumn("blocks", F.ceil(F.col("quota") / F.col("block")).cast("bigint"))
    rows = rows.withColumn("slots", F.coalesce(F.sum("blocks").over(every), F.lit(0)).cast("bigint"))
    upto = F.try_divide(F.sum("quota").over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)).cast("double"), F.sum("quota").over(every).cast("double"))
    rows = rows.withColumn("hi", F.coalesce(F.round(upto * MODULUS), F.lit(0)).cast("bigint"))
    return rows.withColumn("lo", F.coalesce(F.lag("hi").over(every.orderBy("source")), F.lit(0).cast("bigint")))


def slots(plan_rows: DataFrame) -> DataFrame:
    """slot, source, rank (from 0 within the source) of the schedule: each source has exactly the slots that its quota needs."""
    n = plan_rows.agg(F.max("slots").alias("n"))
    ranges = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RANGE).cast("bigint"))).alias("range"))
    # sources of points: the sorted limits ride along as one array of as many entries as feeds
    limits = plan_rows.where("hi > lo").agg(F.array_sort(F.collect_list(F.struct("hi", "source", "blocks"))).alias("limits")).withColumn("_k", F.lit(1))
    spread = ranges.repartition(F.col("range")).withColumn("_k", F.lit(1)).join(limits, "_k").drop("_k")
    each = spread.select("range", "limits", F.explode(F.sequence(F.col("range") * RANGE, F.least((F.col("range") + 1) * RANGE, F.col("n")) - 1)).alias("slot"))
    point = ((F.col("slot") % MODULUS) * STEP + STEP // 2) % MODULUS
    taken = each.withColumn("point", point).withColumn("of", F.get(F.filter("limits", lambda x: x["hi"] > F.col("point")), F.lit(0)))
    taken = taken.select("range", "slot", F.col("of.source").alias("source"), F.col("of.blocks").alias("blocks")).where(F.col("source").isNotNull())
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = taken.groupBy("source", "range").agg(F.count("*").alias("n"))
    starts = counts.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = taken.join(starts, ["source", "range"]).withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("source", "range").orderBy("slot")) - 1)
    # what the sequence leaves a source short of (by its discrepancy, few) comes at the end, in turn
    got = counts.groupBy("source").agg(F.sum("n").alias("got"))
    short = plan_rows.select("source", "blocks", "slots").join(got, "source", "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < F.col("blocks"))
    short = short.withColumn("_first", F.coalesce(F.sum(F.col("blocks") - F.col("got")).over(Window.partitionBy(F.lit(1)).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = short.select("source", "slots", "_first", "got", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("rank"))
    rest = rest.select((F.col("slots") + F.col("_first") + F.col("rank") - F.col("got")).alias("slot"), "source", "rank")
    return ranked.where(F.col("rank") < F.col("blocks")).select("slot", "source", "rank").unionByName(rest)


def positions(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, at, n_tokens: the place of each document's first token in its source's shuffled stream."""
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = sizes.where(F.col("n_tokens") > 0).withColumn("_order", order).withColumn("_bucket", F.pmod(F.shiftright(order, 20), F.lit(BUCKETS)))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, ["source", "_bucket"]).select("doc_id", "source", (F.col("_start") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("at"), "n_tokens")


def mixture(documents: DataFrame, feeds: DataFrame, total: int | str | None = None, block: int = BLOCK, seed: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """slot, source, doc_id, use (from 1), from_token, to_token: the mixture's pieces; ordered by slot and place they are its text.

    A piece is tokens from_token (from 0) to to_token (excluded) of the document."""
    sizes = sized(documents) if sizes is None else sizes
    rows = plan(sizes, feeds, total, block)
    taken = slots(rows)
    limits = rows.where("quota > 0").select("source", "tokens", "block", "quota")
    docs = positions(sizes, seed).join(limits, "source")
    uses = docs.withColumn("use", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / F.col("tokens")).cast("bigint"))))
    first = F.col("at") + F.col("use") * F.col("tokens")
    last = F.least(first + F.col("n_tokens"), F.col("quota"))
    pieces = uses.withColumn("first", first).withColumn("last", last).where(F.col("first") < F.col("last"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / F.col("block")), F.floor((F.col("last") - 1) / F.col("block")))))
    begin = F.greatest(F.col("first"), F.col("rank") * F.col("block")) - F.col("first")
    end = F.least(F.col("last"), (F.col("rank") + 1) * F.col("block")) - F.col("first")
    return pieces.join(taken, ["source", "rank"]).select("slot", "source", "doc_id", (F.col("use") + 1).alias("use"), begin.alias("from_token"), end.alias("to_token"))


def shares(documents: DataFrame, feeds: DataFrame, total: int | str | None = None, block: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """source, target_share, actual_share, mixed_tokens, source_tokens, times_used, max_repeats of each feed: the tokens of the slots it has."""
    sizes = sized(documents) if sizes is None else sizes
    rows = plan(sizes, feeds, total, block)
    in_block = F.least(F.col("block"), F.col("quota") - F.col("rank") * F.col("block"))
    used = slots(rows).join(rows.select("source", "block", "quota"), "source").groupBy("source").agg(F.sum(in_block).alias("n"))
    out = rows.join(used, "source", "left").withColumn("mixed_tokens", F.coalesce(F.col("n"), F.lit(0)))
    actual = F.coalesce(F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0))
    return out.select("source", "target_share", actual.alias("actual_share"), "mixed_tokens", F.col("tokens").alias("source_tokens"), F.coalesce(F.try_divide("mixed_tokens", "tokens"), F.lit(0.0)).alias("times_used"), "max_repeats")


def with_pieces(pieces: DataFrame, documents: DataFrame, vocabulary: str = tokens.BYTE_BPE_50K, folder: str = tokens.FOLDER) -> DataFrame:
    """The mixture with the ids of each piece."""
    ids = tokens.with_ids(documents.select("doc_id", "text"), "text", "_ids", vocabulary, folder).drop("text")
    cut: Column = F.slice("_ids", (F.col("from_token") + 1).cast("int"), (F.col("to_token") - F.col("from_token")).cast("int"))
    return pieces.join(ids, "doc_id").withColumn("ids", cut).drop("_ids")
