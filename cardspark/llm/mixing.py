"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 64  # words a block
SHARD = 1_000_000  # words a shard, about
SEED = 7


def number_of_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _draw(*parts: Column) -> Column:
    """32 seeded bits, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, weight, target.

    Sources by code point, null last, weigh `weights`, repeating. Their targets share the sum of all sizes by weight; one
    stops at max_repeat times its source's size, its excess is shared by weight among the others, until none is above.
    In order of size/weight the capped sources come first, so running sums settle the level at which the rest stand.
    """
    one = F.lit(0)
    order = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("weight", F.element_at(w, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * float(max_repeat))
    fill = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(one)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(total)["level"]
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight"))).select("source", "source_size", "weight", "target")


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, key: str, out: str) -> DataFrame:
    """Adds `out`: seats of each party by the highest quotients votes / (2k + 1), within each group.

    A party's seats differ from its exact share by less than 2 + share * parties / 2, so only quotients that near are
    listed (about five a party and group); those further up are sure. Ties go to more votes, then the smaller key.
    """
    g = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    rows = parties.withColumn("_sum", F.sum(votes).over(g)).withColumn("_n", F.count("*").over(g))
    share = F.when(F.col("_sum") > 0, F.col(votes) / F.col("_sum")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_half", (F.ceil(share * F.col("_n") / 2) + 2)).withColumn("_base", F.greatest(F.lit(0), F.floor(share * F.col(seats)) - F.col("_half")))
    rows = rows.withColumn("_more", F.col(seats) - F.sum("_base").over(g))
    lists = rows.withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_base") + 2 * F.col("_half"))))
    best = g.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(votes).desc(), F.col(key).asc_nulls_last(), "_k")
    won = ((F.row_number().over(best) <= F.col("_more")) & (F.col(votes) > 0)).cast("long")
    return lists.withColumn("_won", won).groupBy(*[F.col(c) for c in parties.columns]).agg((F.min("_base") + F.sum("_won")).alias(out))


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, shard_words: int = SHARD) -> DataFrame:
    """Of docs(doc_id, text, source): doc_id, _h (hash of the text), _s (source), size, source_size, target, taken; a row per row.

    Each source's target becomes whole blocks of `block` words (Sainte-Laguë over sources), and its blocks whole quotas of
    its shards (Sainte-Laguë over shards, a shard being about shard_words words of documents drawn by a seeded hash). In a
    shard, documents stand in seeded order and the quota's blocks are laid from its start, round and round: full rounds
    repeat every document, the last one ends inside a document. Quotas stop at max_repeat rounds, so no document exceeds
    max_repeat times its size. Null and empty texts have size 0 and nothing is taken; a null source is a source, the last;
    a null doc_id draws as an empty one; repeated rows each count; no rows give no rows. Texts are not moved, and only
    sums of sources or shards meet in one window, beside the documents of one shard.
    """
    rows = docs.select("doc_id", number_of_words(F.col("text")).alias("size"), F.col("source").cast("string").alias("_s"), F.xxhash64("text").alias("_h"))
    sizes = rows.groupBy(F.col("_s").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, max_repeat).withColumn("seats_all", F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    plan = sainte_lague(plan, [], "target", "seats_all", "source", "blocks").withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    plan = plan.select(F.col("source").alias("_ps"), "source_size", "target", "blocks", "n_shards")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.join(plan, F.col("_s").eqNullSafe(F.col("_ps"))).drop("_ps").withColumn("_shard", _draw(F.lit("shard"), id_) % F.col("n_shards"))
    quotas = rows.groupBy("_s", "source_size", "blocks", "_shard").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(quotas, ["_s"], "shard_size", "blocks", "_shard", "quota")
    quotas = quotas.select(F.col("_s").alias("_qs"), F.col("_shard").alias("_qn"), "shard_size", F.least(F.col("quota") * block, F.col("shard_size") * max_repeat).alias("words"))
    rows = rows.join(quotas, F.col("_s").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qn")))
    order = Window.partitionBy("_s", "_shard").orderBy(_draw(F.lit("order"), id_), "doc_id", "_h")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("words") - rounds * F.col("shard_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "_h", "_s", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """All columns of docs plus `_taken`, the words that shares() takes of the row; only here texts are shuffled, once.

    Rows of one doc_id, text and source share what was taken of them in the order of all their columns, so that a task that
    runs again pairs them alike.
    """
    same = Window.partitionBy("d", "h", "s")
    part = shares(docs, **how).select(F.col("doc_id").alias("d"), F.col("_h").alias("h"), F.col("_s").alias("s"), "taken")
    part = part.withColumn("n", F.row_number().over(same.orderBy("taken"))).toDF("pd", "ph", "ps", "taken", "pn")
    base = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("source").cast("string").alias("s"), F.xxhash64(*docs.columns).alias("o"))
    base = base.withColumn("n", F.row_number().over(same.orderBy("o")))
    on = F.col("d").eqNullSafe(F.col("pd")) & (F.col("h") == F.col("ph")) & F.col("s").eqNullSafe(F.col("ps")) & (F.col("n") == F.col("pn"))
    return base.join(part, on).select("row.*", F.col("taken").alias("_taken"))
