"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of about ``BLOCKS`` equal blocks of words, for any size of corpus. Each source has a target: its weighted share of all
words, but at most ``MAX_EPOCHS`` times its own size; what it cannot take is shared anew among the others by weight. The blocks go to
the sources, and within a source to its shards, one by one to the highest quotient votes / (2 * blocks so far + 1). A shard whose quota
is ``q`` takes each of its ``b`` blocks ``q div b`` times and ``q mod b`` of them, evenly spread from a seeded offset, once more.
The documents of a shard lie in a seeded order, so which words a block holds is seeded too. All seeds are digests of ids: reruns agree.

Sources are ordered by code point, null last, and take the weights in turn. Null and empty texts have no words and take none. Ties of
quotients go to the earlier source or shard. Repeated rows lie side by side and are taken as rows of their own. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import text_of, whole_rows, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCKS = 1 << 20
#: Each source is dealt out into so many shards, so that a source with a third of all rows lies in as many groups.
SHARDS = 64
SEED = "mix"


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` and the number ``place`` per source. One row per source: the windows without a key run over sources, not documents.

    Sources are sorted by how many words they have per weight. One stops at its limit if the share that the sources before it left,
    divided by the weight that is left, reaches its limit per weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    leveled = placed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("full"), F.struct((-F.col("cap") / F.col("weight")).alias("o"), (-F.col("place")).alias("p"), "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(final * F.col("weight"))
    return leveled.withColumn("target", target).select("source", "place", "source_size", "target")


def apportion(parties: DataFrame, seats: str, votes: str, room: str, within: list[str], order: str, into: str) -> DataFrame:
    """Sainte-Laguë quotas of ``seats`` among the parties of a group, no party above its ``room``.

    Only the quotients near the proportional share can decide: with ``m`` parties no quota is further than ``m / 2`` from it, but for the
    seats that full parties leave to others. So the seats below that are given at once and the rest goes to the highest quotients.
    """
    group = Window.partitionBy(*within)
    m = F.count("*").over(group)
    share = F.coalesce(F.try_divide(F.col(seats) * F.col(votes), F.sum(votes).over(group)), F.lit(0.0))
    sure = F.greatest(F.lit(0), F.least(F.col(room), F.floor(share) - F.floor(m / 2) - 1)).cast("long")
    near = parties.withColumn("_m", m).withColumn("_sure", F.when(F.col(votes) > 0, sure).otherwise(0))
    near = near.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    near = near.withColumn("_over", F.sum(F.greatest(F.ceil(share) - F.col(room), F.lit(0))).over(group).cast("long"))
    more = F.least(F.col("_left"), F.col("_m") + 4 + F.col("_over"), F.col(room) - F.col("_sure"))
    contest = near.withColumn("_more", F.when(F.col(votes) > 0, F.greatest(more, F.lit(0))).otherwise(0))
    bids = contest.select("*", F.explode(F.when(F.col("_more") > 0, F.sequence(F.lit(0).cast("long"), F.col("_more") - 1))).alias("_k"))
    quotient = F.col(votes) / (2 * (F.col("_sure") + F.col("_k")) + 1)
    won = bids.withColumn("_rank", F.row_number().over(group.orderBy(quotient.desc(), order))).filter("_rank <= _left")
    keys = [*within, order]
    extra = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    joined = near.alias("p").join(extra.alias("e"), [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys], "left")
    return joined.select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(into))


def _chosen_before(x: Column, size: Column, block: Column, n: Column, quota: Column, offset: Column) -> Column:
    """Words taken among the first ``x`` of a shard of ``n`` blocks: whole rounds, and the evenly spread blocks of the last round."""
    rounds, rest = F.floor(quota / n), quota % n
    before = lambda j: F.floor((j + offset) * rest / n) - F.floor(offset * rest / n)
    j = F.floor(x / block)
    inside = (before(j + 1) - before(j)) * (x - j * block)
    return (rounds * x + before(j) * block + inside).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        blocks: int = BLOCKS, shards: int = SHARDS, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """Each row (its columns ``keep``) as ``row`` with ``size``, ``source_size``, ``target``, ``taken`` and its ``digest``.

    The words are counted twice, once for the sizes of the shards, which are written as a row per source and shard, and once where a
    running sum per shard places the documents.
    """
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("digest")
    narrow = [F.col(source).alias("source"), F.size(words_of(text_of(text))).cast("long").alias("size"), digest]
    shard = (_number(F.col("digest")) % shards).cast("int")
    rows = whole_rows(docs, *narrow, keep=keep).withColumn("shard", shard)
    shard_sizes = docs.select(*narrow).withColumn("shard", shard).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shard_sizes = materialize(shard_sizes)
    sizes = shard_sizes.groupBy("source").agg(F.sum("shard_size").alias("source_size"))
    sources = targets(sizes, weights, max_epochs)
    everything = Window.partitionBy(F.lit(0))
    block = F.greatest(F.ceil(F.sum("source_size").over(everything) / blocks), F.lit(1))
    sources = sources.withColumn("block", block.cast("long"))
    seats = F.floor(F.sum("target").over(everything) / F.col("block") + 0.5)
    sources = sources.withColumn("seats", seats.cast("long")).withColumn("all", F.lit(0))
    # What a source holds at most follows from its blocks, counted per shard below; its own limit is already in the target.
    sources = sources.withColumn("room", F.ceil(F.col("source_size") * max_epochs / F.col("block")).cast("long"))
    sources = apportion(sources, "seats", "target", "room", ["all"], "place", "quota")
    named = sources.select(F.col("source").alias("of"), "place", "source_size", "target", "block", F.col("quota").alias("source_quota"))
    parties = shard_sizes.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parties = parties.withColumn("n", F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1)).cast("long"))
    parties = parties.withColumn("room", F.when(F.col("shard_size") > 0, F.col("n") * max_epochs).otherwise(0))
    quotas = apportion(parties, "source_quota", "shard_size", "room", ["place"], "shard", "quota")
    quotas = quotas.select(F.col("source").alias("of"), F.col("shard").alias("of_shard"), "source_size", "target", "block", "n", "quota", "place")
    # Sources are told apart by two columns without nulls, so that the join finds the rows dealt out as the window has them: texts are moved once.
    none, name = (lambda c: F.col(c).isNull()), (lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = rows.withColumn("none", none("source")).withColumn("name", name("source"))
    quotas = quotas.withColumn("of_none", none("of")).withColumn("of_name", name("of"))
    upto = Window.partitionBy("none", "name", "shard").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("size").over(upto))
    joined = placed.join(quotas, (F.col("none") == F.col("of_none")) & (F.col("name") == F.col("of_name")) & (F.col("shard") == F.col("of_shard")))
    offset = _number(F.md5(F.concat_ws(":", F.lit(seed), "place", "shard"))) % F.col("n")
    at = lambda x: _chosen_before(x, F.col("size"), F.col("block"), F.col("n"), F.col("quota"), F.col("offset"))
    taken = at(F.col("end")) - at(F.col("end") - F.col("size"))
    return joined.withColumn("offset", offset).select("row", "size", "source_size", "target", taken.alias("taken"), "digest")


def mixed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents as often as the mix takes them: whole texts, the last part of one rounded up with a seeded chance equal to it."""
    chance = _number(F.md5(F.concat(F.lit("copy:"), F.col("digest")))) / F.lit(float(1 << 32))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(0).cast("int")
    taken = mix(docs, key=key).select("row", copies.alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
