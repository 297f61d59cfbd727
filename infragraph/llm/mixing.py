"""Operator 9, mixing sources to target weights, in DataFrame functions only.

The words of each source form one stream, its documents in a pseudorandom order, packed into blocks of
``block_words``. The mix is a row of output shards of equal numbers of slots. In each shard the slots' sources
are a multinomial draw with the targets as probabilities. Slots that a source draws beyond its target are
drawn again: they go, in pseudorandom order, to the sources that are short, so that each source ends with the
slots its target needs. The k-th slot of a source takes block ``perm(k mod blocks)`` of its stream, with a
new permutation for each pass over the stream (swap-or-not rounds: a bijection on any range, computed row by
row), and blocks meet slots by an equi-join on (source, block). Every draw is a hash of the seed and the
indices, so reruns agree.

Running numbers inside a source are two-level prefix sums over hash buckets, as a source may hold a third
of all rows: no window holds more than a bucket, or one row for each bucket. Only the targets' own windows
hold a row for each source.

Defined results: a null text has size 0 and a document of size 0 is never taken; a null source is a source
of its own, last in order; rows may repeat, and equal rows are taken as separate documents; an empty table
gives an empty result. A source's words taken differ from its target by less than two blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.llm.common import word_count
from infragraph.plans.lineage import discard, stored

UNIT = 1 << 53


def unit(*cols: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(UNIT))


def permuted(index: str, size: str, keys: list[str], seed: int, rounds: int = 12) -> Column:
    """``index`` under a pseudorandom bijection of 0 .. size - 1, by swap-or-not rounds keyed by ``keys``."""
    k = ", ".join(keys)
    return F.expr(
        f"aggregate(sequence(1, {rounds}), cast({index} as bigint), (x, r) -> "
        f"aggregate(array(pmod(pmod(xxhash64({seed}, {k}, r), {size}) - x, {size})), x, (y, p) -> "
        f"if((xxhash64({seed}, {k}, r, greatest(y, p)) & 1) = 1, p, y)))"
    )


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the group's earlier rows, by bucket and then ``order``."""
    keys = ", ".join(group)
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("held_"))
    base = sums.selectExpr(*group, bucket, f"sum(held_) over (partition by {keys} order by {bucket}) - held_ as base_")
    inner = df.selectExpr("*", f"sum({value}) over (partition by {keys}, {bucket} order by {', '.join(order)} rows unbounded preceding) - {value} as in_")
    return inner.join(base, [*group, bucket]).withColumn(out, F.col("base_") + F.col("in_")).drop("base_", "in_")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Rows (source, sk, source_size, target) from rows (source, source_size), one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A
    target stops at ``cap`` times its source's size and the excess goes to the others by weight: with the
    sources by rising cap per weight, all before the first whose cap exceeds the even level are capped.
    """
    ranked = sizes.selectExpr("source", "source_size", "row_number() over (order by source asc nulls last) as sk")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sk") - 1) % len(weights) + 1).cast("int"))
    a = ranked.withColumn("w", w).withColumn("cap", F.lit(cap) * F.col("source_size"))
    order = "over (order by cap / w, sk rows between unbounded preceding and current row)"
    b = a.selectExpr("*", f"sum(cap) {order} - cap as capped", f"sum(w) over () - sum(w) {order} + w as open", f"{share} * sum(source_size) over () as goal")
    c = b.withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open"))
    d = c.selectExpr("*", "max(if(level <= cap / w, level, null)) over () as final")
    return d.select("source", F.col("sk").cast("int").alias("sk"), "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), "cap").cast("double").alias("target"))


@dataclass
class Mix:
    """``placed``: the documents with their place in their source's stream; ``slots``: the mix, one row a slot."""

    placed: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int

    def taken(self) -> DataFrame:
        """``placed`` with ``taken``: the words that the mix takes of each document, repeats counted."""
        b = self.block_words
        uses = self.slots.groupBy("sk", "block").agg(F.count(F.lit(1)).alias("uses"))
        parts = self.placed.where("size > 0").selectExpr("sk", "off", "size", f"explode(sequence(off div {b}, (off + size - 1) div {b})) as block")
        words = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("off"), F.col("block") * b)
        got = parts.withColumn("words", words).join(uses, ["sk", "block"]).groupBy("sk", "off").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        got = got.withColumnRenamed("off", "at")
        return self.placed.withColumn("at", F.when(F.col("size") > 0, F.col("off"))).join(got, ["sk", "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("at")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, block_words: int = 32, shard_slots: int = 1024, seed: int = 9, bucket_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of all documents; see the module's text.

    A target of at most ``cap`` times a source's size needs at most ``cap`` passes over its stream, so no
    document is taken more than ``cap`` times.
    """
    sized = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h")),
        "mix-sizes",
    )
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("blocks", F.expr(f"cast(ceil(source_size / {block_words}) as bigint)"))
    # the last block of a stream is short: a slot holds source_size / blocks words on average
    sources = stored(sources.withColumn("wanted", F.expr("if(blocks = 0, 0L, cast(round(target * blocks / source_size) as bigint))")), "mix-sources")
    n = sized.count()
    right = sources.select(F.col("source").alias("source_"), "sk", "source_size", "target")
    placed = sized.join(right, sized["source"].eqNullSafe(right["source_"])).drop("source_").withColumn("bucket", F.pmod(F.col("h"), F.lit(max(1, math.ceil(n / bucket_rows)))))
    placed = stored(running(placed, ["sk"], "bucket", ["h", "doc_id"], "size", "off").drop("bucket"), "mix-placed")
    discard(sized)
    return Mix(placed, sources, _slots(sources, shard_slots, seed), block_words)


def _slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """Rows (shard, sk, pass, block): ``wanted`` slots of each source."""
    spark = sources.sparkSession
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("wanted"), F.lit(0))).first()
    # a draw looks for its source among those that its cell of the unit interval meets
    cells = 1 << max(10, (4 * n).bit_length())
    upto = sources.where("wanted > 0").selectExpr("sk", f"sum(wanted) over (order by sk) / {max(1, total)}D as hi", f"(sum(wanted) over (order by sk) - wanted) / {max(1, total)}D as lo")
    cell = upto.selectExpr("sk", "lo", "hi", f"explode(sequence(cast(floor(lo * {cells}) as int), least({cells - 1}, cast(floor(hi * {cells}) as int)))) as cell")
    draws = spark.range(total).selectExpr(f"id div {shard_slots} as shard", f"id % {shard_slots} as j").withColumn("u", unit(F.lit(seed), F.col("shard"), F.col("j"))).withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    drawn = draws.join(cell, "cell").where("lo <= u and u < hi").groupBy("sk", "shard").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(running(drawn.withColumn("bucket", F.expr("shard div 256")), ["sk"], "bucket", ["shard"], "n", "first").select("sk", "shard", "first", "n"), "mix-drawn")
    got = sources.join(counted.groupBy("sk").agg(F.sum("n").alias("got")), "sk", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = stored(got.selectExpr("sk", "blocks", "wanted", "got", "sum(greatest(got - wanted, 0)) over (order by sk) - greatest(got - wanted, 0) as over_", "sum(greatest(wanted - got, 0)) over (order by sk) - greatest(wanted - got, 0) as short_"), "mix-got")
    beyond = int(got.agg(F.coalesce(F.sum(F.greatest(F.col("got") - F.col("wanted"), F.lit(0))), F.lit(0))).first()[0])
    # few rows make many slots, which the number of partitions spreads
    spread = counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).join(got, "sk").selectExpr("*", "explode(sequence(first, first + n - 1)) as k")
    kept = spread.where("k < wanted").select("shard", "sk", "blocks", "k")
    again = spread.where("k >= wanted").selectExpr("shard", "over_ + k - wanted as e", f"{max(1, beyond)}L as size").select("shard", permuted("e", "size", ["size"], seed).alias("at"))
    open_ = got.where("wanted > got").selectExpr("sk", "blocks", "got", "short_", "explode(sequence(0, wanted - got - 1)) as i").selectExpr("sk", "blocks", "got + i as k", "short_ + i as at")
    slots = kept.unionByName(again.join(open_, "at").select("shard", "sk", "blocks", "k")).selectExpr("shard", "sk", "blocks", "k div blocks as pass", "k % blocks as i")
    return slots.select("shard", "sk", "pass", permuted("i", "blocks", ["sk", "pass"], seed).alias("block"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken)."""
    return mix_sources(docs, **options).taken().select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, same columns.

    A document taken ``t`` words of its ``size`` comes floor(t / size) times, and once more with the
    probability of the remainder, by a hash of the seed and the row; equal rows share their words evenly.
    """
    mix = mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, **options)
    of_row = stored(mix.taken().where("size > 0").groupBy("h").agg((F.sum("taken") / F.sum("size")).alias("times")), "mix-times")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    copies = F.floor("times") + (unit(F.lit(seed), F.col("h"), F.lit("copies")) < F.col("times") - F.floor("times")).cast("long")
    out = rows.join(of_row, "h").withColumn("copies", copies).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
