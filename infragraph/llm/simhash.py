"""Operator 6, SimHash near-dedup: generalised pigeonhole.

The 64 fingerprint bits are grouped into partitions, correlated bits together. By the general pigeonhole
principle two fingerprints within ``t`` bits agree within ``t_i`` bits in some partition i, for any
thresholds of -1 or more with sum ``t - m + 1``. The thresholds, which may be unequal, come from a dynamic
programme over the candidates and probes that each would cause, estimated on a bounded sample of
fingerprints; so does the number of partitions. Plans differ in cost only: every plan finds every link.

Equal fingerprints are collapsed first. A partition value that more than ``hot`` fingerprints share is not
expanded into pairs: there each fingerprint meets the others at the fingerprints one step from it, since
two are within 2 bits exactly if such steps meet. That is linear in the group and leaves out no link.

The pipeline's stage also links documents by the Jaccard similarity of their shingles, for which a few bits
of a fingerprint are no measure; see ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infragraph.llm.common import in_sample, slices
from infragraph.plans.components import connected_components
from infragraph.plans.lineage import bucketed, discard, stored

BITS = 64


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles in order; a text of fewer words is one shingle, none has none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    last = ends[-n:]
    return np.fromiter((xxhash.xxh64_intdigest(data[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def hashes_fingerprint(hashed: np.ndarray) -> int:
    """The fingerprint of shingle hashes, 0 for none."""
    n = len(hashed)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        bits = np.unpackbits(hashed[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def shingle_fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of a text's word shingles, 0 for a text without words."""
    return hashes_fingerprint(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed long; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = np.array([shingle_fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Part:
    """A partition of the bits and the threshold within it."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of like size: each group grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(axis=0))
    cor = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(cor, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        room = BITS // parts + (p < BITS % parts)
        own = [max(sorted(free), key=lambda b: cor[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < room:
            own.append(max(sorted(free), key=lambda b: cor[b, own].mean()))
            free.discard(own[-1])
        out.append(sorted(own))
    return out


def flips(bits: tuple[int, ...], radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``bits``, as signed longs."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64).view(np.int64)


def _pairs(sample: np.ndarray, bits: list[int], radius: int) -> float:
    """Pairs of the sample that agree within ``radius`` bits of a partition."""
    own = sample & np.uint64(sum(1 << b for b in bits))
    values, counts = np.unique(own, return_counts=True)
    total = float((counts * (counts - 1) // 2).sum())
    for m in flips(tuple(bits), radius)[1:].view(np.uint64):
        at = np.searchsorted(values, values ^ m)
        ok = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == values ^ m)
        total += float((counts[ok] * counts[at[ok]]).sum()) / 2
    return total


def allocate(sample: np.ndarray, total: int, max_bits: int, most_parts: int = 4, probe_cost: float = 2.0) -> list[Part]:
    """The cheapest partitions and thresholds for ``total`` fingerprints, by dynamic programming.

    State: partitions done and thresholds spent; a threshold of -1 leaves its partition out. Cost: probes
    times ``probe_cost`` plus candidate pairs, the sample's pairs scaled to ``total``.
    """
    sample = np.unique(sample.view(np.uint64))
    scale = (total / max(1, len(sample))) ** 2
    best: tuple[float, list[Part]] = (float("inf"), [])
    for m in range(1, min(most_parts, max_bits + 1) + 1):
        groups = group_bits(sample, m)
        spend = max_bits - m + 1
        table: dict[int, tuple[float, list[Part]]] = {0: (0.0, [])}
        for bits in groups:
            cost = {-1: 0.0}
            for t in range(0, max_bits + 1):
                probes = len(list(combinations(bits, t))) + (cost[t - 1] / (probe_cost * total) if t and total else 0)
                if probes > 2500:
                    break
                cost[t] = probe_cost * total * len(flips(tuple(bits), t)) + scale * _pairs(sample, bits, t)
            grown: dict[int, tuple[float, list[Part]]] = {}
            for used, (c, plan) in table.items():
                for t, own in cost.items():
                    new = (c + own, [*plan, Part(tuple(bits), t)])
                    if used + t not in grown or new[0] < grown[used + t][0]:
                        grown[used + t] = new
            table = grown
        if spend in table and table[spend][0] < best[0]:
            best = table[spend]
    return [p for p in best[1] if p.threshold >= 0]


def links(fps: DataFrame, plan: list[Part], max_bits: int = 2, hot: int = 64) -> DataFrame:
    """Rows (a, b) whose components are those of all pairs of distinct fingerprints within ``max_bits``.

    ``max_bits`` is 2 (or 0: no links), as the linear way for hot values needs the midpoint of two
    fingerprints to be one step from both.
    """
    if max_bits not in (0, 2):
        raise ValueError("max_bits is 0 or 2")
    spark = fps.sparkSession
    out = spark.createDataFrame([], "a long, b long")
    if max_bits == 0:
        return out
    keys = [fps.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(p.mask))).alias("key"), "fp") for i, p in enumerate(plan)]
    index = keys[0]
    for k in keys[1:]:
        index = index.unionAll(k)
    size = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).where("n > 1 or part in (%s)" % (",".join(str(i) for i, p in enumerate(plan) if p.threshold) or "-1"))
    size = stored(size, "simhash-keys")
    few, many = size.where(F.col("n") <= hot).select("part", "key"), size.where(F.col("n") > hot).select("part", "key")
    cold = index.join(few, ["part", "key"])
    probes = None
    for i, p in enumerate(plan):
        own = keys[i] if p.threshold == 0 else keys[i].select("part", F.explode(F.array(*[F.lit(int(m)) for m in flips(p.bits, p.threshold)])).alias("m"), "key", "fp").select("part", F.col("key").bitwiseXOR(F.col("m")).alias("key"), "fp")
        probes = own if probes is None else probes.unionAll(own)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = cold.select("part", "key", F.col("fp").alias("a")).join(probes.select("part", "key", F.col("fp").alias("b")), ["part", "key"]).where((F.col("a") < F.col("b")) if all(p.threshold == 0 for p in plan) else (F.col("a") != F.col("b"))).where(near).select("a", "b")
    out = out.unionAll(pairs)
    for i, p in enumerate(plan):
        # fingerprints that probe a hot value: they and its members meet at single steps
        rest = flips(tuple(range(BITS)) if p.threshold else tuple(b for b in range(BITS) if b not in p.bits), 1)
        member = probes.where(F.col("part") == i).join(many.where(F.col("part") == i), ["part", "key"]).select("key", "fp")
        step = member.select("key", "fp", F.explode(F.array(*[F.lit(int(m)) for m in rest])).alias("m")).select("key", "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("mid"))
        least = step.groupBy("key", "mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("key_"), F.col("mid").alias("mid_"), "b")
        out = out.unionAll(step.join(least, (F.col("key") == F.col("key_")) & (F.col("mid") == F.col("mid_"))).where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return out.distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan_for(distinct: DataFrame, n: int, max_bits: int, sample_rows: int) -> list[Part]:
    """The plan for ``n`` distinct fingerprints, from a sample of at most ``sample_rows`` of them."""
    share = min(1.0, 1.2 * sample_rows / max(1, n))
    picked = distinct.where(in_sample(share, "fp", F.lit("plan"))).select("fp").limit(sample_rows)
    return allocate(picked.toArrow()["fp"].to_numpy().astype(np.int64), n, max_bits)


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, sample_rows: int = 20_000, hot: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links, null only if a component has no id at all.
    The sample of at most ``sample_rows`` fingerprints decides the plan's cost, never its result. Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows stay, in one component.
    """
    rows = stored(fingerprints(docs, width, id_col, text_col), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    n = distinct.count()
    plan = plan_for(distinct, n, max_bits, sample_rows)
    found = connected_components(links(distinct.select("fp"), plan, max_bits, hot)) if n > 1 else None
    if found is None:
        least = distinct.select("fp", F.col("doc_id").alias("component_id"))
    else:
        own = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
        low = own.groupBy("component").agg(F.min("doc_id").alias("low"))
        linked = own.join(low, "component").select("fp", "low")
        least = distinct.join(linked, "fp", "left").select("fp", F.coalesce("low", "doc_id").alias("component_id"))
    # written, so that the join of a frequent fingerprint can be split
    return rows.join(stored(least, "simhash-least"), "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(texts: DataFrame, width: int, sample_rows: int, least: int = 8, most: int = 200_000) -> np.ndarray:
    """Sorted hashes of at most ``most`` shingles that ``least`` or more of some ``sample_rows`` texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, width)) for t in part.column(0).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    share = min(1.0, sample_rows / max(1, texts.count()))
    picked = texts.select("text").where(in_sample(share, "text", F.lit("common")))
    often = picked.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(most)
    return np.sort(often.select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def set_name(own: np.ndarray) -> int:
    """A 64-bit hash of a sorted set of hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), 7)


def signature(own: np.ndarray) -> bytes:
    """A bit for each hash of a set, modulo a power of two of four to eight bits a hash (64 at least)."""
    bits = max(64, 1 << (4 * len(own)).bit_length())
    out = np.zeros(bits, bool)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_shared(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """No two sets with these signatures share more: each bit of one alone is a hash that the other has not."""
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


def prefix_rows(texts: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """Rows (row, fp, sid, n, sig, prefix): the fingerprint, a hash of the set of shingles, its size, signature and prefix.

    The prefix holds the first ``n - ceil(n * percent / 100) + 1`` shingles, ``common`` ones last and else by
    hash. Two sets of that Jaccard similarity share a shingle of their prefixes, whatever the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp, sid, size, sig, prefix = [], [], [], [], []
            for t in part.column(1).to_pylist():
                hashed = shingle_hashes(t, width)
                own = np.unique(hashed)
                n = len(own)
                at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
                ranked = own[np.argsort(common[at] == own, kind="stable")] if len(common) else own
                fp.append(hashes_fingerprint(hashed))
                sid.append(set_name(own))
                size.append(n)
                sig.append(signature(own))
                prefix.append(ranked[: n - -(-n * percent // 100) + 1 if n else 0].view(np.int64))
            columns = [part.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["row", "fp", "sid", "n", "sig", "prefix"])

    return texts.mapInArrow(run, "row long, fp long, sid long, n long, sig binary, prefix array<long>")


def _bitmap(slots: DataFrame, n: int) -> np.ndarray:
    """A packed bitmap of ``n`` bits for rows (slot); it is built in tasks, and n / 8 bytes of it reach the driver."""
    found = slots.groupBy(F.shiftright("slot", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(n >> 3, np.uint8)
    for r in found.collect():
        out[r["at"] << 12 : (r["at"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _held(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes, modulo the bitmap's size, have their bit set."""
    at = hashes & np.uint64(len(packed) * 8 - 1)
    return (packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def shingle_sets(texts: DataFrame, some: DataFrame, width: int, shared: np.ndarray | None = None, slots: int = 1 << 22) -> DataFrame:
    """Rows (sid, shingles): the sets of the rows ``some`` names by (row), and a few others, not stored; map-only.

    A bitmap of the wanted rows' hashes spares the texts of most others their hashing. With ``shared``, a bitmap of
    shingles, only those that it may hold are given.
    """
    wanted = _bitmap(some.select(F.pmod("row", F.lit(slots)).alias("slot")), slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(_held(wanted, batch.column(0).to_numpy().view(np.uint64))))
            for part in slices([kept], "text"):
                sets = [np.unique(shingle_hashes(t, width)) for t in part.column(1).to_pylist()]
                names = np.array([set_name(x) for x in sets], np.uint64).view(np.int64)
                if shared is not None:
                    sets = [x[_held(shared, x)] for x in sets]
                yield pa.record_batch([part.column(0), pa.array(names), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["row", "sid", "shingles"])

    return texts.mapInArrow(run, "row long, sid long, shingles array<long>")


def _met(keys: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Rows (sid, shingle, held, pivot, size, hots) of prefix keys (sid, shingle), with their other columns, that several sets hold; ``hots`` counts a set's keys over ``limit``."""
    held = keys.repartition("shingle").distinct().selectExpr(*keys.columns, "count(1) over (partition by shingle) as held", "min(sid) over (partition by shingle) as pivot").where("held > 1")
    seen = stored(held, "shingle-met", "zstd")
    met = stored(seen.join(sets.select("sid", "size"), "sid").withColumn("hots", F.expr(f"count_if(held > {limit}) over (partition by sid)")), "shingle-keys", "zstd")
    discard(seen)
    return met


def _candidates(met: DataFrame, limit: int, percent: int) -> DataFrame:
    """Pairs (a, b, shared) that meet at keys of up to ``limit`` sets and share enough of them, with all that may follow."""
    cold = met.where(F.col("held") <= limit)
    fits = f"least(size_a, size_b) * 100 >= greatest(size_a, size_b) * {percent}"
    left, right = cold.selectExpr("shingle", "sid as a", "size as size_a", "hots as hots_a"), cold.selectExpr("shingle", "sid as b", "size as size_b", "hots as hots_b")
    shared = left.join(right, "shingle").where("a < b").where(fits).groupBy("a", "b", "size_a", "size_b", "hots_a", "hots_b").agg(F.count(F.lit(1)).alias("shared"))
    most = f"shared + least(hots_a, hots_b) + (greatest(size_a, size_b) * {percent} + 99) div 100 - 1"
    return shared.where(f"({most}) * {100 + percent} >= (size_a + size_b) * {percent}").select("a", "b", "shared")


def _rarer_prefixes(met: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int, often: int) -> DataFrame:
    """Keys (sid, shingle, rest) of the sets with a key of more than ``often`` sets: prefixes in the order of how many of these sets hold a shingle.

    A shingle that one set alone holds comes first and meets nobody, so it is only counted. What remains of a prefix, if
    anything does, are its rarest shared shingles; ``rest`` counts a set's shingles from the key on.
    """
    some = stored(met.where(F.col("held") > often).select("sid").distinct().join(sets.select("sid", "row"), "sid"), "shingle-often")

    def each(shared: np.ndarray | None) -> DataFrame:
        # a set that several rows have, or that the bitmap let through, may count more than once: a shingle is then
        # taken for less rare than it is, by all alike
        return shingle_sets(texts, some, width, shared).select("sid", F.explode("shingles").alias("shingle"))

    df = stored(each(None).groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shingle-df", "zstd")
    # of all shingles only those that may be shared are dealt again; the join can split one that very many sets hold
    bits = 1 << 26
    held = each(_bitmap(df.select(F.pmod("shingle", F.lit(bits)).alias("slot")), bits)).join(df, "shingle")
    listed = held.groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("k"))
    room = F.col("size") - F.expr(f"(size * {percent} + 99) div 100") + 1 - (F.col("size") - F.size("k"))
    ranked = listed.join(sets.select("sid", "size"), "sid").withColumn("room", room.cast("int")).where("room > 0")
    keys = stored(ranked.select("sid", F.size("k").alias("shared"), F.posexplode(F.slice("k", F.lit(1), F.col("room"))).alias("at", "k")).select("sid", "k.shingle", (F.col("shared") - F.col("at")).alias("rest")), "shingle-rare", "zstd")
    discard(some, df)
    return keys


def _ring_pairs(ring: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets at a pivot's key, not both linked to it, of rows (shingle, sid, size, rest, away, linked).

    A pair that is linked shares nothing before its first common key, so what the smaller set has from there on is at
    least what two sets of its size must share. Sets that share a passage, but have too much of their own before
    it, are no smaller one of any pair, which keeps them from meeting each other.
    """
    x = ring.selectExpr("shingle", "sid as u", "size as size_a", "rest as rest_a", "away as away_u", "linked as linked_u")
    y = ring.where(f"rest * {100 + percent} >= 2 * size * {percent}").selectExpr("shingle", "sid as v", "size as size_b", "rest as rest_b", "away as away_v", "linked as linked_v")
    fits = f"size_b <= size_a and size_b * 100 >= size_a * {percent} and least(rest_a, rest_b) * {100 + percent} >= (size_a + size_b) * {percent}"
    close = f"abs(away_u - away_v) <= {100 - percent} / 100 + 1e-9"
    return x.join(y, "shingle").where("u <> v and not (linked_u and linked_v)").where(fits).where(close).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def set_components(marked: DataFrame, texts: DataFrame, known: DataFrame, width: int, percent: int, hot: int = 64, often: int = 8) -> DataFrame:
    """Rows (node, component), stored: the components of ``known`` links and all pairs of sets with a Jaccard
    similarity of ``percent``; a set without a link has no row.

    ``marked`` is from ``prefix_rows`` of ``texts``. A pair is a candidate if its prefixes meet, what they share,
    with all that may follow in the larger set, suffices, and their signatures do not rule it out. First each
    set is measured against the candidate that shares most with it; then only candidates that are not yet in
    one component are. Links found then join components, so only these are looked at again.

    Shingles of a passage that many texts share are in prefixes by chance, and would make all these texts meet. So keys of
    more than ``often`` sets make no pairs: both sets of a pair that only meets there have such a key, and all sets
    that have one get a second prefix, in the order of how rare their shingles are among them, where the pair meets
    again. Texts that share less than four fifths have other, rarer shingles in these prefixes and do not meet.

    A key in more than ``hot`` second prefixes, as in large groups of near copies, is not expanded into pairs: its sets
    are measured against one of them, the pivot. Those near the pivot are linked through it; the others meet only sets
    whose distance from the pivot differs from theirs by no more than a link's, as Jaccard distance is a metric, and
    with which they can still share enough from that key on. That leaves out no component.
    """
    sets = stored(marked.groupBy("sid").agg(F.min("row").alias("row"), F.first("n").alias("size"), F.first("sig").alias("sig")), "shingle-sets", "zstd")
    plain = _met(marked.select("sid", F.explode("prefix").alias("shingle")), sets, often)
    rare = _rarer_prefixes(plain, sets, texts, width, percent, often)
    met = _met(rare, sets, hot)
    warm = met.where((F.col("held") > hot) & (F.col("sid") != F.col("pivot")))
    shared = _candidates(plain, often, percent).unionAll(_candidates(met, hot, percent)).groupBy("a", "b").agg(F.max("shared").alias("shared"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("sig_a", "sig_b", "size_a", "size_b"))
            keep = [most_shared(*r) * (100 + percent) >= (r[2] + r[3]) * percent for r in zip(a, b, x, y, strict=True)]
            yield batch.select(["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))

    def not_ruled_out(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, shared) whose signatures leave room for a link."""
        signed = pairs.join(sets.selectExpr("sid as a", "size as size_a", "sig as sig_a"), "a").join(sets.selectExpr("sid as b", "size as size_b", "sig as sig_b"), "b")
        return signed.select("a", "b", "shared", "size_a", "size_b", "sig_a", "sig_b").mapInArrow(possible, "a long, b long, shared long")

    pairs = stored(not_ruled_out(shared), "shingle-pairs")
    discard(plain, rare)
    rays = warm.select(F.col("pivot").alias("a"), F.col("sid").alias("b"))
    some = pairs.select("a", "b").unionAll(rays).select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "row"), "sid")
    some = stored(some, "shingle-some")
    # texts that repeat have one set
    own = bucketed(shingle_sets(texts, some, width).groupBy("sid").agg(F.first("shingles").alias("shingles")), "sid", "shingle_sets")
    discard(some)

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        joined = pairs.join(own.selectExpr("sid as b", "shingles as y").hint("merge"), "b").join(own.selectExpr("sid as a", "shingles as x").hint("merge"), "a")
        both = joined.selectExpr("a", "b", "size(x) + size(y) as total", "size(array_intersect(x, y)) as same")
        out = stored(both.selectExpr("a", "b", "same", "total - same as whole"), f"shingle-{name}")
        return out

    near = f"same * 100 >= whole * {percent}"
    first = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    found = measured(first.unionAll(rays).distinct(), "first")
    component = stored(connected_components(known.unionAll(found.where(near).select("a", "b"))), "shingle-components")
    # a set without a link is its own component
    roots = lambda pairs: pairs.join(component.selectExpr("node as a", "component as ca"), "a", "left").join(component.selectExpr("node as b", "component as cb"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs that no link found so far connects."""
        return roots(pairs).where("ca <> cb").select("a", "b")

    away = found.selectExpr("a as pivot", "b as sid", "1 - same / whole as away", f"{near} as linked")
    ring = stored(warm.select("shingle", "pivot", "sid", "size", "rest").join(away, ["pivot", "sid"]), "shingle-rings", "zstd")
    across = stored(not_ruled_out(apart(_ring_pairs(ring, percent)).distinct().withColumn("shared", F.lit(0).cast("long"))).select("a", "b"), "shingle-across")
    rest = stored(apart(pairs).unionAll(across).distinct().join(found.select("a", "b"), ["a", "b"], "left_anti"), "shingle-rest")
    out = component
    if not rest.isEmpty():
        second = measured(rest, "second")
        top = connected_components(roots(second.where(near).select("a", "b")).select("ca", "cb"), "ca", "cb")
        moved = component.join(top.selectExpr("node as component", "component as top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        out = stored(moved.unionByName(top).distinct(), "shingle-joined")
        discard(second, component)
    discard(met, pairs, own, found, ring, across, rest, sets)
    return out


def keep_first(docs: DataFrame, width: int = 5, max_bits: int = 2, percent: int = 80, sample_rows: int = 20_000, common_rows: int = 4000, hot: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Two documents are linked if their fingerprints are within ``max_bits``, or if their sets of ``width``-word
    shingles have a Jaccard similarity of ``percent`` hundredths or more. Every such link is found: fingerprints
    by the generalised pigeonhole; for the others, prefixes of the sets meet, and pairs that meet are measured on
    the whole sets. The samples decide costs only.

    Rows that share an id but not a text are documents of their own; of those in one group the one with the
    smallest hash of its text stays. A null id stands for the text's hash.
    """
    key = F.coalesce(F.col(id_col).cast("long"), -F.lit(1) - F.pmod(F.xxhash64(text_col), F.lit(1 << 62)))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = whole.select("doc", "key", F.xxhash64("key", "text").alias("row"), "text")
    texts = rows.select("row", "text")
    marked = stored(prefix_rows(texts, width, percent, common_shingles(texts, width, common_rows)), "simhash-rows", "zstd")
    # a fingerprint's node is the least of its sets
    fps = stored(marked.groupBy("fp").agg(F.min("sid").alias("node")), "simhash-distinct")
    edges = marked.select("fp", "sid").join(fps, "fp").where("sid <> node").selectExpr("sid as a", "node as b")
    n = fps.count()
    if n > 1:
        close = links(fps.select("fp"), plan_for(fps, n, max_bits, sample_rows), max_bits, hot)
        a, b = fps.selectExpr("fp as a", "node as u"), fps.selectExpr("fp as b", "node as v")
        edges = edges.unionAll(close.join(a, "a").join(b, "b").selectExpr("u as a", "v as b"))
    known = stored(edges, "simhash-edges")
    found = set_components(marked, texts, known, width, percent, hot)
    of_row = marked.select("row", "sid").distinct().join(found.withColumnRenamed("node", "sid"), "sid", "left").select("row", F.coalesce("component", "sid").alias("component"))
    first = of_row.join(rows.select("key", "row").distinct(), "row").groupBy("component").agg(F.min(F.struct("key", "row")).alias("first")).select("first.*")
    first = stored(first, "simhash-first")
    discard(marked, fps, known, found)
    # rows equal in id and text: the one with the smallest hash of its other columns
    rest = F.xxhash64(*[F.col("doc")[f.name] for f in docs.schema if f.name != text_col and f.dataType.typeName() not in ("map", "variant")])
    return rows.join(first, ["key", "row"], "left_semi").groupBy("key", "row").agg(F.min_by("doc", rest).alias("doc")).select("doc.*")
