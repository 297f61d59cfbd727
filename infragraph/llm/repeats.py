"""Operator 7, suffix-array dedup: bytes covered by a long string that starts earlier are removed.

Equal strings must meet in one shard, wherever they are. Each window of ``width`` bytes chooses an anchor,
the place in it whose ``gram`` bytes have the least hash; equal windows choose equal anchors. Windows next
to each other mostly share one, so a text is cut into segments, each a run of windows of one anchor hash. An
anchor whose hash is nowhere else cannot hold a repeated window and is dropped; this filter is exact. The
segments of the rest are dealt by anchor hash, and each task goes through its segments in hash order, a few
megabytes at a time: it builds their suffix array by induced sorting and the permuted common prefixes, and
marks each window that has an equal one earlier; equal segments of a shard are collapsed before.

Texts that repeat wholly lose all their bytes but in the first copy and are not cut into segments. Texts are
written once, in buckets of their id; segments are cut and marks applied there.

A frequent anchor (a passage or phrase that a large share of all documents holds) is known from a bounded
sample, or else from its count. Its segments are first dealt by hash and a salt: every part marks what it
repeats itself, and only windows that are the first of their part go on, dealt by a second anchor as well,
as the surroundings of a frequent phrase differ. The sample decides where rows go, never a result.

Defined results: null is the empty text; texts shorter than ``width`` lose nothing; a null id comes before
all others; rows that share an id are ordered by the SHA-256 of their texts, and rows that repeat wholly are
one document, each of them with that document's result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infragraph.llm.common import in_sample, slices
from infragraph.llm.suffix_array import Shard, repeated_windows
from infragraph.plans.lineage import bucketed, stored

PRIME = np.uint64(0xD1342543DE82EF95)
PLACE = 28  # bits of a place in a piece
PIECE = 1 << 20  # bytes of text whose windows are looked at together
RUN = 250  # windows of a segment at most
SALT = 52  # bits of a packed place; a salt of up to SALTS lies above
SALTS = 2000


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on, by sums of powers modulo 2^64."""
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, PRIME)].astype(np.uint64))
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(PRIME), -1, 2**64)))].astype(np.uint64))
        value = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.r_[np.uint64(0), np.cumsum(value[data] * power[:n])].astype(np.uint64)
        z = (total[gram:] - total[:-gram]) * inverse[: n - gram + 1]
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima within blocks in both directions."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.append(x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], width: int, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: text number, anchor hash, and packed place of each run of windows with one anchor hash.

    A packed place holds the first window, the number of windows and how far the anchor lies behind it. A run
    with two or more places of its anchor, as in periodic text, comes in two parts at least.
    Another ``salt`` chooses other anchors.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none
    h = gram_hashes(data, gram)
    if salt:
        h = (h ^ np.uint64(salt)) * PRIME
        h ^= h >> np.uint64(29)
    key = (h >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64) & np.uint64((1 << PLACE) - 1)
    low = sliding_min(key, width - gram + 1) & np.uint64((1 << PLACE) - 1)
    begin = np.cumsum(sizes) - sizes
    whole = np.zeros(len(low) + 1, np.int64)  # windows that lie in one text
    ok = sizes >= width
    np.add.at(whole, begin[ok], 1)
    np.add.at(whole, begin[ok] + sizes[ok] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    owner = np.searchsorted(begin, at, side="right") - 1
    place = low[at].astype(np.int64)
    found = h[place]
    other = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    new = np.flatnonzero(np.r_[True, other])
    moved = np.flatnonzero(~other & (place[1:] != place[:-1])) + 1
    if len(moved):  # a run that holds its gram again may repeat itself; cut once, it counts as two
        run = np.searchsorted(new, moved, side="right")
        new = np.sort(np.r_[new, moved[np.r_[True, run[1:] != run[:-1]]]])
    count = np.diff(np.r_[new, len(at)])
    if count.max() > RUN:  # long runs come from texts that repeat one gram
        parts = -(-count // RUN)
        new = np.repeat(new, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        count = np.diff(np.r_[new, len(at)])
    first = at[new]
    return owner[new], found[new].view(np.int64), (first - begin[owner[new]]) << 16 | count << 8 | (place[new] - first)


def _anchor_rows(width: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", max_bytes=PIECE):
            texts = [t.encode() for t in part.column(2).to_pylist()]
            pieces = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - width + 1), PIECE)]
            step = 1 if len(pieces) > len(texts) else len(pieces)  # a long text goes piece by piece
            for k in range(0, len(pieces), max(1, step)):
                some = pieces[k : k + step]
                owner, h, loc = anchors([texts[i][at : at + PIECE + width - 1] for i, at in some], width, gram)
                who, begin = np.array(some, np.int64).reshape(-1, 2)[owner].T
                ids, rows = (part.column(i).take(pa.array(who)) for i in (0, 1))
                yield pa.record_batch([pa.array(h), ids, rows, pa.array(loc + (begin << 16))], ["h", "id", "row", "loc"])

    return run


def _segments(width: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the segments of the anchors that matter out of each text; ``h`` is a hash of the anchor's bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        names = ["h", "salt", "id", "row", "at", "seg"]
        for part in slices(batches, "text", max_bytes=PIECE, max_rows=500):
            for i, text in enumerate(part.column(2).to_pylist()):
                raw, own = text.encode(), part.column(3)[i].values.to_numpy()
                for k in range(0, len(own), 10_000):
                    packed = own[k : k + 10_000]
                    loc = packed & (1 << SALT) - 1
                    at = loc >> 16
                    anchor = at + (loc & 0xFF)
                    h = [xxh64_intdigest(raw[a : a + gram]) for a in anchor.tolist()]
                    seg = [raw[a:b] for a, b in zip(at.tolist(), (at + (loc >> 8 & 0xFF) + width - 1).tolist(), strict=True)]
                    ids, rows = (part.column(c).take(pa.array(np.full(len(at), i))) for c in (0, 1))
                    yield pa.record_batch([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array((packed >> SALT).astype(np.int32)), ids, rows, pa.array(at), pa.array(seg, pa.binary())], names)

    return run


#: A mark: bytes at .. end of the text are repeated. A segment left over: ``seg`` is set, its windows are the first of their part.
FOUND = "h long, id long, row binary, at long, end long, seg binary"


class _Held:
    """The segments of a shard in order, each with its (id, row, at); ``seen`` tells repeats of a segment."""

    def __init__(self) -> None:
        self.segments: list[bytes] = []
        self.places: list[pa.RecordBatch] = []
        self.seen: set[bytes] = set()
        self.size = 0

    def solved(self, width: int, gram: int, partial: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Marks of the shard; and, if ``partial``, the runs of its windows that are not marked, each with a second anchor."""
        places = pa.Table.from_batches(self.places).combine_chunks()
        shard = Shard(self.segments)
        marked = repeated_windows(shard, width)
        owner, start, end = self._runs(shard, marked)
        marks = self._rows(places, owner, start, end + width - 1)
        if not partial:
            return marks, marks.slice(0, 0)
        owner, start, end = self._runs(shard, ~marked & (shard.left >= width))
        free = [self.segments[o][s : e + width - 1] for o, s, e in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)]
        of, h, loc = anchors(free, width, gram, salt=0x9E3779B97F4A7C15)
        at = loc >> 16
        seg = [free[o][a : a + n + width - 1] for o, a, n in zip(of.tolist(), at.tolist(), (loc >> 8 & 0xFF).tolist(), strict=True)]
        return marks, self._rows(places, owner[of], start[of] + at, start[of] + at + (loc >> 8 & 0xFF) + width - 1, h, seg)

    @staticmethod
    def _runs(shard: Shard, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        step = np.diff(np.r_[False, wanted, False].astype(np.int8))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        owner = np.searchsorted(shard.begin, starts, side="right") - 1
        return owner, starts - shard.begin[owner], ends - shard.begin[owner]

    @staticmethod
    def _rows(places: pa.Table, owner: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None, seg: list[bytes] | None = None) -> pa.RecordBatch:
        took = places.take(pa.array(owner, pa.int64()))
        at = np.asarray(took.column("at").to_numpy(), np.int64)
        columns = [pa.array(h if h is not None else np.zeros(len(owner), np.int64)), *(took.column(c).combine_chunks() for c in ("id", "row")), pa.array(at + start), pa.array(at + end), pa.array(seg, pa.binary()) if seg is not None else pa.nulls(len(owner), pa.binary())]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in columns]
        return pa.record_batch(columns, ["h", "id", "row", "at", "end", "seg"])


def _mark(width: int, gram: int, most: int = 2 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come in order of (h, salt, id, row, at); shards are cut between anchors once they hold ``most`` bytes.

    An anchor that alone holds more goes on with the windows that are first, and is sorted again when what is
    held has doubled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, limit = _Held(), None, 2 * most
        for batch in batches:
            h, salt, segments = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(5).to_pylist()
            place = batch.select(["id", "row", "at"])
            cuts = np.r_[0, np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1, len(h)]
            new: list[int] = []
            copied: list[int] = []

            def settle(place=place, new=new) -> None:
                if new:
                    held.places.append(place.take(pa.array(new, pa.int64())))
                    new.clear()

            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (h[lo], salt[lo]) != key:
                    if held.segments and (held.size >= most or salt[lo] or key[1]):
                        settle()
                        yield from held.solved(width, gram, bool(key[1]))
                        held, limit = _Held(), 2 * most
                    key = (h[lo], salt[lo])
                for i in range(lo, hi):
                    s = segments[i]
                    if s in held.seen:
                        copied.append(i)
                        continue
                    held.seen.add(s)
                    held.segments.append(s)
                    held.size += len(s)
                    new.append(i)
                    if held.size >= limit:
                        settle()
                        marks, left = held.solved(width, gram, True)
                        yield marks
                        held = _Held()
                        held.places = [left.select(["id", "row", "at"])]
                        held.segments = left.column("seg").to_pylist()
                        held.seen = set(held.segments)
                        held.size = sum(map(len, held.segments))
                        limit = 2 * max(most, held.size)
            settle()
            if copied:  # rows come in order, so the first of equal segments is the one held
                own = place.take(pa.array(copied, pa.int64()))
                size = np.fromiter((len(segments[i]) for i in copied), np.int64, len(copied))
                at = own.column("at").to_numpy()
                yield pa.record_batch([pa.array(np.zeros(len(copied), np.int64)), own.column("id"), own.column("row"), own.column("at"), pa.array(at + size), pa.nulls(len(copied), pa.binary())], ["h", "id", "row", "at", "end", "seg"])
        if held.segments:
            yield from held.solved(width, gram, bool(key[1]))

    return run


def _cut(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Removes the marked bytes of each text: bytes before and removed, runs, digest and text of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", max_bytes=2 << 20):
            rows = []
            for doc, text, first, runs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                raw = text.encode()
                kept, at, gone, spans = [], 0, 0, 0
                last = -1
                marks = sorted((r >> 16, (r >> 16) + (r & 0xFFFF)) for r in runs or ())
                if not first and len(raw) >= width:
                    marks = [(0, len(raw))]
                for s, e in marks:
                    if s > last:
                        spans += 1
                        kept.append(raw[at:s])
                    s = max(s, at)
                    gone += max(0, e - s)
                    at = last = max(at, e)
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((doc, len(raw), gone, spans, hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _often(texts: DataFrame, width: int, gram: int, sample: int = 1_000_000, least: int = 20) -> DataFrame:
    """Rows (h, often): frequent anchors and their estimated counts, from about ``sample`` anchors of whole texts.

    At most ``sample / least`` rows, which bounds the broadcast.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    share = min(1.0, sample * (width - gram + 2) / 2 / max(1, size))
    some = texts.where(in_sample(share, "id", "row", F.lit("often")))
    # counts are scaled by what was really sampled
    share = (some.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / max(1, size) or 1.0
    found = some.select("id", "row", "text").mapInArrow(_anchor_rows(width, gram), "h long, id long, row binary, loc long")
    return found.groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count")).limit(sample // least).select("h", (F.col("count") / share).cast("long").alias("often"))


def repeated_spans(texts: DataFrame, width: int = 100, gram: int = 24, hot: int = 4000) -> DataFrame:
    """Rows (id, row, at, end): the marked runs of windows of texts given as (id, row, text), each (id, row) once.

    A window holds at most 256 grams, as a place packs the offset of an anchor in a byte.
    """
    if not 0 <= width - gram < 256:
        raise ValueError("width has to be that of the gram, or up to 255 bytes more")
    often = _often(texts, width, gram)
    found = texts.select("id", "row", "text").mapInArrow(_anchor_rows(width, gram), "h long, id long, row binary, loc long")
    found = found.join(F.broadcast(often), "h", "left").withColumn("part", F.when(F.col("often").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "row"), 1 + F.shiftright("often", 10))))
    again = found.selectExpr("h", "id", "row", "loc", "often", "count(1) over (partition by h, part) as n").where("n > 1 or often is not null").withColumn("n", F.coalesce("often", "n"))
    salt = F.when(F.col("n") > hot, 1 + F.pmod(F.xxhash64("id", "row"), F.least(F.ceil(F.col("n") / hot), F.lit(SALTS)))).otherwise(0)
    wanted = again.select("id", "row", F.shiftleft(salt.cast("long"), SALT).bitwiseOR(F.col("loc")).alias("a")).groupBy("id", "row").agg(F.collect_list("a").alias("own"))
    cut = texts.select("id", "row", "text").join(wanted.hint("merge"), ["id", "row"]).select("id", "row", "text", "own")
    segments = cut.mapInArrow(_segments(width, gram), "h long, salt int, id long, row binary, at long, seg binary")
    order = ["h", "salt", "id", "row", "at"]
    first = stored(segments.repartition("h", "salt").sortWithinPartitions(*order).mapInArrow(_mark(width, gram), FOUND), "repeats-marks", "zstd")
    left = first.where("seg is not null").select("h", F.lit(0).alias("salt"), "id", "row", "at", "seg")
    second = left.repartition("h").sortWithinPartitions(*order).mapInArrow(_mark(width, gram), FOUND)
    return first.where("seg is null").unionByName(second).select("id", "row", "at", "end")


def remove_repeats(docs: DataFrame, width: int = 100, gram: int = 24, hot: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one for each row of ``docs``.

    ``kept`` holds the bytes that stay; a cut may fall inside a character, so they may be no UTF-8.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    several = not docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).count().where("count > 1").isEmpty()
    # where an id does not tell rows apart, a digest of the text does; null comes before all ids
    row = F.when(F.col("doc_id").isNull(), F.concat(F.lit(b"\0"), "sha")).otherwise(F.concat(F.lit(b"\1"), "sha") if several else F.lit(b"\1"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), row.alias("row"), "sha", "text")
    first = rows.groupBy("sha").agg(F.min(F.struct("id", "row")).alias("low")).select("low.*", F.lit(True).alias("first"))
    once = rows.groupBy("doc_id", "id", "row").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows")) if several or not docs.where(F.col(id_col).isNull()).isEmpty() else rows.drop("sha").withColumn("rows", F.lit(1))
    texts = bucketed(once.join(first.hint("merge"), ["id", "row"], "left").withColumn("first", F.coalesce("first", F.lit(False))), ["id", "row"], "repeats_texts")
    spans = repeated_spans(texts.where("first").select("id", "row", "text"), width, gram, hot)
    run = F.shiftleft("at", 16).bitwiseOR(F.col("end") - F.col("at"))
    of_doc = spans.groupBy("id", "row").agg(F.collect_list(run).alias("runs"))
    joined = texts.join(of_doc.hint("merge"), ["id", "row"], "left").select(F.explode(F.array_repeat("doc_id", F.col("rows").cast("int"))).alias("doc_id"), "text", "first", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(_cut(width), schema).withColumnRenamed("doc_id", id_col)
