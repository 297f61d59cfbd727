"""Operator 4, document fingerprints: a quartile bucket digest.

Over the UTF-8 bytes of a whole text, every window of five bytes gives six byte triplets; each is hashed
into one of 128 buckets and counted. The digest is 70 hex digits: a checksum byte, the byte length on a
logarithmic scale, the ratios of the quartiles, and for each bucket the quartile its count lies in (two
bits). The difference of two digests adds up the steps between quartile codes and the distances of the
header fields; ``likeness`` turns it into 1 (equal) to 0 (at least ``REACH`` apart).

Defined results: null is the empty text; texts of fewer than five bytes have no triplets and all buckets
in the lowest quartile, told apart by checksum and length alone; equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.llm.common import slices

BUCKETS, REACH = 128, 300
#: For each window a b c d e: the bytes beside the first one, and the triplet's salt.
TRIPLETS = ((1, 2, 2), (1, 3, 3), (2, 3, 5), (2, 4, 7), (1, 4, 11), (3, 4, 13))


def _permutation(seed: int) -> np.ndarray:
    """A fixed permutation of the bytes."""
    x, state = list(range(256)), seed
    for i in range(255, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        j = (state >> 33) % (i + 1)
        x[i], x[j] = x[j], x[i]
    return np.array(x, np.uint8)


PERM = _permutation(20)
#: For each salt and pair of bytes, what is mixed with the third byte.
PAIRS = {salt: PERM[PERM[PERM[salt] ^ np.arange(256)][:, None] ^ np.arange(256)].ravel() for _, _, salt in TRIPLETS}


def bucket_counts(data: bytes, block: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed triplets of all windows of five bytes."""
    out = np.zeros(BUCKETS, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - 4, block):
        x = whole[at : at + block + 4]
        n = len(x) - 4
        head = x[:n].astype(np.uint16) << np.uint16(8)
        for i, j, salt in TRIPLETS:
            h = PERM[PAIRS[salt][head | x[i : i + n]] ^ x[j : j + n]]
            out += np.bincount(h & np.uint8(BUCKETS - 1), minlength=BUCKETS)
    return out


def digest(data: bytes) -> bytes:
    """The 35 bytes of a text's digest."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    check = hashlib.sha256(data).digest()[0]
    length = min(255, round(8 * math.log2(len(data) + 1)))
    r1, r2 = (int(100 * q // q3) % 16 if q3 else 0 for q in (q1, q2))
    return bytes([check, length, r1 << 4 | r2]) + body.tobytes()


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences of digests given as rows of 35 bytes.

    A step of one between quartile codes counts 1, of two 2 and of three 6; a length step of one counts 1
    and larger ones 4 each; the ratios count 4 a step beyond the first; another checksum counts 1.
    """
    a, b = np.atleast_2d(a).astype(np.int64), np.atleast_2d(b).astype(np.int64)
    total = (a[:, 0] != b[:, 0]).astype(np.int64)
    step = np.abs(a[:, 1] - b[:, 1])
    total += np.where(step <= 1, step, 4 * step)
    for shift in (0, 4):
        step = np.abs((a[:, 2] >> shift & 15) - (b[:, 2] >> shift & 15))
        step = np.minimum(step, 16 - step)
        total += np.where(step <= 1, step, 4 * (step - 1))
    for shift in (0, 2, 4, 6):
        step = np.abs((a[:, 3:] >> shift & 3) - (b[:, 3:] >> shift & 3))
        total += (step + 3 * (step == 3)).sum(axis=1)
    return total


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.minimum(difference(a, b), REACH) / REACH


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows in the order of keys: ``bounds`` cut the keys, ``inner`` the texts of a frequent key.

    A range holds the keys above one bound up to the next, or of one frequent key the texts whose first seven
    bytes lie between two inner bounds. Ranges are numbered from 0; the row order goes from the last to the first.
    """

    bounds: np.ndarray
    inner: dict[float, np.ndarray]

    @property
    def first(self) -> np.ndarray:
        """The lowest range number for each place among the bounds; the last entry is the number of ranges."""
        size = np.ones(len(self.bounds) + 1, np.int64)
        for key, cuts in self.inner.items():
            size[np.searchsorted(self.bounds, key)] = len(cuts) + 1
        return np.r_[0, np.cumsum(size)]

    @property
    def count(self) -> int:
        return int(self.first[-1])

    def of(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.bounds, key)
        out = self.first[place]
        for frequent, cuts in self.inner.items():
            own = key == frequent
            out[own] += len(cuts) - np.searchsorted(cuts, head[own])
        return out


def find_ranges(keys: DataFrame, parts: int) -> Ranges:
    """About ``parts`` ranges of like numbers of rows for rows (key, head); the driver sees bounds only.

    A key on which several quantiles fall holds more than a range; it gets ranges of its own, by ``head``.
    """
    if parts < 2:
        return Ranges(np.zeros(0), {})
    cuts = [float(x) for x in keys.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts)]
    hot = {x: n for x, n in Counter(cuts).items() if n > 1}
    bounds = sorted(set(cuts) | {float(np.nextafter(x, -np.inf)) for x in hot})
    inner = {}
    for x, n in hot.items():
        found = keys.where(F.col("key").cast("double") == x).approxQuantile("head", [i / (n + 1) for i in range(1, n + 1)], 0.25 / (n + 1))
        inner[x] = np.array(sorted(set(found)))
    return Ranges(np.array(bounds), inner)


def fingerprint_edits(docs: DataFrame, part_bytes: int = 8 << 20, max_parts: int = 32_768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half comes from the next document.

    The next document is the one after it by descending id, equal ids by text, null ids last; after the
    last comes the first; a lone document follows itself. Texts are shuffled once, into ranges of about
    ``part_bytes``, a task each: bounds come from the ids and, for an id of very many rows, from the first
    bytes of its texts. The first row of each range also goes to the range before, so that no range needs
    another. Nothing but bounds reaches the driver, for at most about ``max_parts`` ranges; a larger corpus has
    longer ranges, which are sorted with spilling and streamed.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    base = base.withColumn("head", F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = find_ranges(base.select("key", "head"), max(1, min(max_parts, int(size // part_bytes))))

    @F.pandas_udf("int")
    def range_of(key: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(key.to_numpy().astype(np.float64), head.to_numpy()).astype(np.int32))

    placed = base.withColumn("part", range_of("key", "head")).drop("head")
    heads = _heads(placed, docs.sparkSession)
    marked = placed.join(F.broadcast(heads), ["part", "key"], "left")
    is_head = F.col("head").isNotNull() & (F.sha2(F.col("text").cast("binary"), 256) == F.col("head"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))
    also = F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))
    rows = marked.select("id", "key", "text", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))).alias("to"))
    dealt = rows.select("id", "key", "text", "to.part", "to.extra").repartitionById(ranges.count, "part").sortWithinPartitions("part", "extra", F.desc("key"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("id", "text", "part", "extra").mapInArrow(_edited, schema).withColumnRenamed("doc_id", id_col)


def _heads(placed: DataFrame, spark: SparkSession) -> DataFrame:
    """For each range its first row (key and digest of the text) and the range before, which that row also goes to.

    One row for each range: this is what is broadcast.
    """
    top = placed.select("part", "key").groupBy("part").agg(F.max("key").alias("key"))
    first = placed.join(F.broadcast(top), ["part", "key"]).groupBy("part", "key").agg(F.min("text").alias("text"))
    found = sorted(first.select("part", "key", F.sha2(F.col("text").cast("binary"), 256).alias("head")).collect(), reverse=True)
    rows = [(r["part"], r["key"], r["head"], found[i - 1]["part"]) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "part int, key long, head string, before int")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order within each range; each is finished when the one after it is seen."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # (id, text, digest, part) of the row that waits
    for part in slices(batches, "text"):
        done: list[tuple] = []
        pairs: list[tuple[bytes, bytes, bytes]] = []
        for doc_id, text, at, extra in zip(*(c.to_pylist() for c in part.columns), strict=True):
            raw = text.encode()
            own = digest(raw)
            if held is not None and held[3] == at:
                half = len(held[1]) // 2
                edited = (held[1][: len(held[1]) - half] + text[:half]).encode()
                new = digest(edited)
                done.append((held[0], len(held[1]), hashlib.sha256(edited).hexdigest(), held[2].hex(), new.hex()))
                pairs.append((held[2], new, own))
            held = None if extra else (doc_id, text, own, at)
        if done:
            mine, new, after = (np.frombuffer(b"".join(x), np.uint8).reshape(len(done), -1) for x in zip(*pairs, strict=True))
            cols = [pa.array(x) for x in zip(*done, strict=True)]
            cols[0] = cols[0].cast(pa.int64())
            yield pa.record_batch([*cols, pa.array(likeness(mine, new)), pa.array(likeness(mine, after))], names)
