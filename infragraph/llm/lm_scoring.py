"""Operator 2, LM scoring: deleted interpolation of n-gram estimates.

The model mixes the maximum-likelihood estimates of orders ``order`` to 1 and the uniform one. The mixture
weights depend on the longest context that was seen and on how often (buckets of powers of two). They are
learned by expectation-maximisation on held-out counts: one fold of the learning documents is left out of
the counts, and the weights that make its tokens most likely are kept. Then texts are scored under counts of
all learning documents. A text's first tokens follow begin marks; an end follows its last one.

Rows are dealt into chunks once and written in buckets of them; asking and scoring read that table. Each
chunk asks once for each of its distinct n-grams of an order: sorted 64-bit hashes with its own counts, cut
into hash ranges. A range adds up the counts of all chunks and answers each chunk in the order it asked in,
so answers carry no hashes, no n-gram has more than one entry a chunk however frequent it is, and no
vocabulary is broadcast. Chunks and ranges both grow with the square root of the corpus, so that the pieces
sent between them stay of one size and their number is in proportion to the corpus.

Defined results: a null text is the empty text, one end token; null ids are never held out; repeated rows
are counted and scored as separate documents (rows of equal id and text share a chunk); without learning
documents every token has probability 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.plans.lineage import bucketed, discard, stored

COUNTED, TUNING, SCORED = 0, 1, 2
OCTAVES = 64  # buckets of a context's length
REQUEST = "chunk long, tuning boolean, range int, grams binary, n binary"
ANSWER = "chunk long, level int, range int, total binary, tuned binary, words long, words_counted long, tokens long, tokens_counted long"


END, BEGIN = 0x9AE16A3B2F90404F, 0x3C79AC492BA7B653  # the token after each text, and the mark before it


BLOCK = 1 << 17  # bytes of text whose tokens are hashed together
LONG = 64  # a longer token is hashed by itself
BLANK = np.isin(np.arange(256), [*range(9, 14), 32])
BASE = 0xD1342543DE82EF95


def mixed(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


with np.errstate(over="ignore"):
    VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
VALUE[65:91] = VALUE[97:123]  # A-Z as a-z


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(x))].astype(np.uint64)) for x in (BASE, pow(BASE, -1, 2**64)))


def token_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of bytes that end with a blank, and where each starts: sums of powers, block by block."""
    from xxhash import xxh64_intdigest

    data, gap = np.frombuffer(raw, np.uint8), re.compile(rb"[\x09-\x0D ]")
    hashes, starts, at = [], [], 0
    while at < len(raw):
        to = gap.search(raw, min(at + BLOCK, len(raw)) - 1).end()
        part = data[at:to]
        edge = np.flatnonzero(np.diff(BLANK[part], prepend=True))
        start, end = edge[::2], edge[1::2]
        power, inverse = powers(1 << len(part).bit_length())
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum(VALUE[part] * power[: len(part)])]
            h = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > LONG).tolist():
            h[i] = xxh64_intdigest(raw[at + start[i] : at + end[i]].lower())
        hashes.append(h)
        starts.append(start + at)
        at = to
    return np.concatenate(hashes), np.concatenate(starts)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and the tokens of each text; blanks are ASCII white space, A-Z are lower-cased."""
    raws = [t.encode() if t else b"" for t in texts]
    h, starts = token_hashes(b" ".join(raws) + b" ")
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))
    last = ends + np.arange(len(raws))
    out = np.full(len(h) + len(raws), END, np.uint64)
    word = np.ones(len(out), bool)
    word[last] = False
    out[word] = h
    return out, np.diff(last, prepend=-1)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of a context and the token after it."""
    with np.errstate(over="ignore"):
        z = context * np.uint64(0xC2B2AE3D27D4EB4F) + (word ^ (word >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def grams(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the n-gram that ends with it, of each order from 1 on; ``first`` are the texts' first tokens."""
    out, begin = [words], np.array([BEGIN], np.uint64)
    for _ in range(1, order):
        context = np.r_[begin, out[-1][:-1]]
        context[first] = begin
        out.append(joined(context, words))
        begin = joined(begin, np.array([BEGIN], np.uint64))
    return out


def packed(a: np.ndarray) -> bytes:
    """64-bit numbers by bytes of like value, which compress well: in sorted hashes' steps and in counts the high ones are zero."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def range_cuts(sorted_hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where each hash range begins and ends among sorted hashes."""
    bounds = [(i << 64) // ranges for i in range(1, ranges)]
    return np.r_[0, np.searchsorted(sorted_hashes, np.array(bounds, np.uint64)), len(sorted_hashes)]


def _requests(level: int, ranges: int) -> Callable[[pa.Table], pa.Table]:
    def run(docs: pa.Table) -> pa.Table:
        words, sizes = tokens(docs.column("text").to_pylist())
        fold = np.asarray(docs.column("fold").to_numpy())
        learns = np.repeat((fold != SCORED).astype(np.float64), sizes)
        own = grams(words, np.cumsum(sizes) - sizes, level)[-1]
        u, at = np.unique(own, return_inverse=True)
        n = np.bincount(at, learns, len(u)).astype(np.uint64)
        cut = range_cuts(u, ranges)
        some = np.flatnonzero(cut[1:] > cut[:-1])
        chunk, tuning = docs.column("chunk")[0].as_py(), bool(fold[0] == TUNING)
        parts = [slice(int(cut[i]), int(cut[i + 1])) for i in some]
        return pa.table(
            {
                "chunk": pa.array(np.full(len(some), chunk)),
                "tuning": pa.array([tuning] * len(some), pa.bool_()),
                "range": pa.array(some.astype(np.int32)),
                "grams": pa.array([packed(np.diff(u[s], prepend=np.uint64(0))) for s in parts], pa.binary()),
                "n": pa.array([packed(n[s]) for s in parts], pa.binary()),
            }
        )

    return run


def _answers(level: int) -> Callable[[pa.Table], pa.Table]:
    """Adds up one hash range over all chunks; tuning chunks also learn what of the totals is theirs."""

    def run(table: pa.Table) -> pa.Table:
        tuning = np.array(table.column("tuning").to_pylist(), bool)
        with np.errstate(over="ignore"):
            h = [np.cumsum(unpacked(x)) for x in table.column("grams").to_pylist()]
        n = np.concatenate([unpacked(x) for x in table.column("n").to_pylist()]).astype(np.float64)
        sizes = np.array([len(x) for x in h])
        u, at = np.unique(np.concatenate(h), return_inverse=True)
        del h
        total = np.bincount(at, n, len(u)).astype(np.uint64)
        theirs = np.repeat(tuning, sizes)
        tuned = np.bincount(at[theirs], n[theirs], len(u)).astype(np.uint64)
        ends = np.cumsum(sizes)
        sums = np.zeros((table.num_rows, 4), np.int64)
        sums[0] = (total > 0).sum(), (total > tuned).sum(), total.sum(), (total - tuned).sum()
        spans = [at[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "level": pa.array(np.full(len(sizes), level, np.int32)),
                "range": table.column("range"),
                "total": pa.array([packed(total[s]) for s in spans], pa.binary()),
                "tuned": pa.array([packed(tuned[s]) if t else None for s, t in zip(spans, tuning.tolist(), strict=True)], pa.binary()),
                **{c: pa.array(sums[:, i]) for i, c in enumerate(("words", "words_counted", "tokens", "tokens_counted"))},
            }
        )

    return run


@dataclass(frozen=True)
class Totals:
    words: int
    words_counted: int
    tokens: int
    tokens_counted: int


def estimates(found: list[np.ndarray], ends: int, first: np.ndarray, words: int, tokens_in_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Per token its bucket, and the estimates of order 0 (uniform) to ``order`` as columns.

    ``found`` has the counts of each token's n-grams by order, ``ends`` the number of learning texts. The
    bucket is 64 times the longest order with a context that was seen, plus the octave of its count.
    """
    n = len(found[0])
    p = np.zeros((n, len(found) + 1))
    p[:, 0] = 1 / (words + 1)
    p[:, 1] = found[0] / max(tokens_in_all, 1)
    bucket = np.full(n, OCTAVES, np.int64)
    for k in range(1, len(found)):
        context = np.r_[ends, found[k - 1][:-1]]
        context[first] = ends
        seen = context > 0
        p[seen, k + 1] = found[k][seen] / context[seen]
        bucket[seen] = OCTAVES * (k + 1) + np.log2(context[seen]).astype(np.int64)
    return bucket, p


def _counted(docs: pa.Table, answers: pa.Table, order: int, left_out: bool) -> tuple[list[np.ndarray], int, np.ndarray]:
    """For a chunk's tokens their n-grams' counts by order; the number of texts learned; tokens of each text."""
    words, sizes = tokens(docs.column("text").to_pylist())
    answers = answers.sort_by([("level", "ascending"), ("range", "ascending")])
    level = np.asarray(answers.column("level").to_numpy())
    found, ends = [], 0
    for k, own in enumerate(grams(words, np.cumsum(sizes) - sizes, order), 1):
        lo, hi = np.searchsorted(level, [k, k + 1])
        mine = answers.slice(lo, hi - lo)
        total = np.concatenate([unpacked(x) for x in mine.column("total").to_pylist()]).astype(np.int64)
        if left_out:
            total -= np.concatenate([unpacked(x) for x in mine.column("tuned").to_pylist()]).astype(np.int64)
        u, at = np.unique(own, return_inverse=True)
        found.append(total[at])
        if k == 1:
            ends = int(total[np.searchsorted(u, np.uint64(END))])
    return found, ends, sizes


def _held_out(totals: Totals, order: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [f"p{k}" for k in range(order + 1)]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.float64()) for c in names}})
        found, ends, sizes = _counted(docs, answers, order, left_out=True)
        bucket, p = estimates(found, ends, np.cumsum(sizes) - sizes, totals.words_counted, totals.tokens_counted)
        return pa.table({"bucket": pa.array(bucket.astype(np.int32)), **{c: pa.array(p[:, k].copy()) for k, c in enumerate(names)}})

    return run


def learn_weights(held_out: DataFrame, order: int, rounds: int = 12, least: int = 200) -> np.ndarray:
    """Weights by bucket (rows) and order 0 to ``order`` (columns), by expectation-maximisation over all held-out tokens.

    Each round is one pass that adds up the shares of the estimates by bucket; the driver sees a row for each
    bucket, at most 64 for each order. A bucket of fewer than ``least`` tokens takes the mean weights of the
    other buckets of its order by tokens, and equal ones if there are none.
    """
    spark, names = held_out.sparkSession, [f"p{k}" for k in range(order + 1)]
    weights = np.zeros((OCTAVES * (order + 1), order + 1))
    for k in range(1, order + 1):
        weights[OCTAVES * k : OCTAVES * (k + 1), : k + 1] = 1 / (k + 1)
    counts = np.zeros(len(weights))
    for _ in range(rounds):
        rows = [(int(b), *map(float, weights[b])) for b in range(OCTAVES, len(weights))]
        now = spark.createDataFrame(rows, "bucket int, " + ", ".join(f"w{k} double" for k in range(order + 1)))
        whole = " + ".join(f"w{k} * p{k}" for k in range(order + 1))
        shares = held_out.join(F.broadcast(now), "bucket").selectExpr("bucket", f"{whole} as whole", *(f"w{k} * {c} as s{k}" for k, c in enumerate(names)))
        sums = shares.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"s{k}") / F.col("whole")).alias(f"s{k}") for k in range(order + 1))).collect()
        for r in sums:
            counts[r["bucket"]] = r["n"]
            weights[r["bucket"]] = [r[f"s{k}"] / r["n"] for k in range(order + 1)]
    for k in range(1, order + 1):
        own = slice(OCTAVES * k, OCTAVES * (k + 1))
        firm = counts[own] >= least
        mean = np.average(weights[own][firm], axis=0, weights=counts[own][firm]) if firm.any() else np.r_[np.full(k + 1, 1 / (k + 1)), np.zeros(order - k)]
        weights[own][~firm] = mean
    return weights


def _score(totals: Totals, weights: np.ndarray, order: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found, ends, sizes = _counted(docs, answers, order, left_out=False)
        first = np.cumsum(sizes) - sizes
        base = np.log10((found[0] + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))
        bucket, p = estimates(found, ends, first, totals.words, totals.tokens)
        likely = (weights[bucket] * p).sum(axis=1) if totals.tokens else np.ones(len(bucket))
        return pa.table(
            {
                "doc_id": docs.column("id"),
                "fold": docs.column("fold"),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(np.add.reduceat((found[0] > 0).astype(np.int64), first)),
                "train_tokens": pa.array(np.full(len(sizes), totals.tokens)),
                "base_score": pa.array(np.add.reduceat(base, first)),
                "score": pa.array(np.add.reduceat(np.log10(likely), first)),
            }
        )

    return run


def score_documents(docs: DataFrame, fold: Column, order: int = 3, chunk_bytes: int = 6 << 20, piece_bytes: int = 8 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fold, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    ``fold`` is COUNTED, TUNING (counted, and held out to learn the weights) or SCORED. Chunks and ranges hold
    ``chunk_bytes`` of text, or as much as makes the pieces between them ``piece_bytes``; a task's memory
    follows one of them, or the longest text.
    """
    rows = docs.select(fold.cast("int").alias("fold"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(4, int(size / max(chunk_bytes, (size * piece_bytes) ** 0.5)))
    # a tuning row is in a chunk of tuning rows, numbered from ``chunks`` on
    dealt = F.pmod(F.xxhash64("id", "text"), F.when(F.col("fold") == TUNING, max(4, chunks // 10)).otherwise(chunks)) + F.when(F.col("fold") == TUNING, chunks).otherwise(0)
    parted = bucketed(rows.withColumn("chunk", dealt.cast("long")).repartition("chunk"), "chunk", "lm_texts")
    replies = None
    for level in range(1, order + 1):
        asked = parted.select("chunk", "fold", "text").groupBy("chunk").applyInArrow(_requests(level, chunks), REQUEST)
        own = stored(asked.groupBy("range").applyInArrow(_answers(level), ANSWER), "lm-answers", "zstd")
        if level == 1:
            s = own.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "words_counted", "tokens", "tokens_counted"))).first()
            totals = Totals(*map(int, s))
        replies = own if replies is None else replies.unionAll(own)
    tuning = replies.where(F.col("chunk") >= chunks).select("chunk", "level", "range", "total", "tuned")
    columns = "bucket int, " + ", ".join(f"p{k} double" for k in range(order + 1))
    held_out = parted.where(F.col("chunk") >= chunks).groupBy("chunk").cogroup(tuning.groupBy("chunk")).applyInArrow(_held_out(totals, order), columns)
    held_out = stored(held_out, "lm-held-out", "zstd")
    weights = learn_weights(held_out, order)
    discard(held_out)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parted.groupBy("chunk").cogroup(replies.select("chunk", "level", "range", "total").groupBy("chunk")).applyInArrow(_score(totals, weights, order), schema)
