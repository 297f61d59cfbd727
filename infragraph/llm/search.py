"""Operator 13, ranked lexical search: the inner product of queries and documents, with norm buckets after LEMP.

A document is a sparse vector of impacts over the terms that any query has: of term t, sqrt(w) times
``(1000000000 * tf) div (1000 * tf + 12 * m)``, and a query one of sqrt(w) times how often it has t. Their inner product is
the score. Document vectors are ordered by length, longest first, and dealt into buckets along this order. The
longest ones are scored first, which gives each query a threshold: the score of its ``top``-th best so far. In the other
buckets

- Cauchy and Schwarz: a bucket is left out if the query's length times the bucket's longest vector stays under the
  threshold; buckets that no query needs are not read, as the bound is pushed down to the files;
- coordinate bounds: of the rest, the coordinates that hold most of the query are multiplied out; what the remaining ones
  can add is bounded by the lengths of what remains of both vectors, and by each coordinate's largest value in the bucket;
- survivors are scored exactly, in integers, and raise the task's own threshold.

A document that might equal the threshold survives, so the result is exact with its ties. Tasks give at most ``top``
rows a query, of which the best are ranked.

Queries are taken in blocks of bounded size: all that is known of a block's terms goes through the driver and
with each task. Equal query texts are scored once.

Defined results: documents and queries without terms, null ones too, match nothing; a score has to be above 0; equal
scores go by ascending document id, null ids last; repeated documents and repeated queries are each ranked; empty tables
give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from infragraph.llm.common import slices
from infragraph.plans.lineage import discard, stored

#: Bytes to terms: letters and digits stay, in lower case, as do bytes beyond ASCII; all else parts terms.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
BUCKET = 4096
#: For rounding in the bounds, which are doubles.
SLACK = 1 + 1e-9
#: The share of a query's squared length that its multiplied-out coordinates hold.
FOCUS = 0.9


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_vectors(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, terms, tfs) of documents with terms: how many they have, and how often each of the vocabulary."""
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    place = {t: i for i, t in enumerate(vocabulary)}
    width = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = [terms_of(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            found = [np.fromiter(map(place.get, w, repeat(-1)), np.int64, len(w)) for w in words]
            key = np.repeat(np.arange(len(n)), n) * width + np.concatenate(found)
            key, tf = np.unique(key[np.concatenate(found) >= 0], return_counts=True)
            ends = np.searchsorted(key // width, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % width, tf)]
            yield pa.record_batch([part.column("id"), pa.array(n), *lists], ["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


@dataclass(frozen=True)
class Queries:
    """A block of queries over numbered terms, with the weights of all terms."""

    weights: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    def lengths(self) -> np.ndarray:
        return np.array([math.sqrt(float((self.weights[t] * c.astype(np.float64) ** 2).sum())) for t, c in zip(self.terms, self.counts, strict=True)])

    def focused(self, q: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(terms, values) of a query's largest coordinates, which hold ``FOCUS`` of its squared length, and of the others."""
        terms = self.terms[q]
        values = np.sqrt(self.weights[terms].astype(np.float64)) * self.counts[q]
        order = np.argsort(-values, kind="stable")
        n = int(np.searchsorted(np.cumsum(values[order] ** 2), FOCUS * float((values**2).sum()))) + 1
        return (terms[order[:n]], values[order[:n]]), (terms[order[n:]], values[order[n:]])


def _csr(batch: pa.RecordBatch, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, term, value) of the list columns ``terms`` and ``values``."""
    lists = batch.column("terms")
    n = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), n), lists.flatten().to_numpy().astype(np.int64), batch.column(values).flatten().to_numpy().astype(np.int64)


def impact_vectors(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Rows (id, norm, terms, impacts) of ``term_vectors`` rows that share a term with any query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, tf = _csr(batch, "tfs")
            m = 75 + (25 * n_docs * batch.column("n").to_numpy()) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            norm = np.sqrt(np.bincount(row, weights[term] * impact.astype(np.float64) ** 2, batch.num_rows))
            lists = pa.ListArray.from_arrays(batch.column("terms").offsets, pa.array(impact.astype(np.int32)))
            yield pa.record_batch([batch.column("id"), pa.array(norm), batch.column("terms"), lists], ["id", "norm", "terms", "impacts"]).filter(pa.array(norm > 0))

    return vectors.select("id", "n", "terms", "tfs").mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, norm double, terms array<int>, impacts array<int>")


class Bucket:
    """Impact vectors of like length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray):
        self.ids = batch.column("id")
        self.row, self.term, self.impact = _csr(batch, "impacts")
        self.norm = batch.column("norm").to_numpy()
        self.value = np.sqrt(weights[self.term].astype(np.float64)) * self.impact
        by_term = np.argsort(self.term, kind="stable")
        self.rows, self.values = self.row[by_term], self.value[by_term]
        self.ends = np.searchsorted(self.term[by_term], np.arange(len(weights) + 1))
        self.starts = np.searchsorted(self.row, np.arange(len(self.norm) + 1))
        self.most = np.zeros(len(weights))
        held = np.flatnonzero(np.diff(self.ends))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.values, self.ends[held])

    def survivors(self, focus: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
        """Rows whose product with a query may reach ``least``; its (terms, values) are multiplied out in ``focus`` and bounded in ``rest``."""
        product, squares = np.zeros(len(self.norm)), np.zeros(len(self.norm))
        for t, q in zip(focus[0].tolist(), focus[1].tolist(), strict=True):
            rows, own = self.rows[self.ends[t] : self.ends[t + 1]], self.values[self.ends[t] : self.ends[t + 1]]
            product[rows] += q * own
            squares[rows] += own * own
        by_length = math.sqrt(float((rest[1] ** 2).sum())) * np.sqrt(np.maximum(self.norm**2 * SLACK - squares, 0))
        more = np.minimum(by_length, float((rest[1] * self.most[rest[0]]).sum()))
        return np.flatnonzero((product + more) * SLACK >= least)

    def scores(self, rows: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``factors`` holds weight times count of each term."""
        n = self.starts[rows + 1] - self.starts[rows]
        entries = np.arange(int(n.sum())) + np.repeat(self.starts[rows] - np.cumsum(n) + n, n)
        return np.add.reduceat(np.r_[factors[self.term[entries]] * self.impact[entries], 0], np.cumsum(n) - n)


def _best(held: list[tuple], ids: pa.Array, rows: np.ndarray, scores: np.ndarray, top: int) -> list[tuple]:
    """The ``top`` first of (-score, id is null, id)."""
    if len(rows) > 4 * top:
        enough = scores >= np.partition(scores, len(scores) - top)[len(scores) - top]
        rows, scores = rows[enough], scores[enough]
    found = [(-s, i is None, i) for s, i in zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist(), strict=True)]
    return sorted(held + found, key=lambda x: x[:2] if x[1] else x)[:top]


def _searched(buckets: DataFrame, block: Queries, least: np.ndarray, top: int) -> DataFrame:
    """Rows (query, id, score): of each task the best rows of each query that reach ``least``."""
    kind = buckets.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, limits = block.lengths(), np.maximum(least, 1).astype(np.float64)
        held: list[list[tuple]] = [[] for _ in lengths]
        focus = [block.focused(q) for q in range(len(lengths))]
        factors, id_type = np.zeros(len(block.weights), np.int64), None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(0, batch.num_rows, BUCKET):
                bucket = Bucket(batch.slice(i, BUCKET), block.weights)
                for q in np.flatnonzero(lengths * bucket.norm.max() * SLACK >= limits).tolist():
                    rows = bucket.survivors(*focus[q], limits[q])
                    if not len(rows):
                        continue
                    factors[block.terms[q]] = block.weights[block.terms[q]] * block.counts[q]
                    scores = bucket.scores(rows, factors)
                    factors[block.terms[q]] = 0
                    reach = scores >= limits[q]
                    held[q] = _best(held[q], bucket.ids, rows[reach], scores[reach], top)
                    if len(held[q]) == top:
                        limits[q] = max(limits[q], -held[q][-1][0])
        if id_type is not None:
            rows = [(q, x[2], -x[0]) for q, own in enumerate(held) for x in own]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], ["query", "id", "score"])

    return buckets.select("id", "norm", "terms", "impacts").mapInArrow(run, f"query int, id {kind.simpleString()}, score long")


def _block_results(docs: DataFrame, texts: list[str], top: int, head_rows: int, id_col: str, text_col: str) -> DataFrame | None:
    """Rows (text, id, score, rank) for a block of different query texts; None if there is nothing to find."""
    spark = docs.sparkSession
    counted = [Counter(terms_of(t.encode())) for t in texts]
    vocabulary = sorted(set().union(*counted))
    vectors = stored(term_vectors(docs, vocabulary, id_col, text_col), "search-terms", "zstd")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not vocabulary:
        discard(vectors)
        return None
    # no more rows than the block has terms
    df = {r["t"]: r["df"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = np.array([term_weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    own = [sorted((place[t], k) for t, k in c.items()) for c in counted]
    block = Queries(weights, [np.array([t for t, _ in q], np.int64) for q in own], [np.array([k for _, k in q], np.int64) for q in own])
    impacts = impact_vectors(vectors, weights, n_docs, n_terms).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    order = [F.desc("norm"), F.asc("deal")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // (2 * BUCKET))
    buckets = stored(impacts.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).drop("deal"), "search-buckets", "zstd")
    discard(vectors)
    none = np.zeros(len(texts), np.int64)
    first = _searched(buckets.orderBy(F.desc("norm")).limit(head_rows), block, none, top)
    least = none.copy()
    for r in first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == top).collect():
        least[r["query"]] = r["least"]
    lengths = block.lengths()
    # below this length no vector reaches the threshold of any query
    floor = min((float(max(s, 1) / n) for s, n in zip(least, lengths, strict=True) if n > 0), default=math.inf)
    found = _searched(buckets.where(F.col("norm") >= floor / SLACK), block, least, top)
    by_rank = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    named = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    out = stored(ranked.join(F.broadcast(named), "query").select("text", "id", "score", "rank"), "search-block")
    discard(buckets)
    return out


def search(docs: DataFrame, queries: DataFrame, top: int = 20, block_rows: int = 2000, block_bytes: int = 8 << 20, head_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Rows (query_id, rank, doc_id, score): the ``top`` documents of highest score for each row of ``queries``.

    The weight of a term is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; a document's m is
    ``75 + (25 * n * N) div L``, with n terms in it and L in all N documents that have any.

    Different query texts are dealt by hash into blocks of about ``block_rows`` and ``block_bytes``, which are searched
    one after the other; a block is known on the driver. ``head_rows`` documents set the first thresholds.
    """
    items = queries.select(F.col(query_id).alias("item"), F.col(query_text).cast("string").alias("text")).where("text is not null")
    texts = items.select("text").distinct()
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // block_rows), -(-(size or 0) // block_bytes))
    out = docs.sparkSession.createDataFrame([], f"text string, id {docs.select(F.col(id_col)).schema[0].dataType.simpleString()}, score long, rank int")
    for i in range(blocks):
        own = sorted(r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i).collect())
        found = _block_results(docs, own, top, head_rows, id_col, text_col) if own else None
        out = out if found is None else out.unionByName(found)
    return items.join(out, "text").select(F.col("item").alias(query_id), "rank", F.col("id").alias(id_col), "score")


#: DuckDB SQL for the search of all documents for each benchmark item.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), k AS (SELECT doc_id, r, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM k),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM k) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (
  SELECT item, item_id, term, count(*)::BIGINT AS c FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
hit AS (
  SELECT item, item_id, k.r, k.doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN k USING (r), s GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM hit WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
