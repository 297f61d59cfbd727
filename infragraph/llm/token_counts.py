"""Operator 8, token counts: a digest cache.

Each text is known by the SHA-256 digest of its content as the tokenizer's library normalises it, each
tokenizer by the digest of its file, library version and options. Counts live in a Parquet table ``(version,
digest, n_tokens)``; a run joins its digests to the stored counts, encodes only the distinct misses, and
appends them. Where a tokenizer looks for added tokens in the text as it is, that is what is digested.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); rows with equal texts share one
count; null and repeated ids are kept, one result row per input row; an empty table gives an empty result;
other input columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.llm.common import slices
from infragraph.plans.lineage import exists, release, scratch_path, stored

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its library and the options below: other counts, other version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    head = f"{library.__name__} {library.__version__} plain\n".encode()
    with open(path, "rb") as f:
        return hashlib.sha256(head + f.read()).hexdigest()


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts without begin, end or added special tokens, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _normaliser(path: str) -> Callable[[str], str] | None:
    """What the library does to a text before it is cut into tokens; None if counts may depend on more than that."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).normalize
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.normalizer is None or any(not t.normalized for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    return tokenizer.normalizer.normalize_str


def _digests(path: str, column: str, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the last column, the text, by its digest and its bytes; or, with ``keep``, sets the digest before the texts
    and drops those whose digest is among the task's last ``keep``, so that a hot text is shuffled once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalised, seen = _normaliser(path) or str, {}
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            found = [hashlib.sha256(normalised(t).encode()).digest() for t in texts]
            if not keep:
                yield pa.record_batch([part.column(0), pa.array(found, pa.binary()), pa.array([len(t.encode()) for t in texts], pa.int64())], [column, "digest", "n_bytes"])
                continue
            new = []
            for i, d in enumerate(found):
                if d not in seen:
                    seen[d] = None
                    new.append(i)
            while len(seen) > keep:
                del seen[next(iter(seen))]
            yield pa.record_batch([pa.array([found[i] for i in new], pa.binary()), part.column("text").take(pa.array(new, pa.int64()))], ["digest", "text"])

    return run


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of texts that come in order of their digests; a digest that comes again is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = _counter(path), None
        for part in slices(batches, "text", max_bytes=1 << 20, max_rows=256):
            digests = part.column("digest").to_pylist()
            new = [i for i, d in enumerate(digests) if d != (digests[i - 1] if i else last)]
            last = digests[-1]
            texts = part.column("text").take(pa.array(new, pa.int64())).to_pylist()
            yield pa.record_batch([pa.array([digests[i] for i in new], pa.binary()), pa.array(count(texts) if texts else [], pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """Stored counts (digest, n_tokens) of one tokenizer version, a digest once for each run that added it; None if there is no cache yet."""
    if not exists(spark, cache_path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit), one per row of ``docs``.

    ``cache_path`` is a folder all executors reach; None takes a fresh one below the shared folder, which no
    later run will find. Texts are shuffled once, by digest, and only those that no stored count answers.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-counts")
    version = tokenizer_version(tokenizer_path)
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = base.select("text").mapInArrow(_digests(tokenizer_path, "", keep=200_000), "digest binary, text string")
    known = read_cache(spark, cache_path, version)
    misses = texts.join(known, "digest", "left_anti") if known is not None else texts
    fresh = misses.repartition("digest").sortWithinPartitions("digest").mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    release(spark)
    kind = base.schema[0].dataType.simpleString()
    rows = stored(base.mapInArrow(_digests(tokenizer_path, id_col, keep=0), f"`{id_col}` {kind}, digest binary, n_bytes long"), "token-counts-rows")
    # of the cache only what this run asks for; written, so that the join of a frequent text can be split
    asked = read_cache(spark, cache_path, version).join(rows.select("digest").distinct(), "digest", "left_semi")
    counts = stored(asked.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts-known")
    return rows.join(counts, "digest", "left").select(F.col(f"`{id_col}`"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
