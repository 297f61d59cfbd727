"""Operator 12, token-ID output: Re-Pair grammars over shards of token ids, with random access.

Documents go, in the order of their ids, into shards of about a million token ids. A shard's ids are written as a
grammar: in rounds, the pairs of neighbouring symbols that occur most often are replaced by new symbols, down to
pairs of ``least`` places. A round takes all pairs down to a quarter of the most frequent one, most
frequent first, of which none may begin with a symbol that another ends with; so no two replacements overlap. Pairs
never cross from one document into the next.

The files are Parquet, a row for each shard: ``part`` and ``shard`` in order, ``first``, the ids before it in its
part, the first and last document id, ``docs`` (doc_id, first, n_tokens) and ``blocks``. A block holds ``left`` and
``right`` of each rule, ``lengths``, how many ids each rule stands for, and ``symbols``, as little-endian integers
of ``width`` bytes (rules of four). A document longer than a block goes on in the next block of its shard. With the
lengths, the symbols that hold ids a to b are found without decoding what is before them.

A task holds one shard, and a memo of at most ``MEMO`` words that it met: a tokenizer that drops white space and cuts
there first gives each word its ids wherever it stands, so a word is encoded once. Other tokenizers, and texts with
marks of added tokens, are encoded whole.

Defined results: a null text counts as the empty one, which has the end id alone; null ids come first; rows of equal
ids are ordered by a hash of the text; repeated rows are written as often as they come; an empty table gives an empty
set of files; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.llm.common import slices

MEMO = 800_000
#: Fixed value: the pattern of the tokenizer whose matches hold no white space and depend on nothing around it.
SPACE_FREE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that may end a word, and letters that the tokenizer neither changes nor parts; it cuts between the two.
MARKS = b".,;:!?"
LETTERS = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c) + "]+")
_TABLE_BITS = 18
BLOCK = "struct<n_ids:int,base:int,width:int,left:binary,right:binary,lengths:binary,symbols:binary>"
_BLOCK_TYPE = pa.struct([("n_ids", pa.int32()), ("base", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in ("left", "right", "lengths", "symbols"))])


def _byte_letters() -> dict[int, str]:
    """Each letter as the byte-level alphabet writes its UTF-8: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0x250)}


BYTE_LETTERS = _byte_letters()


# grammar ------------------------------------------------------------------------------------------


def _chosen(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of pairs (left << 32 | right), most frequent first, those of which none begins with a symbol another ends with."""
    side: dict[int, int] = {}
    out = []
    for pair in pairs[np.lexsort((pairs, -counts))].tolist():
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a == b:
            if a not in side:
                side[a] = 2
                out.append(pair)
        elif side.get(a, 0) == 0 and side.get(b, 1) == 1:
            side[a], side[b] = 0, 1
            out.append(pair)
    return np.array(out, np.int64)


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A place among 2 ** _TABLE_BITS for each pair of 32-bit symbols."""
    return (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - _TABLE_BITS)


def compress(ids: np.ndarray, joined: np.ndarray, base: int, least: int = 16) -> dict[str, np.ndarray]:
    """Grammar of ``ids``, all below ``base``; ``joined[i]`` tells whether i and i + 1 may become one symbol.

    Returns left, right and lengths of the rules, of which rule r is symbol ``base + r``, and the symbols.
    """
    s, joined = ids.astype(np.uint32), joined.copy()
    joined[-1:] = False
    left, right, most, n_rules, floor = [], [], None, 0, least + 1
    while floor > least:
        slot = _slot(s[:-1], s[1:])
        table = np.bincount(slot, minlength=1 << _TABLE_BITS)  # pairs across a break count too: it only sifts
        # at first as many as the fullest slot, which is not less than the most frequent pair
        floor = max(least, (int(table.max()) if most is None else most) // 4)
        most = floor
        at = np.flatnonzero((table >= floor)[slot] & joined[:-1])
        pairs, slot = s[at].astype(np.int64) << 32 | s[at + 1], slot[at]
        kinds = np.sort(pairs)
        begins = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[begins, len(kinds)])
        kinds, counts = kinds[begins][counts >= floor], counts[counts >= floor]
        new = _chosen(kinds, counts)
        if not len(new):
            continue
        # of pairs that share a slot, the more frequent one now and the others in a later round
        own, first = np.unique(_slot((new >> 32).astype(np.uint32), new.astype(np.uint32)), return_index=True)
        new = new[first]
        rule = np.full(1 << _TABLE_BITS, -1, np.int32)
        rule[own] = np.arange(len(new))
        hit = rule[slot]
        same = np.flatnonzero(new[hit] == pairs)  # a slot without a rule gives the last one, which is equal nowhere else
        at, hit, pairs = at[same], hit[same], pairs[same]
        # of a symbol that repeats, every other pair
        twin = np.flatnonzero((pairs >> 32) == (pairs & 0xFFFFFFFF))
        if len(twin):
            begins = np.r_[True, (np.diff(at[twin]) != 1) | (np.diff(hit[twin]) != 0)]
            start = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            ok = np.ones(len(at), bool)
            ok[twin] = (np.arange(len(twin)) - start) % 2 == 0
            at, hit = at[ok], hit[ok]
        left.append(new >> 32)
        right.append(new & 0xFFFFFFFF)
        s[at] = base + n_rules + hit
        joined[at] = joined[at + 1]
        kept = np.ones(len(s), bool)
        kept[at + 1] = False
        s, joined = s[kept], joined[kept]
        n_rules += len(new)
    l, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return {"left": l, "right": r, "lengths": _lengths(l, r, base), "symbols": s}


def _lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; rules only use symbols before them."""
    out = [0] * len(left)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[i] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return np.array(out, np.int64)


class Grammar:
    """A block that was read: gives the ids from a to b."""

    def __init__(self, block: dict):
        self.base = block["base"]
        left, right, lengths = (np.frombuffer(block[c], "<u4").astype(np.int64) for c in ("left", "right", "lengths"))
        self.symbols = np.frombuffer(block["symbols"], f"<u{block['width']}").astype(np.int64)
        self.n_ids, self.lengths = block["n_ids"], lengths
        # all rules written out, one behind the other
        flat = np.arange(len(left), dtype=np.int64) + self.base
        while (rule := flat >= self.base).any():
            end = np.cumsum(1 + rule)
            of = flat[rule] - self.base
            flat = np.repeat(flat, 1 + rule)
            flat[end[rule] - 2], flat[end[rule] - 1] = left[of], right[of]
        self.flat, self.start = flat, np.cumsum(lengths) - lengths

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.base, 1, self.lengths[np.maximum(symbols - self.base, 0)])

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a to b (not included) as little-endian 32-bit integers; only the symbols that hold them are written out."""
        symbols, sizes, skip = self.symbols, self._sizes(self.symbols), 0
        b = self.n_ids if b is None else b
        if a or b < self.n_ids:
            ends = np.cumsum(sizes)
            i, j = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
            skip = a - (int(ends[i - 1]) if i else 0)
            symbols, sizes = symbols[i:j], sizes[i:j]
        out = np.repeat(symbols, sizes)
        rule = np.flatnonzero(sizes > 1)
        if len(rule):
            own = sizes[rule]
            begin = np.cumsum(own) - own
            inner = np.arange(int(own.sum())) - np.repeat(begin, own)
            first = np.cumsum(sizes)[rule] - own
            out[np.repeat(first, own) + inner] = self.flat[np.repeat(self.start[symbols[rule] - self.base], own) + inner]
        return out[skip : skip + b - a].astype("<u4")


# encoding -----------------------------------------------------------------------------------------


class _Memo(dict):
    """Number of each word; words asked for the first time wait in ``fresh``, and those that end with marks in ``split``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[tuple[int, str]] = []
        self.split: list[tuple[int, int, int]] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and LETTERS.fullmatch(stem.decode()):
            self.split.append((n, self[stem], self[word[len(stem) :]]))
        else:
            self.fresh.append((n, word.decode()))
        return n


class Encoder:
    """Token ids of texts as the library gives them, without added tokens, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            config = json.load(f)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        kinds = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
        cut = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and cut.get("pattern") == {"Regex": SPACE_FREE} and cut.get("behavior") == "Removed" and cut.get("invert")
        self.marks = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.memo, self.flat, self.first, self.n, self.used = _Memo(), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Ids of words, at the end of the arrays."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while len(self.memo) > len(self.n):
            self.first, self.n = np.resize(self.first, 2 * len(self.n)), np.resize(self.n, 2 * len(self.n))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[words], self.n[words] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)

    def _learn(self) -> None:
        """Ids of the words that wait. Words of plain letters are what the model itself gets to see, after the byte alphabet."""
        fresh, self.memo.fresh = self.memo.fresh, []
        plain = [LETTERS.fullmatch(w) is not None for _, w in fresh]
        found = [[t.id for t in self.model.tokenize(w.translate(BYTE_LETTERS))] if p else None for (_, w), p in zip(fresh, plain, strict=True)]
        rest = iter(self._whole([w for (_, w), p in zip(fresh, plain, strict=True) if not p]))
        found = [next(rest) if x is None else x for x in found]
        if fresh:
            n = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(np.array([i for i, _ in fresh]), n, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum())))
        split, self.memo.split = np.array(self.memo.split, np.int64).reshape(-1, 3), []
        if len(split):
            self._keep(split[:, 0], self.n[split[:, 1:]].sum(axis=1), self._ids(split[:, 1:].ravel()))

    def _ids(self, words: np.ndarray) -> np.ndarray:
        n = self.n[words]
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.first[words] - np.cumsum(n) + n, n)]

    def _key(self, text: bytes) -> bytes:
        """Lower case in ASCII, which the library does too: but not before marks that compose with one case only."""
        return text if b"\xcc" in text or b"\xcd" in text else text.lower()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number in each)."""
        plain = [self.by_word and not any(m in t for m in self.marks) for t in texts]
        whole = iter(self._whole([t.decode() for t, p in zip(texts, plain, strict=True) if not p]))
        if len(self.memo) > MEMO:
            self._forget()
        find, places = self.memo.__getitem__, []
        for t, p in zip(texts, plain, strict=True):
            words = self._key(t).split() if p else ()
            places.append(np.fromiter(map(find, words), np.int64, len(words)))
        self._learn()
        counts, out = np.zeros(len(texts), np.int64), []
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        ids, ends = self._ids(at), np.cumsum(self.n[at])
        words_end = np.cumsum([len(p) for p in places])
        sums = np.r_[0, ends][words_end] if len(texts) else counts
        counts = np.diff(np.r_[0, sums])
        if all(plain):
            return ids, counts
        begin = 0
        for i, p in enumerate(plain):
            own = ids[begin : begin + counts[i]] if p else np.array(next(whole), np.uint32)
            begin += counts[i]
            counts[i] = len(own)
            out.append(own)
        return np.concatenate(out), counts


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that its memo serves them all."""
    return Encoder(path)


# files --------------------------------------------------------------------------------------------


def _width(symbols: np.ndarray) -> int:
    return 2 if not len(symbols) or symbols.max() < 1 << 16 else 4


def _block(ids: np.ndarray, joined: np.ndarray, base: int) -> dict:
    g = compress(ids, joined, base)
    width = _width(g["symbols"])
    return {"n_ids": len(ids), "base": base, "width": width, **{c: g[c].astype("<u4").tobytes() for c in ("left", "right", "lengths")}, "symbols": g["symbols"].astype(f"<u{width}").tobytes()}


def _writer(path: str, end_id: int, shard_ids: int, id_type: pa.DataType) -> object:
    """Rows (part, id, text), in order, to shards."""
    doc_type = pa.struct([("doc_id", id_type), ("first", pa.int64()), ("n_tokens", pa.int64())])
    names = ["part", "shard", "first", "n_ids", "first_doc", "last_doc", "docs", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        docs: list[tuple] = []  # (id, ids) of the shard that is being filled
        held = shard = before = 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(x) for _, x in docs], np.int64)
            ids, joined = np.concatenate([x for _, x in docs]), np.ones(int(n.sum()), bool)
            joined[np.cumsum(n) - 1] = False
            blocks = [_block(ids[i : i + shard_ids], joined[i : i + shard_ids], tokens.size) for i in range(0, len(ids), shard_ids)]
            own = pa.array([d for d, _ in docs], id_type)
            listed = pa.StructArray.from_arrays([own, pa.array(np.cumsum(n) - n), pa.array(n)], fields=list(doc_type))
            rows = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), own[:1], own[-1:]]
            return pa.record_batch([*rows, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), listed), pa.array([blocks], pa.list_(_BLOCK_TYPE))], names)

        part = 0
        for batch in batches:
            for some in slices([batch], "text"):
                if not docs:
                    part = some.column(0)[0].as_py()
                ids, counts = tokens.encode(some.column("text").cast(pa.binary()).to_pylist())
                begin = 0
                for doc_id, k in zip(some.column("id").to_pylist(), counts.tolist(), strict=True):
                    if docs and held + k + 1 > shard_ids:
                        yield flush()
                        shard, before, docs, held = shard + 1, before + held, [], 0
                    docs.append((doc_id, np.append(ids[begin : begin + k], np.uint32(end_id))))
                    held, begin = held + k + 1, begin + k
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_ids: int = 1 << 20, part_bytes: int = 32 << 20, max_parts: int = 32_768, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of ``docs``, each document followed by ``end_id``, below ``path``, in the order of ids.

    Texts are shuffled once, into ranges of ids of about ``part_bytes``, at most ``max_parts`` (a larger corpus has
    longer ranges, which are streamed). Rows of one id go to as many ranges as they need: behind the id, rows are
    ordered by a hash of the text and, if that is equal too, dealt by their place in the input, which has to be
    the same if a task runs again, as it is for tables and checkpoints.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    size = base.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    parts = max(1, min(max_parts, -(-size // part_bytes)))
    dealt = base.repartitionByRange(int(parts), F.asc_nulls_first("id"), "hash", "deal").sortWithinPartitions(F.asc_nulls_first("id"), "hash", "deal")
    kind = base.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"part int, shard int, first long, n_ids long, first_doc {kind.simpleString()}, last_doc {kind.simpleString()}, docs array<struct<doc_id:{kind.simpleString()},first:bigint,n_tokens:bigint>>, blocks array<{BLOCK}>"
    rows = dealt.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(_writer(tokenizer_path, end_id, shard_ids, to_arrow_type(kind)), schema)
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``first`` counted over all files.

    The driver adds up one number for each part, of which there are at most ``max_parts``.
    """
    shards = spark.read.parquet(path)
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    firsts = np.cumsum([0] + [n for _, n in sums]).tolist()
    offsets = spark.createDataFrame([(p, f) for (p, _), f in zip(sums, firsts, strict=False)], "part int, offset long")
    return shards.join(F.broadcast(offsets), "part").withColumn("first", F.col("first") + F.col("offset")).drop("offset")


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) and, if asked for, ``ids``, decoded from the files; map-only.

    ``start`` is the number of ids of all documents before it; ``ids_crc32`` is of the ids as little-endian
    unsigned 32-bit integers.
    """
    shards = _shards(spark, path).select("first", "docs", "blocks")
    kind = shards.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, docs = batch.column("first")[i].as_py(), batch.column("docs")[i].values
                own, n = docs.field("first").to_numpy(), docs.field("n_tokens").to_numpy().tolist()
                crc, lists, at, ids, blocks = [], [], 0, np.zeros(0, "<u4"), iter(batch.column("blocks")[i])
                for k in n:
                    code, kept = 0, []
                    while k:
                        if at == len(ids):
                            ids, at = Grammar(next(blocks).as_py()).ids(), 0
                        some = ids[at : at + k]
                        code, at, k = zlib.crc32(some, code), at + len(some), k - len(some)
                        kept += [some] if with_ids else []
                    crc.append(code)
                    lists += [np.concatenate(kept)] if with_ids else []
                cols = [docs.field("doc_id"), pa.array(own + first), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(cols + ([pa.array(lists, pa.list_(pa.int64()))] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else []))

    return shards.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else ""))


def read_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows (start, n, ids) for rows (start, n) of ``wanted``: the ids at these places of all files, in pieces.

    Shards are met by ranges of places, without decoding others; in a shard only the symbols that hold the wanted ids are
    written out. A row of ``wanted`` that spans shards gives a piece for each, with its own ``start`` and ``n``. ``wanted`` is
    a list of look-ups that the caller bounds: it is broadcast.
    """
    shards = _shards(spark, path).select("first", "n_ids", "blocks")
    met = shards.join(F.broadcast(wanted.select(F.col("start").cast("long").alias("a"), (F.col("start") + F.col("n")).cast("long").alias("b"))), F.expr("a < first + n_ids and b > first"))
    pieces = met.select("blocks", "first", F.greatest("a", "first").alias("a"), F.least("b", F.expr("first + n_ids")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, a, b = (batch.column(c)[i].as_py() for c in ("first", "a", "b"))
                at, out = first, []
                for block in batch.column("blocks")[i]:
                    n = block["n_ids"].as_py()
                    low, high = max(a - at, 0), min(b - at, n)
                    if low < high:
                        out.append(Grammar(block.as_py()).ids(low, high))
                    at += n
                yield pa.record_batch([pa.array([a], pa.int64()), pa.array([b - a], pa.int64()), pa.array([np.concatenate(out)], pa.list_(pa.int64()))], ["start", "n", "ids"])

    return pieces.mapInArrow(run, "start long, n long, ids array<bigint>")
