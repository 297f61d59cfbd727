"""Operator 5, language ID: prediction by partial matching over bytes.

Training counts, per language, how often each byte follows each context of 0 to ``order`` bytes. Escapes
follow method C: in a context seen ``t`` times with ``d`` distinct followers, a seen byte costs
``-log2(n / (t + d))`` bits and a new one first pays ``-log2(d / (t + d))``, then goes to the context one
byte shorter; a context never seen costs nothing to leave; below order 0 all 256 bytes are alike. The
statistics are frozen before scoring. A text goes to the language with the shortest code length.

The model is a bounded object: it is fitted on at most ``per_language`` rows of each language, fewer if there
are very many languages, the rows with the smallest hashes of the learning fold, so that its size follows
these parameters and the number of languages and not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from infragraph.llm.common import slices

LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Languages whose costs lie side by side.
GROUP = 8


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Table:
    """Vectorised map from 64-bit keys to row numbers: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, EMPTY)
        self.at = np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.at[slot[won]] = keys[todo[won]], todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is missing."""
        slot = self._slot(keys)
        got = self.keys[slot]
        hit = got == keys
        out = np.where(hit, self.at[slot], np.int32(-1))
        todo = np.flatnonzero(~hit & (got != EMPTY))
        keys, slot = keys[todo], (slot[todo] + 1) & self.mask
        while len(todo):
            got = self.keys[slot]
            hit = got == keys
            out[todo[hit]] = self.at[slot[hit]]
            go = ~hit & (got != EMPTY)
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & self.mask
        return out


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, ``order`` zero bytes before each; and where each text starts."""
    pad = bytes(order)
    data = np.frombuffer(pad + pad.join(texts), np.uint8) if texts else np.zeros(0, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    return data, np.cumsum(sizes + order) - sizes


def _keys(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The byte at each position and the ``order`` before it, oldest byte highest."""
    key = data[at].astype(np.uint64)
    for back in range(1, order + 1):
        key |= data[at - back].astype(np.uint64) << np.uint64(8 * back)
    return key


@dataclass
class Ppm:
    """Frozen context trees of all languages: for each order, the followers and contexts that any has seen.

    ``costs[k]`` holds for each (context, byte) its bits in every language with escapes resolved,
    ``leave[k]`` for each context the bits of its escape, 0 where a language has not seen it.
    """

    languages: list[str]
    order: int
    seen: list[Table]
    costs: list[np.ndarray]
    contexts: list[Table]
    leave: list[np.ndarray]

    @classmethod
    def fit(cls, texts: dict[str, list[bytes]], order: int = 4) -> Ppm:
        """``order`` is at most 6, as a context and its follower are packed in a 64-bit key."""
        languages = sorted(texts)
        model = cls(languages, order, [], [], [], [])
        spots = []
        for name in languages:
            data, starts = _joined(texts[name], order)
            real = np.ones(len(data), bool)
            for back in range(1, order + 1):
                real[starts - back] = False
            spots.append((data, np.flatnonzero(real)))
        for k in range(order + 1):
            counted = [np.unique(_keys(data, at, k), return_counts=True) for data, at in spots]
            pairs = np.unique(np.concatenate([u for u, _ in counted])) if counted else np.zeros(0, np.uint64)
            n = np.zeros((len(pairs), len(languages)))
            for j, (u, c) in enumerate(counted):
                n[np.searchsorted(pairs, u), j] = c
            ctx, of = np.unique(pairs >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(ctx), len(languages))), np.zeros((len(ctx), len(languages)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(n / (total + distinct)[of])
            shorter = model.bits(pairs & np.uint64((1 << 8 * k) - 1), k - 1)
            model.costs.append(np.where(n > 0, own, leave[of] + shorter))
            model.leave.append(leave)
            model.seen.append(Table(pairs))
            model.contexts.append(Table(ctx))
        return model

    @property
    def size(self) -> int:
        """Bytes of its arrays."""
        return sum(a.nbytes for a in (*self.costs, *self.leave)) + sum(t.keys.nbytes + t.at.nbytes for t in (*self.seen, *self.contexts))

    def bits(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of each key's last byte after its ``k`` bytes of context, a column for each language."""
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        row = self.seen[k].find(keys)
        out = self.costs[k][row] if len(self.costs[k]) else np.zeros((len(keys), len(self.languages)))
        if len(miss := np.flatnonzero(row < 0)):
            rest = keys[miss]
            ctx = self.contexts[k].find(rest >> np.uint64(8))
            low = self.bits(rest & np.uint64((1 << 8 * k) - 1), k - 1)
            if len(self.leave[k]):
                low = low + np.where((ctx >= 0)[:, None], self.leave[k][ctx], 0.0)
            out[miss] = low
        return out

    def code_lengths(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Bits of each whole text in each language; long inputs are taken block by block."""
        data, starts = _joined(texts, self.order)
        ends = starts + np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(data):
            return out
        owner = np.repeat(np.arange(len(texts)), ends - starts)
        at = np.arange(len(owner)) + self.order * (owner + 1)
        for i in range(0, len(at), block):
            who = owner[i : i + block]
            bits = self.bits(_keys(data, at[i : i + block], self.order), self.order).astype(np.float64)
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            out[who[first]] += np.add.reduceat(bits, first)
        return out


@dataclass
class Languages:
    """Models of ``GROUP`` languages each, in the order of names; what one language has seen takes no room in other groups."""

    groups: list[Ppm]

    @classmethod
    def fit(cls, texts: dict[str, list[bytes]], order: int = 4) -> Languages:
        names = sorted(texts)
        return cls([Ppm.fit({n: texts[n] for n in names[i : i + GROUP]}, order) for i in range(0, len(names), GROUP)])

    @property
    def languages(self) -> list[str]:
        return [n for g in self.groups for n in g.languages]

    @property
    def size(self) -> int:
        return sum(g.size for g in self.groups)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([g.code_lengths(texts) for g in self.groups], axis=1)


def fit_language_model(docs: DataFrame, learn: Column, per_language: int = 150, most_rows: int = 9600, max_chars: int = 50_000, order: int = 4, max_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """The frozen model from a bounded sample of the rows where ``learn`` holds.

    At most ``per_language`` rows of each language are read, or ``most_rows`` in all, but 4 of each language at
    least: whole texts of up to ``max_chars`` characters, the rows with the smallest hashes, so reruns agree. A
    language of longer texts only is learned from its shortest one.

    The model goes to all tasks, so its size is bounded too. An eighth of the rows is fitted first; if eight times that is over ``max_bytes``, each language keeps so many rows fewer, 2 at least.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    long = F.length("text") > max_chars
    counts = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count_if(~long).alias("n"), F.min(F.length("text")).alias("least")).collect()}
    if not counts:
        return Languages([])
    per_language = min(per_language, max(4, most_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for name, r in counts.items() for x in (name, min(1.0, (per_language * 2 + 50) / max(1, r["n"])))])
    alone = F.create_map(*[F.lit(x) for name, r in counts.items() for x in (name, 0 if r["n"] else r["least"])])
    unit = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / F.lit(1 << 30)
    few = rows.where((~long & (unit < share[F.col("lang")])) | (F.length("text") == alone[F.col("lang")]))
    ranked = few.selectExpr("*", "row_number() over (partition by lang order by xxhash64(id, 'fit'), id, text) as place").where(F.col("place") <= F.when(long, 1).otherwise(per_language))
    texts: dict[str, list[bytes]] = {}
    for r in sorted(ranked.select("lang", "place", "text").collect(), key=lambda r: (r["lang"], r["place"])):
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    if (most := 8 * Languages.fit({k: t[: max(1, len(t) // 8)] for k, t in texts.items()}, order).size) > max_bytes:
        texts = {k: t[: max(2, len(t) * max_bytes // most)] for k, t in texts.items()}
    return Languages.fit(texts, order)


def identify(docs: DataFrame, model: Languages, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte`` added (names under ``prefix``); map-only.

    ``score`` is the posterior share of the chosen language under equal priors, from 0 to 1. The code length
    per byte tells whether the text is in that language at all: over 8 it is longer than the plain bytes. A
    null text, a text without any letter, and every text under a model without languages give ``und``, 0 and
    null. Equal code lengths give the first language by name. Existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = (f"{prefix}lang_pred", f"{prefix}score", f"{prefix}bits_per_byte")
    keep = [c for c in docs.columns if c not in names]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm: Languages = shared.value
        at = keep.index(text_col)
        for part in slices(batches, text_col):
            texts = part.column(at).to_pylist()
            told = [i for i, t in enumerate(texts) if t and LETTER.search(t) and ppm.languages]
            lang, score, length = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if told:
                raw = [texts[i].encode() for i in told]
                bits = ppm.code_lengths(raw)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                for k, (i, b, s) in enumerate(zip(told, best, share, strict=True)):
                    lang[i], score[i], length[i] = ppm.languages[b], float(s), float(bits[k, b]) / len(raw[k])
            yield pa.record_batch([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(length, pa.float64())], [*part.schema.names, *names])

    schema = T.StructType([*base.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    return base.mapInArrow(run, schema)
