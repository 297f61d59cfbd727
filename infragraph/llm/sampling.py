"""Operator 1, SentencePiece encoding and decoding: Gumbel top-k without replacement.

Each text's segmentations into pieces form a lattice. A perturbed A* search draws ``k`` distinct ones, in
the order of their Gumbel-perturbed log probabilities: a sample without replacement under the lattice's
distribution, with the inclusion score ``1 - exp(-exp(log_prob - kappa))``, kept as a logarithm, where kappa is the perturbed
value of the best segmentation left out. The search bound of a partial path is exact (the backward log-sum
over its completions, perturbed top down), so the search walks straight to each next sample: at each
decision the edges not taken wait as one group, whose perturbed maximum is a Gumbel truncated at the
path's own value; the best group of all is opened next. Groups and draws are vectorised over a batch.

Pieces and decoding follow the model file (white space is U+2581, one such mark before the text, bytes for
characters without a piece). A BPE file holds merge ranks and no probabilities; ``scores="rank"`` gives the
piece of rank r the weight 1 / (r + ``offset``), ``scores="model"`` takes a unigram file's log
probabilities; ``sharpness`` multiplies the log weights. Every draw is a hash of the seed, the row key, the
sample's number and the character's place, so results do not depend on batches or partitions.

Defined results: null and empty texts have one segmentation, the empty one, with log probability 0 and
inclusion 1; a text with fewer than ``k`` segmentations gives them all, each with inclusion 1; rows with
equal keys and texts give equal samples. Decoding gives back the text, but for U+2581 in a text, which
decodes to a space as in the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infragraph.llm.common import slices
from infragraph.llm.language_id import Table

MARK, NEWLINE = 0x2581, 10
#: No character.
OUTSIDE = 0x110000
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95


def mixed(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(keys: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from row keys, places and a salt."""
    with np.errstate(over="ignore"):
        if salt >= 64:
            keys = mixed(keys + np.uint64(salt >> 6) * GOLD)
        z = mixed(keys + (place.astype(np.uint64) * np.uint64(64) + np.uint64(salt & 63)) * GOLD)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Vocabulary:
    """Pieces of a model file: log weights, surfaces, a table over all prefixes of pieces, and its rows for single characters.

    ``piece`` has the piece of each of the table's rows, -1 for a mere prefix; its last is for what the table has not.
    """

    weight: np.ndarray
    surface: list[bytes]
    byte_ids: np.ndarray
    table: Table
    piece: np.ndarray
    single: np.ndarray
    longest: int
    splits: bool

    @classmethod
    def load(cls, path: str, scores: str = "rank", offset: float = 10.0, sharpness: float = 1.0) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        weight = np.full(n, -np.log(len(order) + offset))
        if scores == "rank":
            weight[order] = -np.log(np.arange(len(order)) + offset)
            weight -= np.log(np.exp(weight[order]).sum())
        else:
            weight[order] = [sp.get_score(i) for i in order]
            weight[[i for i in range(n) if sp.is_byte(i)]] = min(weight[order], default=0.0) - 10
        byte_ids = np.zeros(256, np.int32)
        surface = [t.replace("▁", " ").encode() for t in text]
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(text[i][1:-1], 16)] = i
                surface[i] = bytes([int(text[i][1:-1], 16)])
            elif sp.is_control(i):
                surface[i] = b""
        found: dict[int, int] = {}
        for i in plain:
            h = 0
            for j, c in enumerate(text[i]):
                h = (h * BASE + ord(c) + 1) % 2**64
                if j + 1 < len(text[i]):
                    found.setdefault(h, -1)
            found[h] = i
        keys = np.array(list(found), np.uint64)
        table = Table(keys)
        single = table.find(np.arange(1, 0x110001, dtype=np.uint64))
        splits = not any("\n" in text[i] or "▁" in text[i].lstrip("▁") for i in plain)
        return cls(weight * sharpness, surface, byte_ids, table, np.array([*found.values(), -1], np.int32), single, max(len(text[i]) for i in plain), splits)


@lru_cache(maxsize=1)
def _loaded(path: str, changed: int, scoring: tuple) -> Vocabulary:
    return Vocabulary.load(path, **dict(scoring))


def vocabulary(path: str, **scoring) -> Vocabulary:
    """The vocabulary of a file, read once by each worker until the file changes."""
    return _loaded(path, os.stat(path).st_mtime_ns, tuple(sorted(scoring.items())))


class Lattice:
    """The lattices of all distinct words of a batch, joined; a word runs from node to node up to its end.

    No piece goes over a word's border, so a text's lattice is the chain of its words' lattices.
    """

    def __init__(self, vocab: Vocabulary, points: np.ndarray, lengths: np.ndarray):
        words = len(lengths)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(words), lengths)
        node = (np.arange(len(points)) + word).astype(np.int32)  # one node more for each word: its end
        self.first = (ends - lengths + np.arange(words)).astype(np.int32)
        self.is_end = np.zeros(len(points) + words, bool)
        self.is_end[ends + np.arange(words)] = True
        self.point = np.full(len(self.is_end), OUTSIDE, np.uint32)
        self.point[node] = points
        src, dst, piece, rank = [], [], [], []
        plus, seen = self.point + np.uint64(1), np.zeros(len(self.is_end), np.int32)  # edges of each node so far
        live, h, at = node, plus[node], vocab.single[points]
        for n in range(1, vocab.longest + 1):
            if n > 1:
                with np.errstate(over="ignore"):
                    h = h * np.uint64(BASE) + plus[live + (n - 1)]
                at = vocab.table.find(h)
            got = vocab.piece[at]
            if n == 1:
                got = np.where(got < 0, np.int32(-2), got)  # no piece for the character: its bytes
            hit = np.flatnonzero(got != -1)
            own = live[hit]
            src.append(own)
            dst.append(own + np.int32(n))
            piece.append(got[hit])
            rank.append(seen[own])
            seen[own] += 1
            go = np.flatnonzero(at >= 0)  # no piece holds what stands at a word's end
            live, h = live[go], h[go]
        # edges by node and then by length: each has its place from the number of its node's edges
        self.start = np.r_[0, np.cumsum(seen)].astype(np.int32)
        self.src = np.repeat(np.arange(len(seen), dtype=np.int32), seen)
        self.dst, self.piece = np.empty_like(self.src), np.empty_like(self.src)
        for own, to, got, k in zip(src, dst, piece, rank, strict=True):
            spot = self.start[own] + k
            self.dst[spot], self.piece[spot] = to, got
        self.width = self.dst - self.src
        size = np.ones(len(self.src), np.int32)
        raw = np.flatnonzero(self.piece == -2)
        c = self.point[self.src[raw]]
        size[raw] = 1 + (c > 0x7F).astype(np.int32) + (c > 0x7FF) + (c > 0xFFFF)
        self.n_ids = size
        weight = vocab.weight[self.piece]
        weight[raw] = vocab.weight[vocab.byte_ids[0]] * size[raw]
        beta = np.zeros(len(self.is_end))
        most = int(lengths.max()) if words else 0
        reach = np.zeros(len(self.is_end), np.uint16 if most < 1 << 16 else np.int64)  # of 16 bits: sorted by counting
        reach[node] = np.repeat(ends, lengths) - np.arange(len(points))  # characters up to the word's end
        level = reach[self.src]
        by = np.argsort(level, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(level, minlength=most + 1))]
        for lo, hi in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), strict=True):
            if hi > lo:
                e = by[lo:hi]
                s = self.src[e]
                new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                beta[s[new]] = np.logaddexp.reduceat(weight[e] + beta[self.dst[e]], new)
        self.log_q = weight + beta[self.dst] - beta[self.src]
        q = np.exp(self.log_q)
        total = np.cumsum(q)
        self.upto = total - np.r_[0.0, total][self.start[:-1]][self.src]
        self.upto[self.start[1:][seen > 0] - 1] = 2.0  # rounding
        only = (seen == 1)[self.src]
        with np.errstate(divide="ignore"):
            self.log_rest = np.log1p(-np.minimum(q, 1.0))
        self.log_rest[only] = -np.inf
        self.log_q[only] = 0.0
        # piece ids of each edge, bytes written out
        self.id_start = np.cumsum(size, dtype=np.int32) - size
        self.ids = np.repeat(self.piece, size)
        for e in raw:
            b = chr(int(self.point[self.src[e]])).encode("utf-8", "surrogatepass")
            self.ids[self.id_start[e] : self.id_start[e] + len(b)] = vocab.byte_ids[list(b)]

    def walk(self, nodes: np.ndarray, keys: np.ndarray, places: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from ``nodes`` to their words' ends: edges, path by path, and the edges of each path."""
        who = np.flatnonzero(~self.is_end[nodes])
        count = np.zeros(len(nodes), np.int64)
        steps = []
        at, place, key = nodes[who], places[who], keys[who]
        while len(who):
            u = uniform(key, place, salt)
            e = self.start[at]
            more = np.flatnonzero(self.upto[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.upto[e[more]] <= u[more]]
            steps.append((who, e))
            count[who] += 1
            to = self.dst[e]
            place = place + (to - at)
            go = np.flatnonzero(~self.is_end[to])
            who, at, place, key = who[go], to[go], place[go], key[go]
        offset = np.cumsum(count) - count
        edges = np.zeros(int(count.sum()), np.int64)
        for level, (who, e) in enumerate(steps):
            edges[offset[who] + level] = e
        return edges, count


def truncated(loc: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at ``loc``, given that they are at most ``bound``."""
    with np.errstate(invalid="ignore"):
        g = loc - np.logaddexp(loc - bound, np.log(-np.log(u)))
    return np.where(np.isneginf(loc), -np.inf, g)


class Batch:
    """The texts of a batch, cut into words; and the samples drawn so far."""

    def __init__(self, vocab: Vocabulary, texts: list[str], keys: np.ndarray):
        self.keys = keys
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in marked], np.int64)
        begin = np.cumsum(size) - size
        if vocab.splits:
            mark, line = points == MARK, points == NEWLINE
            cut = line.copy()
            cut[1:] |= (mark[1:] & ~mark[:-1]) | line[:-1]
        else:
            cut = np.zeros(len(points), bool)
        cut[begin[size > 0]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.r_[start, len(points)])
        # distinct words by a polynomial hash of their characters and their length
        with np.errstate(over="ignore"):
            power = np.cumprod(np.r_[np.uint64(1), np.full(max(len(points), 1), np.uint64(BASE))].astype(np.uint64))
            inverse = np.cumprod(np.r_[np.uint64(1), np.full(max(len(points), 1), np.uint64(pow(BASE, -1, 2**64)))].astype(np.uint64))
            summed = np.r_[np.uint64(0), np.cumsum(mixed(points.astype(np.uint64) + GOLD) * power[: len(points)])].astype(np.uint64)
            name = mixed((summed[start + length] - summed[start]) * inverse[start] + length.astype(np.uint64) * GOLD)
        _, at, kind = np.unique(name, return_index=True, return_inverse=True)
        self.lattice = Lattice(vocab, points[_spread(start[at], length[at])], length[at])
        self.doc = np.searchsorted(begin, start, side="right") - 1 if len(start) else np.zeros(0, np.int64)
        # texts of size 0 share their begin with the text after them; the last of equal begins is the owner
        self.word_node = self.lattice.first[kind]
        self.word_place = start - begin[self.doc] if len(start) else start
        self.word_from = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def samples(self, k: int) -> list[dict[str, np.ndarray]]:
        """Up to ``k`` rounds: for each the texts it gave a sample, with edges and scores."""
        lat, n = self.lattice, len(self.keys)
        texts = np.arange(n)
        bound = -np.log(-np.log(uniform(self.keys, np.zeros(n, np.int64), 0)))
        edges, count = lat.walk(self.word_node, self.keys[self.doc], self.word_place, 1)
        per = np.bincount(self.doc, count, n).astype(np.int64)
        place = self._places(edges, texts, per)
        out = [self._sample(texts, edges, per, place, np.zeros(n, np.int64), bound, 2)]
        taken: dict[tuple[int, int, int], list[int]] = {}
        for r in range(1, k + 1):
            best = np.full(n, -np.inf)
            where = np.zeros((n, 2), np.int64)
            for j, s in enumerate(out):
                full = s["per"] > 0
                if not full.any():
                    continue
                top = np.full(len(s["texts"]), -np.inf)
                top[full] = np.maximum.reduceat(s["group"], s["offset"][full])
                wins = np.flatnonzero(top > best[s["texts"]])
                best[s["texts"][wins]] = top[wins]
                where[s["texts"][wins]] = np.stack([np.full(len(wins), j), wins], axis=1)
            if r == k:
                break
            go = np.flatnonzero(best > -np.inf)
            if not len(go):
                break
            out.append(self._branch(out, go, where[go], best[go], taken, r))
        for s in out:
            with np.errstate(over="ignore"):
                ahead = s["log_prob"] - best[s["texts"]]
                with np.errstate(divide="ignore"):
                    s["log_inclusion"] = np.where(ahead < -30, ahead, np.log(-np.expm1(-np.exp(np.clip(ahead, -30, 30)))))
        return out

    def _places(self, edges: np.ndarray, texts: np.ndarray, per: np.ndarray) -> np.ndarray:
        """The character place of each decision in its text."""
        width = self.lattice.width[edges]
        total = np.cumsum(width) - width
        first = (np.cumsum(per) - per)[per > 0]
        return total - np.repeat(total[first], per[per > 0]) if len(edges) else total

    def _sample(self, texts, edges, per, place, keep, bound, salt) -> dict[str, np.ndarray]:
        """A round's samples; groups are set only from decision ``keep`` of each text on."""
        lat = self.lattice
        offset = np.cumsum(per) - per
        log_q = lat.log_q[edges]
        total = np.cumsum(log_q) - log_q
        before = total - np.repeat(total[offset[per > 0]], per[per > 0]) if len(edges) else total
        group = truncated(before + lat.log_rest[edges], np.repeat(bound, per), uniform(np.repeat(self.keys[texts], per), place, salt))
        rank = np.arange(len(edges)) - np.repeat(offset, per)
        group[rank < np.repeat(keep, per)] = -np.inf
        log_prob = np.zeros(len(texts))
        log_prob[per > 0] = np.add.reduceat(log_q, offset[per > 0]) if len(edges) else 0
        return {"texts": texts, "edges": edges, "per": per, "offset": offset, "place": place, "before": before, "group": group, "log_prob": log_prob, "perturbed": bound}

    def _branch(self, out, texts, where, bound, taken, r) -> dict[str, np.ndarray]:
        """Opens the best group of each text: another edge at its decision, then a fresh path to the end."""
        lat = self.lattice
        heads, nodes, places, owner, ahead, closed = [], [], [], [], np.zeros(len(texts), np.int64), []
        pick = uniform(self.keys[texts], np.zeros(len(texts), np.int64), 4 * r)
        again = uniform(self.keys[texts], np.zeros(len(texts), np.int64), 4 * r + 1)
        for i, (t, (j, row)) in enumerate(zip(texts.tolist(), where.tolist(), strict=True)):
            s = out[j]
            lo = int(s["offset"][row])
            d = lo + int(np.argmax(s["group"][lo : lo + int(s["per"][row])]))
            e = int(s["edges"][d])
            used = taken.setdefault((j, row, d), [e])
            node = int(lat.src[e])
            free = [x for x in range(int(lat.start[node]), int(lat.start[node + 1])) if x not in used]
            share = np.cumsum(np.exp(lat.log_q[free]))
            new = free[min(int(np.searchsorted(share, pick[i] * share[-1], side="right")), len(free) - 1)]
            used.append(new)
            rest = [x for x in free if x != new]
            loc = float(s["before"][d] + np.log(np.exp(lat.log_q[rest]).sum())) if rest else -np.inf
            closed.append((j, d, loc))
            heads += [s["edges"][lo:d], [new]]
            ahead[i] = d - lo + 1
            place = int(s["place"][d])
            lo_w, hi_w = self.word_from[t], self.word_from[t + 1]
            w = lo_w + int(np.searchsorted(self.word_place[lo_w:hi_w], place, side="right"))
            nodes += [lat.dst[new : new + 1], self.word_node[w:hi_w]]
            places += [[place + int(lat.dst[new]) - node], self.word_place[w:hi_w]]
            owner.append(1 + hi_w - w)
        # the groups that were opened, less the edge taken; a text has one, so none was read meanwhile
        for (j, d, _), g in zip(closed, truncated(np.array([x[2] for x in closed]), bound, again).tolist(), strict=True):
            out[j]["group"][d] = g
        owner = np.repeat(np.arange(len(texts)), owner)
        tail, count = lat.walk(np.concatenate(nodes), self.keys[texts][owner], np.concatenate(places), 4 * r + 2)
        per_tail = np.bincount(owner, count, len(texts)).astype(np.int64)
        per = ahead + per_tail
        edges = np.zeros(int(per.sum()), np.int64)
        begin = np.cumsum(per) - per
        edges[_spread(begin, ahead)] = np.concatenate(heads)
        edges[_spread(begin + ahead, per_tail)] = tail
        return self._sample(texts, edges, per, self._places(edges, texts, per), ahead, bound, 4 * r + 3)

    def ids(self, sample: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a round's samples, and how many each has."""
        lat, e = self.lattice, sample["edges"]
        sizes = lat.n_ids[e]
        if int(sizes.sum()) == len(sizes):
            return lat.ids[lat.id_start[e]], sample["per"]
        flat = lat.ids[_spread(lat.id_start[e], sizes)]
        owner = np.repeat(np.arange(len(sample["texts"])), sample["per"])
        return flat, np.bincount(owner, sizes, len(sample["texts"])).astype(np.int64)


def row_keys(ids: list, seed: int) -> np.ndarray:
    """A 64-bit key for each row key."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest("\0" if i is None else str(i), seed) for i in ids], np.uint64)


def decoded(surfaces: pa.Array, lists: pa.ListArray) -> list[bytes | None]:
    """The text of each list of piece ids as bytes, without the mark before the text; null for null."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    parts = surfaces.take(lists.flatten())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), parts), b"")
    return [(t[1:] if t[:1] == b" " else t) if ok else None for t, ok in zip(joined.to_pylist(), lists.is_valid().to_pylist(), strict=True)]


SAMPLES = "sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_hash long, round_trip boolean"


def encode_samples(docs: DataFrame, model_path: str, k: int = 2, seed: int = 1, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 768 << 10, **scoring) -> DataFrame:
    """Rows (id_col, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_hash, round_trip), up to ``k`` a text; map-only.

    With ``keep_ids`` the piece ids follow as ``ids``. ``round_trip`` tells whether they decode to the whole
    text (spaces for U+2581). Memory follows ``max_bytes``, or the longest single text: about 100 bytes for
    each character.
    """
    import xxhash

    columns = [id_col, *(c.split()[0] for c in SAMPLES.split(", ")), *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path, **scoring)
        surfaces = pa.array(vocab.surface, pa.binary())
        for part in slices(batches, "text", max_bytes=max_bytes, max_rows=500):
            texts = [t or "" for t in part.column(1).to_pylist()]
            raw = [t.replace("▁", " ").encode() for t in texts]
            batch = Batch(vocab, texts, row_keys(part.column(0).to_pylist(), seed))
            for r, s in enumerate(batch.samples(k)):
                flat, sizes = batch.ids(s)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
                same = [t == raw[i] for t, i in zip(decoded(surfaces, lists), s["texts"].tolist(), strict=True)]
                names = np.array([xxhash.xxh64_intdigest(flat[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.uint64).view(np.int64)
                out = [part.column(0).take(pa.array(s["texts"])), pa.array(np.full(len(sizes), r, np.int32)), pa.array(sizes), *(pa.array(s[c]) for c in ("log_prob", "perturbed", "log_inclusion")), pa.array(names), pa.array(same, pa.bool_())]
                yield pa.record_batch([*out, *([lists] if keep_ids else [])], columns)

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {SAMPLES}" + (", ids array<int>" if keep_ids else ""))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with piece ids replaced by their text; a null list gives a null text; map-only.

    Bytes that are no UTF-8 become U+FFFD, as in the library.
    """
    keep = [c for c in rows.columns if c not in (ids_col, out_col)]
    base = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).cast("array<int>").alias("ids_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = pa.array(Vocabulary.load(model_path).surface, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t if t is None else t.decode("utf-8", "replace") for t in decoded(surfaces, part.column(part.num_columns - 1))]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{schema}, `{out_col}` string")
