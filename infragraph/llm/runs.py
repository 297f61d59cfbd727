"""Operator 11, periodic runs: a suffix automaton with link-cut access over the words of a text.

A run is a stretch of consecutive words with smallest period q, at least ``min_repeats`` periods and
``min_words`` words long, that no neighbouring word extends. The automaton of the words is built once; then
each word is appended in turn by an access from its prefix's state to the root. The paths of the link-cut tree
are coloured with the end of the last occurrence of the words they spell, so the access meets a few segments of
one colour: the prefix that ends at word i shares its last ``len`` words with the one that ends at the segment's
colour e. If ``i - e <= len``, these words hold a square of period i - e. It is the smallest period, as a smaller
one would give a later end, and it appears at every i from a run's second period to its end: squares in a row are
one run, which begins ``len + period`` words before the first of them.

Only words that can be in a run go through the automaton: each word of a run occurs in it once a period, so a
stretch whose words occur less often is cut there, again and again. What is left holds every run whole.

Memory is linear in the longest such stretch: eight integers for each of its states, of which it has at most two a
word. The work is one map, without a shuffle.

Defined results: a null or blank text has no words and no runs; repeated rows, null and repeated ids are kept, one
result row per input row; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.llm.common import WORD, slices

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Automaton:
    """Suffix automaton of a sequence of words; state 0 is the empty sequence.

    Most states have one way on, which is kept in two arrays; ``more`` holds the other ways of a state.
    """

    def __init__(self, words: list[int]):
        self.link, self.length = [-1], [0]
        self._word, self._to = [-1], [0]
        self._more: dict[int, dict[int, int]] = {}
        self.prefix = [0]  # the state of each prefix
        for w in words:
            self._append(w)

    def _way(self, state: int, w: int) -> int | None:
        if self._word[state] == w:
            return self._to[state]
        more = self._more.get(state)
        return more.get(w) if more else None

    def _set(self, state: int, w: int, to: int) -> None:
        if self._word[state] in (w, -1):
            self._word[state], self._to[state] = w, to
        else:
            self._more.setdefault(state, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self._word.append(-1)
        self._to.append(0)
        return len(self.link) - 1

    def _append(self, w: int) -> None:
        at = self.prefix[-1]
        new = self._state(self.length[at] + 1, 0)
        while at >= 0 and (to := self._way(at, w)) is None:
            self._set(at, w, new)
            at = self.link[at]
        if at >= 0:
            if self.length[to] != self.length[at] + 1:
                long, to = to, self._state(self.length[at] + 1, self.link[to])
                self._word[to], self._to[to] = self._word[long], self._to[long]
                if long in self._more:
                    self._more[to] = dict(self._more[long])
                self.link[long] = to
                while at >= 0 and self._way(at, w) == long:
                    self._set(at, w, to)
                    at = self.link[at]
            self.link[new] = to
        self.prefix.append(new)


class LastEnds:
    """The automaton's link tree as a link-cut tree whose preferred paths carry the end of their last occurrence.

    Each path is a splay tree; its root holds the path's colour, -1 before the first occurrence, and in ``up`` the
    state above the path. States are numbered from 1 here, so that 0 can mean none.
    """

    def __init__(self, automaton: Automaton):
        self.up = [0] + [x + 1 for x in automaton.link]
        self.left, self.right = [0] * len(self.up), [0] * len(self.up)
        self.colour = [-1] * len(self.up)
        self.length = [0, *automaton.length]

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while True:
            p = up[x]
            on_left = left[p] == x
            if not p or not (on_left or right[p] == x):
                break
            g = up[p]
            p_left = left[g] == p
            inner = g and (p_left or right[g] == p)
            if inner and p_left == on_left:
                self._rotate(p)
            elif inner:
                self._rotate(x)
            else:
                top = p
            self._rotate(x)
            if inner:
                top = g
        if top != x:
            self.colour[x] = self.colour[top]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = right[x]
            left[p], right[x] = inner, p
        else:
            inner = left[x]
            right[p], left[x] = inner, p
        if inner:
            up[inner] = p
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        up[x], up[p] = g, x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(last end, length) of the coloured segments above ``state``, deepest first; all of them now end at ``end``."""
        up, right, colour = self.up, self.right, self.colour
        found, below, x = [], 0, state + 1
        while x:
            self._splay(x)
            if cut := right[x]:
                colour[cut] = colour[x]
            if colour[x] >= 0 and x != 1:
                found.append((colour[x], self.length[x]))
            right[x], below, x = below, x, up[x]
        self._splay(state + 1)
        colour[state + 1] = end
        return found


def stretch_runs(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of all runs of two periods and more, in the order in which they end."""
    automaton = Automaton(words)
    ends = LastEnds(automaton)
    open_: dict[int, int] = {}  # period -> start of the run that still goes on
    for i in range(len(words)):
        seen = {}
        for e, n in ends.access(automaton.prefix[i + 1], i):
            if i - e <= n:
                seen[i - e] = open_.pop(i - e, i - n - (i - e) + 1)
        yield from ((start, i - start, q) for q, start in open_.items())
        open_ = seen
    yield from ((start, len(words) - start, q) for q, start in open_.items())


def _stretches(words: np.ndarray, min_words: int, min_repeats: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that each occur ``min_repeats`` times in their stretch."""
    at, key = np.arange(len(words)), words
    while len(at) >= min_words:
        alive = np.bincount(key)[key] >= min_repeats
        if (kept := int(alive.sum())) == len(at):
            break
        at = at[alive]
        if not kept:
            break
        begins = np.r_[True, at[1:] != at[:-1] + 1]
        of = np.cumsum(begins) - 1
        long = np.bincount(of)[of] >= min_words
        at, of = at[long], of[long]
        # a word is another one in each stretch
        key = np.unique(of * (int(words.max()) + 1) + words[at], return_inverse=True)[1]
    if len(at) < min_words:
        return []
    breaks = np.flatnonzero(at[1:] != at[:-1] + 1)
    return list(zip(at[np.r_[0, breaks + 1]].tolist(), (at[np.r_[breaks, len(at) - 1]] + 1).tolist(), strict=True))


def runs_of(words: list[bytes], min_words: int = 6, min_repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``min_words`` words and ``min_repeats`` periods and more, by start, then period."""
    if len(words) < max(min_words, min_repeats):
        return []
    names: dict[bytes, int] = {}
    named = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    out = []
    for a, b in _stretches(named, min_words, min_repeats):
        out += [(a + start, n, q) for start, n, q in stretch_runs(named[a:b].tolist()) if n >= max(min_words, min_repeats * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that lie behind the first period of any run, joined by one space."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, n, q in runs:
            kept[start + q : start + n] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, min_words: int = 6, min_repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_words, runs, collapsed), one per row of ``docs``; map-only.

    ``runs`` has every run as (start, length, period), numbered in words from 0, by start, then period. ``collapsed``
    is the text with one period of each run: a word goes if any run holds it after its first period; the words
    that stay are joined by one space. ``min_repeats`` is at least 2.
    """
    if min_repeats < 2:
        raise ValueError("a run repeats at least twice")
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, runs, collapsed = [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = text.split()  # of bytes: at ASCII white space only, as WORD has it
                own = runs_of(words, min_words, min_repeats)
                n.append(len(words))
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in own])
                collapsed.append(_collapsed(words, own).decode())
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(runs, _RUN_TYPE), pa.array(collapsed, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return base.mapInArrow(run, f"`{id_col}` {base.schema[0].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_planted_periods(doc_id: str | Column, text: str | Column) -> Column:
    """The text of one document in ten, by the crc32 of its id, with a tail that repeats; other texts as they are.

    From word a on, word i is the text's own word a + (i - a) % p: h is the crc32, g = h div 10, a = g % n of the
    n words, p = 1 + (n - a) div (3 + g % 8). Texts without words and rows without an id stay.
    """
    h = F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary"))
    text = F.col(text) if isinstance(text, str) else text
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    tail = lambda w, n, a, p: F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
    # names for what is used often: one element goes through each step
    step = lambda value, then: F.transform(F.array(value), then)[0]
    planted = step(words, lambda w: step(F.size(w).cast("long"), lambda n: step(g % n, lambda a: F.array_join(tail(w, n, a, 1 + F.floor((n - a) / (3 + g % 8))), " "))))
    return F.when((h % 10 == 0) & text.rlike(WORD), planted).otherwise(text)


def run_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``periodic_runs`` rows: (id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    The run shown is the longest, ties by start, then period; four nulls where there is none.
    """
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as n, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    shown = found.select(F.col(id_col), F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return shown.selectExpr(f"`{id_col}`", "n_runs", "b.start as start", "-b.n as length", "b.period as period", "(1000 * -b.n) div b.period as exponent_milli", "runs_sha256", "collapsed_sha256")
