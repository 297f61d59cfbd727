"""Operator 3, line dedup: a segment-partition edit join, in DataFrame functions only.

Two different lines are linked if they are within the edits (insertions, deletions and substitutions of
characters) that the shorter one allows: one in ``per_edit`` characters, at most ``max_edits``. A line that
allows t edits is split into t + 1 segments, of which any line that near holds one unchanged. So each line is
indexed by its segments, with its length and the segment's number, and probes the lengths it may meet with
only those substrings that the edits left and right of a segment leave possible. Pairs that meet are checked
by character parities (an edit changes two at most) and then by the banded bit-parallel edit distance.

Equal lines are collapsed first. A segment shared by more than ``hot`` lines is split by content: parity
masks within ``2 * max_edits`` bits agree in one of ``2 * max_edits + 1`` blocks, so the lines meet by
(segment, block) instead, which loses no pair. Segments are counted by window; those that a sample of lines
shows to be frequent are counted by the sample and dealt over many tasks. Classes are the connected
components of the links.

Defined results: a null text has one empty line, like the empty text; lines of fewer than ``per_edit``
characters form classes of equal lines; lines shorter than ``min_chars`` are always kept; the first line of a
class is the one with the smallest (doc_id, line number); a document row that repeats wholly counts as one
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.llm.common import in_sample
from infragraph.plans.components import connected_components
from infragraph.plans.lineage import bucketed, discard, stored


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row, line_no, line, lid, check): each line of each text; ``row`` tells rows of one id apart.

    Lines are equal if both hashes are, of 64 bits each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), text.alias("text"))
    cut = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut.withColumn("lid", F.xxhash64("line")).withColumn("check", F.xxhash64(F.lit("check"), "line"))


def _probes(edits: int) -> str:
    """All (gap, i, shift) as a literal array: segment ``i`` (from 1) of a line shorter by ``gap`` is looked for ``shift`` places on."""
    parts, out = edits + 1, []
    for gap in range(edits + 1):
        for i in range(1, parts + 1):
            low, high = max(1 - i, gap - (parts - i)), min(i - 1, gap + parts - i)
            out += [f"named_struct('gap', {gap}, 'i', {i}, 'shift', {shift})" for shift in range(low, high + 1)]
    return f"array({', '.join(out)})"


def _keys_of(lines: DataFrame, edits: int, least: int, most: int | None) -> DataFrame:
    """Rows (lid, key, own): keys that meet lines of ``least`` to ``most`` characters, which allow ``edits``.

    A row for each probe and one expression for all: one array of all keys took five times as long, probably as a method too
    long to be compiled.
    """
    parts = edits + 1
    probes = lines.select("lid", "line", "n", F.explode(F.expr(_probes(edits))).alias("p")).selectExpr("lid", "line", "n", "p.i as i", "p.shift as shift", "n - p.gap as other", "p.gap = 0 and p.shift = 0 as own")
    probes = probes.where(F.col("other") >= least) if most is None else probes.where(F.col("other").between(least, most))
    # the last segments take the remainder
    base, plain = f"(other div {parts})", f"({parts} - other % {parts})"
    at = f"((i - 1) * {base} + greatest(0, i - 1 - {plain}) + 1 + shift)"
    placed = probes.selectExpr("lid", "line", "n", "i", "other", "own", f"cast({at} as int) as at", f"cast({base} + if(i > {plain}, 1, 0) as int) as size")
    return placed.where("at >= 1 and at + size - 1 <= n").selectExpr("lid", "xxhash64(other, i, substring(line, at, size)) as key", "own")


def segment_keys(distinct: DataFrame, max_edits: int, per_edit: int) -> DataFrame:
    """Rows (lid, key, own) of lines (lid, line, n): each line's keys, ``own`` for its own segments.

    Lines that allow t edits meet those of t * per_edit characters and more, up to t beyond the next step.
    """
    out = None
    for t in range(1, max_edits + 1):
        most = None if t == max_edits else (t + 1) * per_edit - 1
        lines = distinct.where(F.col("n") >= t * per_edit) if most is None else distinct.where(F.col("n").between(t * per_edit, most + t))
        found = _keys_of(lines, t, t * per_edit, most)
        out = found if out is None else out.unionAll(found)
    return out


def allowed(a: str, b: str, max_edits: int, per_edit: int) -> Column:
    """Edits that the shorter of two lines allows."""
    return F.expr(f"least({max_edits}, length({a}) div {per_edit}, length({b}) div {per_edit})")


def parity_mask(line: str) -> Column:
    """64 bits: for each class of characters whether it occurs an odd number of times."""
    return F.expr(f"aggregate(split({line}, ''), 0L, (m, c) -> m ^ shiftleft(1L, cast(pmod(hash(c), 64) as int)))")


def banded_distance(a: str, b: str, max_edits: int) -> Column:
    """Edits between columns ``a`` and ``b``, right up to ``max_edits`` if their lengths differ by no more.

    Bit-parallel over a band of ``2 * max_edits + 1`` rows around the diagonal: bit k of a column's vectors
    is the vertical step at row ``column - max_edits + k``. The distance is followed down the band's lower
    edge to the last row, then along it. Both lines have at least ``max_edits`` characters.
    """
    t, full = max_edits, (1 << (2 * max_edits + 1)) - 1
    match = " | ".join(f"if(coalesce(get(x.p, j - {t} + {k} - 1) = get(x.q, j - 1), false), {1 << k}, 0)" for k in range(2 * t + 1))
    # d0: diagonal steps of 0; h.p, h.n: horizontal steps up and down; s.vp, s.vn: the vertical ones
    d0 = f"((((y & s.vp) + s.vp) ^ s.vp) | y | s.vn) & {full}"
    h = f"named_struct('p', (s.vn | ~(d0 | s.vp)) & {full}, 'n', d0 & s.vp)"
    edge = f"if(s.j <= size(x.p) - {t}, 1 - (shiftright(d0, {2 * t}) & 1), (shiftright(h.p, size(x.p) - s.j + {t}) & 1) - (shiftright(h.n, size(x.p) - s.j + {t}) & 1))"
    after = f"named_struct('vp', (h.n | ~(shiftright(d0, 1) | h.p)) & {full}, 'vn', shiftright(d0, 1) & h.p, 'j', s.j + 1, 'd', s.d + {edge})"
    step = f"aggregate(array({d0}), s, (s1, d0) -> aggregate(array({h}), s, (s2, h) -> {after}))"
    start = f"named_struct('vp', {full ^ ((1 << t) - 1)}, 'vn', 0, 'j', 1, 'd', {t})"
    run = f"aggregate(transform(sequence(1, size(x.q)), j -> {match}), {start}, (s, y) -> {step}).d"
    return F.expr(f"transform(array(named_struct('p', split({a}, ''), 'q', split({b}, ''))), x -> {run})[0]")


def _often(distinct: DataFrame, max_edits: int, per_edit: int, sample_rows: int, least: int = 20) -> DataFrame:
    """Rows (key, parts): frequent segments and over how many parts to deal each, from about ``sample_rows`` lines.

    No more rows than the sample has keys by ``least``, which bounds the broadcast.
    """
    total = distinct.count()
    some = distinct.where(in_sample(sample_rows / max(1, total), "lid", F.lit("often")))
    share = some.count() / max(1, total) or 1.0  # counts are scaled by what was really sampled
    found = segment_keys(some, max_edits, per_edit).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).select("key", (1 + F.col("n") / share / 1024).cast("long").alias("parts"))


def line_links(lines: DataFrame, max_edits: int = 2, per_edit: int = 12, hot: int = 48, sample_rows: int = 20_000) -> DataFrame:
    """Rows (a, b) of line ids, a < b: the links between different lines, each once.

    Of different lines whose ids are equal, the one with the smallest ``check`` is linked.
    """
    long = lines.where(F.length("line") >= per_edit).groupBy("lid").agg(F.min_by("line", "check").alias("line")).withColumn("n", F.length("line"))
    distinct = bucketed(long, "lid", "lines")
    often = stored(_often(distinct, max_edits, per_edit, sample_rows), "line-often")
    keys = segment_keys(distinct, max_edits, per_edit).join(F.broadcast(often), "key", "left")
    keys = keys.select("lid", "key", "own", F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod("lid", "parts")).alias("part"))
    # all that follows is about keys with an indexed line and another line
    over = "over (partition by key, part)"
    met = keys.selectExpr("lid", "key", "own", f"if(part > 0, {hot + 1}, count(1) {over}) as n", f"part > 0 or min(lid) {over} <> max(lid) {over} and max(own) {over} as pairs").where("pairs").drop("pairs")
    met = stored(met, "line-keys", "zstd")
    some = met.select("lid").distinct()
    texts = stored(distinct.join(some, "lid").withColumn("mask", parity_mask("line")), "line-texts", "zstd")
    rows = met.join(texts.select("lid", "mask", F.col("n").alias("chars")), "lid")
    blocks = 2 * max_edits + 1
    width = -(-64 // blocks)
    block = F.expr(f"if(n <= {hot}, array(named_struct('at', -1, 'bits', 0L)), transform(sequence(0, {blocks - 1}), i -> named_struct('at', i, 'bits', shiftrightunsigned(mask, i * {width}) & {(1 << width) - 1}L)))")
    rows = rows.select("lid", "key", "own", "mask", F.explode(block).alias("s")).select("lid", "key", "own", "mask", F.col("s.at").alias("at"), F.col("s.bits").alias("bits"))
    index = rows.where("own").select("key", "at", "bits", F.col("lid").alias("a"), F.col("mask").alias("ma"))
    probe = rows.select("key", "at", "bits", F.col("lid").alias("b"), F.col("mask").alias("mb"), F.col("own").alias("own_b"))
    # a pair that agrees in several blocks is met in the first of them only
    same = [F.shiftrightunsigned(F.col("ma").bitwiseXOR(F.col("mb")), i * width).bitwiseAND(F.lit((1 << width) - 1)) == 0 for i in range(blocks)]
    first_same = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(same)])
    close = ((F.col("at") < 0) | (F.col("at") == first_same)) & (F.col("a") != F.col("b")) & (~F.col("own_b") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2 * max_edits)
    met_pairs = index.join(probe, ["key", "at", "bits"]).where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = texts.select(F.col("lid").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("lid").alias("b"), F.col("line").alias("line_b"))
    checked = met_pairs.join(left, "a").join(right, "b").where(F.abs(F.length("line_a") - F.length("line_b")) <= max_edits)
    links = stored(checked.where(banded_distance("line_a", "line_b", max_edits) <= allowed("line_a", "line_b", max_edits, per_edit)).select("a", "b"), "line-links")
    discard(distinct, often, met, texts)
    return links


def line_classes(docs: DataFrame, max_edits: int = 2, per_edit: int = 12, min_chars: int = 24, hot: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row, line_no, class_doc_id, class_line_no, n_links, kept), one for each line.

    ``n_links`` counts the different lines linked to this one. A line is ``kept`` if it is the first of its
    class or shorter than ``min_chars``.
    """
    lines = lines_of(docs, id_col, text_col)
    links = line_links(lines, max_edits, per_edit, hot)
    found = connected_components(links).select(F.col("node").alias("lid"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("lid")).groupBy("lid").agg(F.count(F.lit(1)).alias("n_links"))
    linked = stored(found.join(degree, "lid"), "line-classes")
    places = lines.select("doc_id", "row", "line_no", "lid", "check", (F.length("line") >= min_chars).alias("long"))
    first = places.groupBy("lid", "check").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")).alias("first"))
    one = first.groupBy("lid").agg(F.min("check").alias("check"))
    of_class = first.join(linked.join(one, "lid"), ["lid", "check"], "left")
    lowest = of_class.where("n_links is not null").groupBy("component").agg(F.min("first").alias("low"))
    of_class = of_class.join(lowest, "component", "left").select("lid", "check", F.coalesce("low", "first").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = places.join(of_class, ["lid", "check"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select(
        "doc_id", "row", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), F.col("n_links").cast("long").alias("n_links"), (~F.col("long") | is_first).alias("kept")
    )


def drop_repeated_lines(docs: DataFrame, max_edits: int = 2, per_edit: int = 12, min_chars: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that are not kept, same columns.

    What is left of a document stays, however little: it may hold the line for which copies elsewhere were
    removed. A document goes only if nothing but white space is left; documents that lose no line are
    returned as they are.
    """
    gone = line_classes(docs, max_edits, per_edit, min_chars, id_col=id_col, text_col=text_col).where(~F.col("kept"))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone")).select("row", "doc_id", "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("own_row"))
    joined = rows.join(gone, (F.col("own_row") == F.col("row")) & F.col("own_id").eqNullSafe(F.col("doc_id")), "left")
    # the places that stay are found by hashing: linear in the lines of a text
    left = F.expr("transform(array(split(text, '\\n')), w -> array_join(transform(array_except(sequence(0, size(w) - 1), gone), i -> w[i]), '\\n'))[0]")
    cut = joined.withColumn("rest", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    stays = F.col("gone").isNull() | F.col("rest").rlike(r"\S")
    return cut.where(stays).select(*[F.col("rest").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
