"""Operator 10, quality rules: a short-circuit cascade, in DataFrame functions only.

Each rule has a rejecting condition and a cost in operations: the characters that it scans, or 1 for a
comparison of numbers at hand. On a bounded sample the next rule is always the one that rejects most of the
rows left per cost. ``cascade`` tries the rules in that order: one CASE expression whose later branches run
only for rows that no earlier one rejected. The order changes the work, never the verdict.

Defined results: a null text is the empty text (no words, so it fails); all counts are of whole texts;
null or repeated ids are kept row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.llm.common import GAP


@dataclass(frozen=True)
class Rule:
    """A named condition on the columns of ``measured``; a row for which it is true is rejected. ``scans``: it reads the text."""

    name: str
    reject: Column
    scans: bool = False

    @property
    def cost(self) -> Column:
        return F.length("text_") + 1 if self.scans else F.lit(1)


@dataclass(frozen=True)
class Estimate:
    """Mean operations a row, and the share that the rule rejects of the sample's rows that come to it."""

    name: str
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.cost


#: Limits of the rules, fixed values.
MEAN_WORD_CHARS, SYMBOLS_PER_WORD, DUP_LINES, LETTER_WORDS, ELLIPSIS_LINES, BULLET_LINES = (2, 20), 0.1, 0.3, 0.6, 0.3, 0.9


def default_rules() -> list[Rule]:
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return [
        Rule("mean_word_chars", (F.col("word_chars") < MEAN_WORD_CHARS[0] * F.col("n_words")) | (F.col("word_chars") > MEAN_WORD_CHARS[1] * F.col("n_words"))),
        Rule("symbols", F.col("n_symbols") > SYMBOLS_PER_WORD * F.col("n_words")),
        Rule("dup_lines", F.col("n_dup_lines") > DUP_LINES * lines),
        # a match starts at a word's start only and never goes back, so a long run without letters is read once
        Rule("letter_words", F.regexp_count("text_", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}")) < LETTER_WORDS * F.col("n_words"), scans=True),
        Rule("ellipsis_lines", F.regexp_count("text_", F.lit(r"(\.\.\.|…)(\n|\z)")) > ELLIPSIS_LINES * lines, scans=True),
        Rule("bullet_lines", F.regexp_count("text_", F.lit(r"(\A|\n)[ \t]*+[-*•]")) > BULLET_LINES * lines, scans=True),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed).

    Repeated windows are found inside each row: windows are hashed (64 bits) and sorted, so equal ones
    become neighbours. Most texts repeat few windows, and their places are looked up in that short list;
    where it is long, the sort carries the places along instead, so the work stays near-linear.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("doc_id"), text.alias("text_"))
    a = a.withColumn("words", F.array_remove(F.split("text_", GAP), "")).withColumn("lines", F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    a = a.withColumn("n", F.size("words")).selectExpr(
        "*",
        "if(n < 3, cast(array() as array<bigint>), transform(sequence(0, n - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))) as wins",
    )
    a = a.withColumn("sorted", F.expr("if(size(array_distinct(wins)) = size(wins), cast(array() as array<bigint>), sort_array(wins))"))
    a = a.withColumn(
        "twice",
        F.expr("if(size(sorted) < 2, cast(array() as array<bigint>), array_distinct(filter(zip_with(slice(sorted, 1, size(sorted) - 1), slice(sorted, 2, size(sorted) - 1), (x, y) -> if(x = y, x, null)), x -> x is not null)))"),
    )
    a = a.withColumn("placed", F.expr("if(size(twice) > 64, array_sort(transform(wins, (h, i) -> struct(h as h, i as i))), null)"))
    a = a.withColumn(
        "at",
        F.expr(
            "case when size(twice) = 0 then cast(array() as array<int>)"
            " when placed is null then filter(transform(wins, (h, i) -> if(array_contains(twice, h), i, null)), i -> i is not null)"
            " else flatten(filter(zip_with(slice(placed, 1, size(placed) - 1), slice(placed, 2, size(placed) - 1), (x, y) -> if(x.h = y.h, array(x.i, y.i), null)), i -> i is not null)) end"
        ),
    )
    out = a.select(
        "doc_id",
        "text_",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text_", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(at, i -> array(i, i + 1, i + 2))))) as bigint)").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """The rules in the cascade's order, from a bounded ``sample`` of the rows of ``measured``.

    The driver sees a row for each combination of verdicts that occurs in the sample.
    """
    verdicts = [F.coalesce(r.reject, F.lit(False)).alias(f"v{i}") for i, r in enumerate(rules)]
    costs = [r.cost.cast("double").alias(f"c{i}") for i, r in enumerate(rules)]
    keys = [f"v{i}" for i in range(len(rules))]
    left = [r.asDict() for r in sample.select(*verdicts, *costs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules)))).collect()]
    out, todo = [], list(range(len(rules)))
    while todo:
        n = sum(r["n"] for r in left)

        def tried(i: int, n=n) -> Estimate:
            return Estimate(rules[i].name, sum(r[f"c{i}"] for r in left) / n if n else 1.0, sum(r["n"] for r in left if r[f"v{i}"]) / n if n else 0.0)

        best = max(todo, key=lambda i: (tried(i).gain, -tried(i).cost, -i))
        out.append(tried(best))
        todo.remove(best)
        left = [r for r in left if not r[f"v{best}"]]
    return out


def cascade(rows: DataFrame, rules: list[Rule], order: list[str] | None = None) -> DataFrame:
    """``rows`` with ``rejected_by``: the first rule in the cascade's order that rejects the row, or null."""
    by_name = {r.name: r for r in rules}
    verdict = F.lit(None).cast("string")
    for name in reversed(order or [r.name for r in rules]):
        verdict = F.when(by_name[name].reject, F.lit(name)).otherwise(verdict)
    return rows.withColumn("rejected_by", verdict)


def quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    About ``sample_rows`` rows, drawn from the whole table, only order the rules; no verdict depends on them.
    """
    rules = [Rule("base", F.col("base_failed")), *(rules or default_rules())]
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(id_col, text_col)
    sample = sample.sample(share, seed=10) if share < 1 else sample
    order = [e.name for e in estimate(measured(sample, id_col, text_col), rules)]
    rows = cascade(measured(docs, id_col, text_col), rules, order)
    kept = F.col("rejected_by").isNull()
    return rows.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


#: DuckDB SQL for ``quality`` under ``default_rules``.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), wins AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) >= 2
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT w.doc_id, w.t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_lines, 1) AS nl FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR n_symbols > 0.1 * n_words
    OR n_dup_lines > 0.3 * nl
    OR len(regexp_extract_all(t, '[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*')) < 0.6 * n_words
    OR len(regexp_extract_all(t, '(\.\.\.|…)(\n|\z)')) > 0.3 * nl
    OR len(regexp_extract_all(t, '(\A|\n)[ \t]*[-*•]')) > 0.9 * nl) AS kept
FROM b
"""
