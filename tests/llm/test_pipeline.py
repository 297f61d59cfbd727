"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

from infragraph.llm.mixing import mix_report  # noqa: E402
from infragraph.llm.simhash import shingle_fingerprint  # noqa: E402


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes(items, linked):
    """The least item of each item's class under the pairs ``linked``."""
    low = {x: x for x in items}

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {x: root(x) for x in items}


def line_pairs(lines):
    """Pairs of different lines within the edits that the shorter one allows; pairs whose letters differ too much are not compared."""
    lines = sorted(lines)
    counts = np.zeros((len(lines), 256), np.int16)
    for i, x in enumerate(lines):
        for c in x:
            counts[i, ord(c) % 256] += 1
    for i, x in enumerate(lines):
        for j in np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(axis=1) <= 4) + i + 1:
            y = lines[j]
            most = min(2, len(x) // 12, len(y) // 12)
            if abs(len(x) - len(y)) <= most and edits(x, y) <= most:
                yield x, y


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = p.documents(spark, sf)
    columns = docs.columns
    seen = {}
    for name, stage in p.STAGES:
        before = docs
        docs = p.stored(stage(spark, docs, sf), f"test-{name}")
        seen[name] = (before, docs)
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert after.exceptAll(before).count() == 0 and after.count() >= 0.98 * before.count()

    before, after = seen["line_dedup"]
    rows = {r["doc_id"]: r["text"].split("\n") for r in before.collect()}
    places = {}
    for i in sorted(rows):
        for k, x in enumerate(rows[i]):
            places.setdefault(x, (i, k))
    of = classes(places, line_pairs(places))
    first = {}
    for x, root in of.items():
        first[root] = min(first.get(root, places[x]), places[x])
    want = {i: [x for k, x in enumerate(own) if len(x) < 24 or first[of[x]] == (i, k)] for i, own in rows.items()}
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    assert got == {i: "\n".join(own) for i, own in want.items() if own == rows[i] or "".join(own).strip()}
    assert after.where("n_chars <> length(text)").count() == 0

    before, after = seen["simhash_near_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sets, fps = {i: shingles(t) for i, t in texts.items()}, {i: shingle_fingerprint(t, 5) for i, t in texts.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if (fps[a] ^ fps[b]).bit_count() <= 2 or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in after.collect()} == set(classes(texts, near).values())

    before, after = seen["mix_sources"]
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mix_report(before).where("size > 0").collect()}
    copies = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert all(int(t) <= copies.get(i, 0) <= math.ceil(t) for i, t in taken.items()) and set(copies) <= set(taken)
    assert after.distinct().exceptAll(before).count() == 0
    _, out = seen["sample_segmentations"]
    assert out.where("not round_trip").count() == 0 and out.select("doc_id").distinct().count() == after.select("doc_id").distinct().count()


def test_texts_in_no_learned_language_are_rejected(spark):
    import corpus_pipeline as p

    rng = random.Random(5)
    docs = p.documents(spark, "/root/testdata/sf0.001")
    odd = [(90_001, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)), "xx", "s", 500), (90_002, "Съешь ещё этих мягких французских булок, да выпей чаю", None, "s", 50), (90_003, None, None, None, None), (90_004, "123", None, "s", 3)]
    mixed = docs.unionByName(spark.createDataFrame([(i, t, lang if i != 90_001 else None, s, n) for i, t, lang, s, n in odd], docs.schema))
    kept = {r["doc_id"] for r in p.language_id(spark, mixed, "").select("doc_id").collect()}
    assert not kept & {i for i, *_ in odd} and len(kept) >= 0.98 * docs.count()
