"""Operators 11 to 13 on small hard tables, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from infragraph.llm.queries import op11_periodic_runs, op12_token_files, op13_ranked_search, tokenizer_path
from infragraph.plans.lineage import scratch_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_words int, runs string, id string, score double, rank int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns named like those of the results."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma's", "delta,", "épsilon", "ΖΉΤΑ", "x", "the", "42", "naïve", "E̱", "e̱", "<|endoftext|>", "a b", "n\x1co"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    texts = [
        (1, "the cat sat " * 7 + "on"), (2, None), (3, ""), (4, long), (4, long), (4, "another one"), (None, "no id a b a b a b a b"), (None, "no id at all"), (7, " \t\n\x0b "),
        (8, "a" * 900), (9, ("x y z w " * 40) + long), (10, "go " * 5), (11, "go " * 6), (12, "H̱ ẖ H J̌"), (13, "<|ENDOFTEXT|> <|endoftext|>The END."), (14, "the\nthe\tthe the\r\nthe the THE"),
    ]
    return spark.createDataFrame([(i, t, 1, "r", "s", 0.5, None) for i, t in texts], SCHEMA)


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 11 -----------------------------------------------------------------------------------------------


def plain_runs(words, min_words=6, min_repeats=4):
    """Every stretch on which words q apart are equal, if no smaller period holds on all of it."""
    out, n = [], len(words)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(min_words, min_repeats * q) and not any(all(words[k] == words[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *shown, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_random_words():
    from infragraph.llm.runs import runs_of

    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randint(0, 60), rng.randint(1, 4)
        words = [bytes([97 + rng.randrange(kinds)]) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        for least, repeats in ((6, 4), (2, 2), (5, 3)):
            assert runs_of(words, least, repeats) == plain_runs(words, least, repeats)


def test_runs_long_texts_in_time():
    from infragraph.llm.runs import runs_of

    rng = random.Random(2)
    began = time.perf_counter()
    base = [str(rng.randrange(4000)).encode() for _ in range(20_000)]
    assert runs_of([base[i % 20_000] for i in range(100_000)]) == [(0, 100_000, 20_000)]
    assert runs_of([b"go"] * 200_000) == [(0, 200_000, 1)]
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    assert runs_of([bytes([c]) for c in fib[-1]]) == []  # Fibonacci words have no fourth power
    assert time.perf_counter() - began < 60


def test_runs_on_hard_rows(hard, spark):
    from infragraph.llm.runs import periodic_runs, run_report

    got = run_report(periodic_runs(hard)).collect()
    want = [(i, *plain_report(w, plain_runs(w))) for i, t in pairs_of(hard) for w in [WORD.findall(t or "")]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    none = run_report(periodic_runs(hard.limit(0)))
    assert none.count() == 0 and none.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    with pytest.raises(ValueError):
        periodic_runs(hard, min_repeats=1)


def test_runs_query(spark):
    docs = pairs_of(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 10 == 0 or len(t or "") < 3000]
    assert sum(got[i][0] > 0 for i, _ in some) > 5
    for i, t in some:
        words = planted(i, t)
        assert got[i] == plain_report(words, plain_runs(words)), i


# 12 -----------------------------------------------------------------------------------------------


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [e.ids + [2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_grammar_round_trip():
    from infragraph.llm.token_files import Grammar, _block, compress

    rng = np.random.default_rng(3)
    for n, kinds in ((0, 5), (1, 5), (2, 1), (3000, 1), (5000, 3), (20_000, 40), (9000, 30_000)):
        ids = (kinds * rng.random(n) ** 3).astype(np.int64)
        joined = rng.random(n) < 0.99
        block = _block(ids, joined, 40_000)
        g, made = Grammar(block), compress(ids, joined, 40_000)
        assert (g.ids() == ids).all() and len(g.ids()) == n and made["lengths"].sum() == len(g.flat)
        # no symbol spans a break, and a frequent pair is not left
        ends = np.cumsum([1 if x < 40_000 else made["lengths"][x - 40_000] for x in made["symbols"].tolist()])
        assert set((np.flatnonzero(~joined[:-1]) + 1).tolist() if n else []) <= set(ends.tolist())
        if kinds < 50 and n > 1000:
            assert len(made["symbols"]) < 0.8 * n
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (g.ids(a, b) == ids[a:b]).all() and len(g.ids(a, b)) == b - a


def test_token_files_on_hard_rows(hard, spark):
    from infragraph.llm.token_files import read_documents, read_ids, write_token_files

    rows = pairs_of(hard)
    want = [(i, ids) for (i, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True)]
    # blocks of 500 ids: the long texts span many
    for shard_ids, part_bytes in ((500, 1 << 14), (1 << 20, 1 << 25)):
        path = scratch_path(spark, "token-files")
        write_token_files(hard, path, tokenizer_path("word_bpe_49k.json"), 2, shard_ids, part_bytes)
        got = sorted(read_documents(spark, path).collect(), key=lambda r: r["start"])
        assert sorted(map(str, ((r["doc_id"], list(r["ids"])) for r in got))) == sorted(map(str, want))
        assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
        stream = []
        for r in got:
            assert r["start"] == len(stream) and r["n_tokens"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            stream += r["ids"]
        looked = spark.createDataFrame([(0, 1), (3, 40), (700, 3000), (len(stream) - 1, 1)], "start long, n long")
        found = {}
        for r in read_ids(spark, path, looked).collect():
            assert r["ids"] == stream[r["start"] : r["start"] + r["n"]]
            found[r["start"]] = r["n"]
        assert sum(found.values()) >= 3042
    path = scratch_path(spark, "token-files")
    write_token_files(hard.limit(0), path, tokenizer_path("word_bpe_49k.json"), 2)
    assert read_documents(spark, path).count() == 0


def test_token_files_one_key_and_other_tokenizers(spark):
    """Equal rows under one id are spread over parts; a tokenizer that keeps white space encodes whole texts."""
    from tokenizers import Tokenizer

    from infragraph.llm.token_files import Encoder, read_documents, write_token_files

    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words " * 20).alias("text"))
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), 2, part_bytes=1 << 16)
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert read_documents(spark, path, with_ids=False).agg(F.countDistinct("start"), F.countDistinct("ids_crc32")).first() == (4000, 1)
    other = Encoder(tokenizer_path("byte_bpe_50k.json"))
    text = "two  spaces and\nlines"
    assert not other.by_word
    assert other.encode([text.encode()])[0].tolist() == Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_token_files_query(spark):
    rows = sorted(pairs_of(spark.read.parquet(f"{SF}/documents.parquet")))
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_token_files(spark, SF).collect()}
    start = 0
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# 13 -----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top=20):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        query, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in query.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:top])]
    return out


def as_rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_search_on_hard_rows(hard, spark):
    from infragraph.llm.search import search

    rng = random.Random(4)
    words = [f"w{int(200 * rng.random() ** 2)}" for _ in range(3000)]
    more = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(400)]
    more += [(1000 + i, "w1 w2 w3 same text in all of these") for i in range(300)]  # ties beyond the last place
    docs = hard.select("doc_id", "text", "rank", "score", "id").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    items = [(1, "the CAT sat épsilon"), (2, None), (3, "  ...  "), (4, "w1 w2 w3 w3 same"), (None, "w5 w6"), (5, "nothing-known"), (4, "w1 w2 w3 w3 same"), (6, " ".join(words[:60])), (7, "w0 w1"), (8, "alpha beta delta 42")]
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = sorted(map(str, plain_search(pairs_of(docs), items)))
    for head_rows in (1, 50, 4096):
        assert as_rows(search(docs, queries, head_rows=head_rows)) == want
    assert as_rows(search(docs.repartition(7), queries, block_rows=3)) == want
    assert as_rows(search(docs, queries, top=3)) == sorted(map(str, plain_search(pairs_of(docs), items, 3)))
    assert search(docs.limit(0), queries).count() == 0 and search(docs, queries.limit(0)).count() == 0


def test_search_prunes_and_stays_exact(spark):
    """Few rows reach the threshold of a query, and those that do hold its best ones."""
    from infragraph.llm import search as S

    rng = random.Random(6)
    docs = [(i, " ".join(f"t{int(3000 * rng.random() ** 3)}" for _ in range(rng.randint(5, 300)))) for i in range(3000)]
    items = [(i, " ".join(docs[i * 7][1].split()[:20])) for i in range(40)]
    seen = []
    df, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert as_rows(S.search(df, queries)) == sorted(map(str, plain_search(docs, items)))
    # the same search in this process, to see what survives
    vectors = S.term_vectors(df, sorted({t for _, x in items for t in S.terms_of(x.encode())}), "doc_id", "text")
    vocabulary = sorted({t for _, x in items for t in S.terms_of(x.encode())})
    rows = vectors.collect()
    found = Counter(t for r in rows for t in r["terms"])
    weights = np.array([S.term_weight(len(rows), found[i]) for i in range(len(vocabulary))], np.int64)
    batch = S.impact_vectors(vectors, weights, len(rows), sum(r["n"] for r in rows)).orderBy(F.desc("norm")).toArrow().combine_chunks().to_batches()[0]
    bucket = S.Bucket(batch, weights)
    best = {}
    for r in S.search(df, queries).collect():
        best.setdefault(r["item_id"], []).append(r["score"])
    counted = [Counter(S.terms_of(text.encode())) for _, text in items]
    at = [np.array(sorted(vocabulary.index(t) for t in c), np.int64) for c in counted]
    block = S.Queries(weights, at, [np.array([c[vocabulary[t]] for t in own], np.int64) for c, own in zip(counted, at, strict=True)])
    for q, (i, _) in enumerate(items):
        left = bucket.survivors(*block.focused(q), min(best[i]))
        factors = np.zeros(len(weights), np.int64)
        factors[at[q]] = weights[at[q]] * block.counts[q]
        exact = bucket.scores(np.arange(batch.num_rows), factors)
        assert set(np.flatnonzero(exact >= min(best[i])).tolist()) <= set(left.tolist())
        seen.append(len(left))
    assert sum(seen) < 0.1 * len(rows) * len(items)


def test_search_query(spark):
    docs = pairs_of(spark.read.parquet(f"{SF}/documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert as_rows(op13_ranked_search(spark, SF)) == sorted(map(str, plain_search(docs, items)))
