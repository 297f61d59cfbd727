"""Each numbered operator on small hard tables, against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from infragraph.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, key int"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta,", "épsilon", "ζήτα", "x", "the", "of", "and"]
    long = " ".join(rng.choice(words) for _ in range(9000))
    rows = [
        (1, "the alpha of the beta\nthe alpha of the beta and gamma delta one\nend", "en", "a", 5, 0.5, "f", 1),
        (2, None, "en", "a", None, None, None, None),
        (3, "", None, None, 0, 0.1, "f", 2),
        (4, long, "en", "b", 1, 0.5, "f", 3),
        (4, long, "en", "b", 1, 0.5, "f", 3),
        (5, "der die das und ist\nnicht " * 20, "de", "a", 1, None, "", 4),
        (None, "an orphan text with no id at all", "en", None, None, None, None, None),
        (7, "   \t\n  ", "de", "c", 3, 0.0, "f", 5),
        (8, "a" * 700, "en", "b", 700, 0.0, "f", 6),
        (9, long[:20000] + " tail", "en", "a", 1, 0.5, "f", 7),
        (10, "#$%& 123 !!!", None, "c", 3, 0.0, "f", 5),
        (10, "another text under the same id", "en", "c", 3, 0.0, "f", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 ------------------------------------------------------------------------------------------------


def test_sampling_round_trip_and_distinct(hard, empty):
    from infragraph.llm.sampling import decode, encode_samples

    enc = encode_samples(hard, tokenizer_path(), k=3)
    back = decode(enc.withColumn("kept", F.col("ids")), tokenizer_path())
    got = rows_of(back)
    assert {(r["doc_id"], r["text"]) for r in got} == set(texts_of(hard)) and all(r["round_trip"] for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r["doc_id"], r["text"]), []).append(r)
    for (_, text), own in by_text.items():
        assert len({tuple(r["kept"]) for r in own}) == len({r["sample"] for r in own})
        assert len({r["sample"] for r in own}) == (3 if len(text) > 1 else 1)
        assert all(r["log_inclusion"] <= 1e-12 and r["n_pieces"] == len(r["kept"]) for r in own)
    again = {(r["doc_id"], r["sample"], tuple(r["ids"])) for r in rows_of(encode_samples(hard.repartition(5), tokenizer_path(), k=3))}
    assert again == {(r["doc_id"], r["sample"], tuple(r["kept"])) for r in got}
    assert encode_samples(empty, tokenizer_path()).count() == 0
    many = [tuple(r["ids"]) for r in encode_samples(hard.where("doc_id = 1"), tokenizer_path(), k=24).collect()]
    assert len(set(many)) == len(many) == 24


def test_vocabulary_is_read_once_for_each_file_and_scoring(tmp_path):
    import os
    import shutil

    from infragraph.llm.sampling import vocabulary

    path = shutil.copy(tokenizer_path(), tmp_path / "some.model")
    first = vocabulary(str(path))
    assert vocabulary(str(path)) is first
    other = vocabulary(str(path), sharpness=2.0)
    assert other is not first and np.array_equal(other.weight, 2 * first.weight)
    os.utime(path, ns=(1, 1))
    assert vocabulary(str(path), sharpness=2.0) is not other


def test_sampling_lattice_looks_up_no_single_characters(monkeypatch):
    """The edges are all pieces of all words; single characters are read from an array and word ends looked up once at most."""
    from infragraph.llm.language_id import Table
    from infragraph.llm.sampling import Lattice, Vocabulary

    vocab = Vocabulary.load(tokenizer_path())
    words = ["\u2581the", "\u2581data", "\u2581\u2581", "\n", "x", "\u2581caf\u00e9\U0001f600", "\u2581" + "ab" * 300]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    looked, find = [], Table.find
    monkeypatch.setattr(Table, "find", lambda self, keys: looked.append(len(keys)) or find(self, keys))
    lattice = Lattice(vocab, points, np.array([len(w) for w in words]))
    assert len(looked) == vocab.longest - 1 and looked[0] == sum(vocab.single[points] >= 0)
    ids = {p.decode("utf-8", "surrogatepass").replace(" ", "\u2581"): i for i, p in enumerate(vocab.surface) if p and i not in set(vocab.byte_ids.tolist())}
    expected = []
    for w, at in zip(words, lattice.first.tolist(), strict=True):
        for i in range(len(w)):
            found = [(at + i, at + j, ids[w[i:j]]) for j in range(i + 1, len(w) + 1) if w[i:j] in ids]
            expected += ([] if w[i] in ids else [(at + i, at + i + 1, -2)]) + found
    assert list(zip(lattice.src.tolist(), lattice.dst.tolist(), lattice.piece.tolist(), strict=True)) == expected
    for w, at in zip(words, lattice.first.tolist(), strict=True):  # probabilities out of each node
        for v in range(at, at + len(w)):
            own = slice(lattice.start[v], lattice.start[v + 1])
            assert abs(np.exp(lattice.log_q[own]).sum() - 1) < 1e-9


def test_sampling_follows_the_lattice():
    import sentencepiece

    from infragraph.llm.sampling import Batch, Vocabulary, row_keys

    v = Vocabulary.load(tokenizer_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    known = {sp.id_to_piece(i): i for i in range(259, sp.get_piece_size())}

    def splits(s):
        if not s:
            yield ()
        for n in range(1, min(16, len(s)) + 1):
            if s[:n] in known:
                yield from ((known[s[:n]], *r) for r in splits(s[n:]))

    every = list(splits("▁the▁at"))
    p = np.exp([sum(v.weight[i] for i in a) for a in every])
    p = dict(zip(every, p / p.sum(), strict=True))
    n = 8000
    batch = Batch(v, ["the at"] * n, row_keys(list(range(n)), 3))
    drawn = []
    for s in batch.samples(2):
        flat, size = batch.ids(s)
        ends = np.cumsum(size)
        drawn.append([tuple(flat[e - k : e].tolist()) for e, k in zip(ends, size, strict=True)])
    first, second = Counter(drawn[0]), Counter(drawn[1])
    for a in sorted(p, key=p.get)[-4:]:
        assert abs(first[a] / n - p[a]) < 0.02
        after = sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)
        assert abs(second[a] / n - after) < 0.02
    assert all(a != b for a, b in zip(*drawn, strict=True))


# 2 ------------------------------------------------------------------------------------------------


def plain_lm(docs, order, rounds=12, least=200):
    """Scores of (text, fold) by deleted interpolation over dictionaries of tuples; folds: 0 counted, 1 tuning, 2 scored."""

    def padded(t):
        return ("<",) * (order - 1) + tuple(t.encode().lower().split()) + ("end",)

    def learned(folds):
        count, context, n = Counter(), Counter(), 0
        for t, f in docs:
            if f in folds:
                x = padded(t)
                for i in range(order - 1, len(x)):
                    n += 1
                    for k in range(order):
                        count[x[i - k : i + 1]] += 1
                        context[x[i - k : i]] += k > 0
        return count, context, n, len({g for g in count if len(g) == 1})

    def tokens(t, model):
        count, context, n, words = model
        x = padded(t)
        for i in range(order - 1, len(x)):
            p, bucket = [1 / (words + 1), count[x[i : i + 1]] / max(n, 1)], (1, 0)
            for k in range(1, order):
                c = context[x[i - k : i]]
                p.append(count[x[i - k : i + 1]] / c if c else 0)
                if c:
                    bucket = (k + 1, int(math.log2(c)))
            yield bucket, p

    held = [x for t, f in docs if f == 1 for x in tokens(t, learned({0}))]
    sizes = Counter(b for b, _ in held)
    weights = {}
    for b, n in sizes.items():
        w = [1 / (b[0] + 1)] * (b[0] + 1) + [0.0] * (order - b[0])
        for _ in range(rounds):
            shares = [[x * y / sum(map(float.__mul__, w, p)) for x, y in zip(w, p, strict=True)] for c, p in held if c == b]
            w = [sum(x) / n for x in zip(*shares, strict=True)]
        weights[b] = w
    pooled = {}
    for k in range(1, order + 1):
        firm = [(weights[b], n) for b, n in sizes.items() if b[0] == k and n >= least]
        total = sum(n for _, n in firm)
        pooled[k] = [sum(w[i] * n for w, n in firm) / total for i in range(order + 1)] if firm else [1 / (k + 1)] * (k + 1) + [0.0] * (order - k)
    model = learned({0, 1})
    out = []
    for t, _ in docs:
        score = 0.0
        for b, p in tokens(t, model):
            w = weights[b] if sizes[b] >= least else pooled[b[0]]
            score += math.log10(sum(x * y for x, y in zip(w, p, strict=True)))
        out.append(score)
    return out


def test_lm_scores(hard, empty):
    from infragraph.llm.lm_scoring import COUNTED, SCORED, TUNING, score_documents

    fold = F.when(F.col("doc_id") == 9, SCORED).when(F.col("doc_id") == 5, TUNING).otherwise(COUNTED)
    got = rows_of(score_documents(hard, fold))
    toks = [(i, t.encode().lower().split() + [None]) for i, t in texts_of(hard)]
    c = Counter(x for i, w in toks if i != 9 for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in toks)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    folds = [(t, 2 if i == 9 else 1 if i == 5 else 0) for i, t in texts_of(hard)]
    scores = plain_lm(folds, 3)
    assert Counter((i, round(s, 5)) for (i, _), s in zip(texts_of(hard), scores, strict=True)) == Counter((r["doc_id"], round(r["score"], 5)) for r in got)
    assert score_documents(empty, F.lit(COUNTED)).count() == 0
    assert score_documents(hard, F.lit(SCORED)).select(F.max("train_tokens")).first()[0] == 0


def test_tokens_are_those_of_bytes_and_cost_little():
    from xxhash import xxh64_intdigest

    from infragraph.llm.lm_scoring import BLOCK, END, tokens

    rng = random.Random(8)
    texts = [None, "", " ", "\x0b\x0c\x1c a B \x85c d", "A" * 200 + " " + "a" * 200 + " " + "a" * 199, "É é x\0y X\0Y"]
    texts += ["".join(rng.choice("abAB \n\té") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    texts += ["x" * (3 * BLOCK) + " yY " + "X" * (3 * BLOCK), "z " * BLOCK]
    words = [t.encode().lower().split() if t else [] for t in texts]
    h, sizes = tokens(texts)
    assert sizes.tolist() == [len(w) + 1 for w in words] and (h[np.cumsum(sizes) - 1] == END).all()
    both = set(zip([x for w in words for x in [*w, None]], h.tolist(), strict=True))
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})
    many = [" ".join(f"w{i}x{j}" for i in range(1000)) for j in range(300)]
    took = []
    for f in (lambda: tokens(many), lambda: [xxh64_intdigest(w) for t in many for w in t.encode().lower().split()]):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    assert took[0] < 2 * took[1]  # word by word it was 5 times


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_are_those_of_a_plain_model(spark, order):
    from infragraph.llm.lm_scoring import score_documents

    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(120):
        text = ["w0"]
        for _ in range(rng.randint(0, 60)):
            text.append(words[(words.index(text[-1]) * 3 + min(int(rng.expovariate(1)), 9)) % 40])
        docs.append((i, " ".join(text) if i % 17 else "", i % 3))
    got = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string, f int"), F.col("f"), order=order, chunk_bytes=2000).collect()}
    for (i, _, _), s in zip(docs, plain_lm([(t, f) for _, t, f in docs], order), strict=True):
        assert abs(got[i] - s) < 1e-6


# 3 ------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot", [48, 1])
def test_line_links(spark, hot):
    from infragraph.llm.line_dedup import line_links, lines_of

    rng = random.Random(2)
    base = ["".join(rng.choice("abcdéf ") for _ in range(rng.choice([rng.randint(24, 34), rng.randint(8, 27)]))) for _ in range(40)]
    lines = list(base)
    for x in base * 3:
        b = list(x)
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
        lines.append("".join(b))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    ids = {r["line"]: r["lid"] for r in lines_of(df).collect()}
    near = {(a, b): edits(a, b) for a, b in itertools.combinations(sorted(set(lines)), 2) if abs(len(a) - len(b)) <= 2}
    want = {tuple(sorted((ids[a], ids[b]))) for (a, b), d in near.items() if d <= min(2, len(a) // 12, len(b) // 12)}
    assert {(r["a"], r["b"]) for r in line_links(lines_of(df), 2, 12, hot).collect()} == want
    assert {min(len(a), len(b)) // 12 for (a, b), d in near.items() if tuple(sorted((ids[a], ids[b]))) in want} == {1, 2}


def test_line_links_of_a_frequent_segment(spark):
    """A segment that the sample shows to be frequent is dealt over several parts."""
    from infragraph.llm.line_dedup import line_links, lines_of

    lines = [f"a common beginning, then {i:03d}" for i in range(130)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    ids = {r["line"]: r["lid"] for r in lines_of(df).collect()}
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in itertools.combinations(lines, 2) if edits(a, b) <= 2}
    assert {(r["a"], r["b"]) for r in line_links(lines_of(df)).collect()} == want


def test_line_classes_and_removal(spark, hard, empty):
    from infragraph.llm.line_dedup import drop_repeated_lines, line_classes

    a, near = "a line of text that is long enough", "a line of text that is long enouhg"
    df = spark.createDataFrame([(2, f"{near}\nshort\nonly here, and nowhere else at all"), (1, f"{a}\nshort\n{a}"), (3, a)], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in line_classes(df).collect()}
    assert got[1, 0] == (1, 0, 1, True) and got[1, 2] == (1, 0, 1, False) and got[2, 0] == (1, 0, 1, False) and got[3, 0] == (1, 0, 1, False)
    assert got[1, 1][3] and got[2, 1] == (1, 1, 0, True) and got[2, 2][3]
    left = {r["doc_id"]: r["text"] for r in drop_repeated_lines(df).collect()}
    assert left == {1: f"{a}\nshort", 2: "short\nonly here, and nowhere else at all"}
    kept = drop_repeated_lines(hard)
    assert kept.columns == hard.columns and kept.where("text is null").count() == 1
    assert line_classes(hard).count() == sum(len(t.split("\n")) for _, t in texts_of(hard))
    assert line_classes(empty).count() == 0 and drop_repeated_lines(empty).count() == 0


def test_many_lines_in_one_text(spark):
    """Lines that go are found by hashing, not by looking through all of them for each."""
    from infragraph.llm.line_dedup import drop_repeated_lines

    line = "one line of a log that was copied again and again"
    docs = spark.createDataFrame([(1, "\n".join([line] * 200_000)), (2, "\n".join([line] * 200_000 + ["the last line is another one"]))], "doc_id long, text string")
    began = time.perf_counter()
    assert {r["doc_id"]: r["text"] for r in drop_repeated_lines(docs).collect()} == {1: line, 2: "the last line is another one"}
    assert time.perf_counter() - began < 90


def test_lines_that_share_a_hash(spark):
    """Two different lines under one 64-bit hash both stay."""
    from infragraph.llm import line_dedup as L

    docs = spark.createDataFrame([(1, "the first of two lines under one hash"), (2, "quite another line, which has the same hash"), (3, "the first of two lines under one hash")], "doc_id long, text string")
    cut, keep = L.lines_of(docs).withColumn("lid", F.lit(7).cast("long")), L.lines_of
    L.lines_of = lambda *a, **b: cut
    try:
        got = {r["doc_id"]: (r["class_doc_id"], r["kept"]) for r in L.line_classes(docs).collect()}
    finally:
        L.lines_of = keep
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_samples_far_below_a_millionth(spark):
    """A share of 1 in 2^31 of a scaled hash still takes rows, and counts are scaled by what was taken."""
    from infragraph.llm.common import in_sample

    share = 1e-5
    taken = spark.range(4_000_000).where(in_sample(share, "id", F.lit("x"))).count()
    assert 10 < taken < 90
    one = spark.range(1).select(in_sample(1e-12, F.lit(1)).alias("a"), in_sample(1.0, F.lit(1)).alias("b")).first()
    assert one["b"] is True
    tiny = in_sample(1e-12, F.lit(1))._jc.toString()
    assert " < 0" not in tiny


def test_every_line_class_keeps_a_line(spark):
    from infragraph.llm.line_dedup import drop_repeated_lines

    shared = [f"shared passage number {i} {c * 60}" for i, c in enumerate("abcdefghij")]
    own, tail = "the first of its class, copied once", "below the length"
    texts = {1: "\n".join(shared), 2: "\n".join([*shared, own]), 3: own, 4: "\n".join([*shared, tail]), 5: shared[0] + "\n \n"}
    left = {r["doc_id"]: r["text"] for r in drop_repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert left == {1: texts[1], 2: own, 4: tail}


# 4 ------------------------------------------------------------------------------------------------


def plain_digest(data):
    """The digest of bytes, loop by loop."""
    order, state = list(range(256)), 20
    for i in range(255, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        j = (state >> 33) % (i + 1)
        order[i], order[j] = order[j], order[i]
    counts = [0] * 128
    for i in range(len(data) - 4):
        for j, k, salt in ((1, 2, 2), (1, 3, 3), (2, 3, 5), (2, 4, 7), (1, 4, 11), (3, 4, 13)):
            h = order[salt]
            for x in (data[i], data[i + j], data[i + k]):
                h = order[h ^ x]
            counts[h % 128] += 1
    ranked = sorted(counts)
    q = ranked[31], ranked[63], ranked[95]
    out = [hashlib.sha256(data).digest()[0], min(255, round(8 * math.log2(len(data) + 1)))]
    out.append((100 * q[0] // q[2] % 16 << 4 | 100 * q[1] // q[2] % 16) if q[2] else 0)
    for i in range(0, 128, 4):
        out.append(sum(sum(c > x for x in q) << 2 * j for j, c in enumerate(counts[i : i + 4])))
    return bytes(out)


def plain_likeness(a, b):
    total = int(a[0] != b[0])
    step = abs(a[1] - b[1])
    total += step if step <= 1 else 4 * step
    for x, y in ((a[2] >> 4, b[2] >> 4), (a[2] & 15, b[2] & 15)):
        step = min(abs(x - y), 16 - abs(x - y))
        total += step if step <= 1 else 4 * (step - 1)
    for x, y in zip(a[3:], b[3:], strict=True):
        for shift in (0, 2, 4, 6):
            total += (0, 1, 2, 6)[abs((x >> shift & 3) - (y >> shift & 3))]
    return 1 - min(total, 300) / 300


def check_fingerprints(df, part_bytes):
    from infragraph.llm.fingerprint import fingerprint_edits

    docs = sorted(texts_of(df), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        e = (t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()
        a, b, c = plain_digest(t.encode()), plain_digest(e), plain_digest(after.encode())
        want.append((i, len(t), hashlib.sha256(e).hexdigest(), a.hex(), b.hex(), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = rows_of(fingerprint_edits(df, part_bytes=part_bytes))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == Counter(want)


@pytest.mark.parametrize("part_bytes", [1 << 20, 9000])
def test_fingerprints(hard, empty, part_bytes):
    from infragraph.llm.fingerprint import fingerprint_edits

    short = hard.withColumn("text", F.substring("text", 1, 4000))
    check_fingerprints(short, part_bytes)
    assert fingerprint_edits(empty).count() == 0


def test_fingerprints_of_many_null_ids(spark):
    from infragraph.llm.fingerprint import find_ranges

    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_fingerprints(df, 500)
    keys = spark.createDataFrame([(-(1 << 63), float(i)) for i in range(50)] + [(i, 0.0) for i in range(100)], "key long, head double")
    found = find_ranges(keys, 9)
    assert found.inner and found.count > 7


# 5 ------------------------------------------------------------------------------------------------


def test_ppm_code_lengths_match_a_plain_model():
    from infragraph.llm.language_id import Ppm

    train = {"x": [b"abracadabra", b"banana"], "y": [b"lorem ipsum dolor"]}
    model = Ppm.fit(train, order=2)

    def bits(text, learned, order):
        count = {}
        for t in learned:
            s = bytes(order) + t
            for i in range(order, len(s)):
                for k in range(order + 1):
                    count.setdefault(s[i - k : i], Counter())[s[i]] += 1
        total, s = 0.0, bytes(order) + text
        for i in range(order, len(s)):
            for k in range(order, -2, -1):
                if k < 0:
                    total += 8
                    break
                own = count.get(s[i - k : i])
                if own is None:
                    continue
                t, d = sum(own.values()), len(own)
                if own[s[i]]:
                    total -= math.log2(own[s[i]] / (t + d))
                    break
                total -= math.log2(d / (t + d))
        return total

    texts = [b"abra banana", b"dolor", b"", b"zzz\xff"]
    got = model.code_lengths(texts)
    for i, t in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert abs(got[i, j] - bits(t, train[name], 2)) < 1e-3


def test_language_id(spark, hard, empty):
    from infragraph.llm.language_id import fit_language_model, identify

    model = fit_language_model(hard, F.lit(True))
    got = rows_of(identify(hard, model))
    assert set(hard.columns) | {"lang_pred", "score", "bits_per_byte"} == set(got[0]) and len(got) == hard.count()
    for r in got:
        letters = any(ch.isalpha() for ch in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == letters and 0 <= r["score"] <= 1
    long = spark.createDataFrame([(1, "une phrase assez longue " * 9, "fr"), (2, "une autre phrase " * 20, "fr"), (3, "a short one", "en"), (4, "a short two", "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in identify(long, fit_language_model(long, F.lit(True), max_chars=100)).where("lang = 'fr'").collect()} == {"fr"}
    many = spark.range(300).selectExpr("id as doc_id", "concat('word', id, ' ', repeat(char(97 + id % 26), 3 + id % 7)) as text", "concat('l', lpad(id, 3, '0')) as lang")
    assert len(fit_language_model(many, F.lit(True)).languages) == 300
    marks = spark.createDataFrame([(1, "½ ² 3 ① Ⅷ _"), (2, "½ é"), (3, "ªʰ")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in identify(marks, model).orderBy("doc_id").collect()] == [True, False, False]
    none = fit_language_model(empty, F.lit(True))
    assert {r["lang_pred"] for r in identify(hard, none).collect()} == {"und"}
    assert identify(empty, model).count() == 0


def test_language_scores_and_folds(spark):
    """Held-out rows are not learned from, and scores are the posterior shares of plain code lengths."""
    from infragraph.llm.common import fold
    from infragraph.llm.language_id import Ppm, fit_language_model
    from infragraph.llm.queries import op5_language_id

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    learned = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] and len(r["text"]) <= 50_000:
            learned.setdefault(r["lang"], []).append(r["text"].encode())
    assert max(map(len, learned.values())) <= 150
    model = Ppm.fit(learned)
    # the other fold's texts under other languages change nothing
    swapped = docs.withColumn("lang", F.when(fold("doc_id", 4) == 2, "xx").otherwise(F.col("lang")))
    assert fit_language_model(swapped, ~(fold("doc_id", 4) == 2)).languages == model.languages
    got = {r["doc_id"]: r for r in op5_language_id(spark, "/root/testdata/sf0.001").collect()}
    right = 0
    for r in rows:
        own = got[r["doc_id"]]
        assert own["held_out"] == held[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        bits = model.code_lengths([r["text"].encode()])[0]
        share = [1 / sum(2.0 ** max(-1000, a - b) for b in bits) for a in bits] if max(bits) - min(bits) < 900 else None
        assert own["lang_pred"] == model.languages[int(np.argmin(bits))]
        least = min(bits)
        assert own["score"] == pytest.approx(1 / sum(2.0 ** -min(b - least, 1000) for b in bits), abs=1e-9)
        if share:
            assert own["score"] == pytest.approx(1 / sum(2.0 ** (least - b) for b in bits), abs=1e-9)
        right += own["held_out"] and own["lang_pred"] == r["lang"]
    assert right >= 0.9 * sum(held[r["doc_id"]] and r["lang"] is not None for r in rows)


def test_language_model_is_bounded(spark):
    """Many languages share the model's bytes; each is still learned."""
    from infragraph.llm.language_id import fit_language_model, identify

    rng = random.Random(12)
    rows = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(60)]
        rows += [(100 * k + i, " ".join(rng.choice(words) for _ in range(120)), f"l{k:02d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, small = (fit_language_model(docs, F.lit(True), max_bytes=n) for n in (1 << 30, 4 << 20))
    assert small.size < 0.6 * whole.size and small.languages == whole.languages and len(small.groups) == 8
    found = identify(docs, small).where("lang = lang_pred").count()
    assert found > 0.95 * len(rows)


# 6 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_links_and_components(spark, hot):
    from infragraph.llm.simhash import Part, allocate, links
    from infragraph.plans.components import connected_components

    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for f in fps * 3]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {f: root(f) for f in signed}
    plans = [allocate(np.array(signed, np.int64), len(signed), 2), [Part(tuple(range(40)), 1), Part(tuple(range(40, 64)), 0)], [Part(tuple(range(64)), 2)]]
    for plan in plans:
        assert sum(p.threshold + 1 for p in plan) == 3
        found = {r["node"]: r["component"] for r in connected_components(links(df, plan, 2, hot)).collect()}
        assert {f: found.get(f, f) for f in signed} == want


def plain_fingerprint(text, width):
    """Bits set in over half the hashes of a text's word shingles."""
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashed = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_simhash_rows(hard, empty):
    from infragraph.llm.simhash import keep_first, near_duplicates

    got = Counter((r["doc_id"], r["fingerprint"]) for r in near_duplicates(hard).collect())
    assert got == Counter((i, f"{plain_fingerprint(t, 3):016x}") for i, t in texts_of(hard))
    zero = {r["component_id"] for r in near_duplicates(hard).where("fingerprint = '0000000000000000'").collect()}
    assert zero == {2}
    assert near_duplicates(empty).count() == 0
    kept = keep_first(hard)
    assert kept.columns == hard.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id is null").count() == 1


def test_keep_first_of_repeated_ids(spark):
    from infragraph.llm.simhash import keep_first

    clean, copied = " ".join(f"own{i}" for i in range(40)), " ".join(f"copied{i}" for i in range(40))
    rows = [(1, copied), (2, copied), (2, clean), (2, clean), (3, clean + " tail")]
    got = keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, copied), (2, clean)]


@pytest.mark.parametrize("hot", [64, 2])
def test_keep_first_by_similarity(spark, hot):
    from infragraph.llm.simhash import keep_first, shingle_fingerprint, shingle_hashes

    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for i in range(14):
        base = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        base = passage + base[: rng.randint(0, 40)] if i % 2 else base
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(0, 1 + len(copy) // 40)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets, fps = [set(shingle_hashes(x, 5).tolist()) for x in texts], [shingle_fingerprint(x, 5) for x in texts]
    low, far = list(range(len(texts))), 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        alike = 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        bits = (fps[a] ^ fps[b]).bit_count()
        far += alike and bits > 2
        if alike or bits <= 2:
            old, new = max(low[a], low[b]), min(low[a], low[b])
            low = [new if x == old else x for x in low]
    got = keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot)
    assert {r["doc_id"] for r in got.collect()} == set(low) and far > 20


def test_keep_first_finds_components_once(spark, monkeypatch):
    """Components are looked for again only among those that later links join."""
    from infragraph.llm import simhash

    calls = []
    find = simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda *a, **b: calls.append(1) or find(*a, **b))
    texts = [" ".join(f"t{i // 3}w{k}" for k in range(60)) + " end" * (i % 3) for i in range(30)]
    got = simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(0, 30, 3))
    assert len(calls) == 1


def test_sets_with_a_passage_make_no_pairs(spark):
    """Of sets of 60 shingles that share 50 (71 % at most), none meet; all pairs of sets that share 54 or more of 60 do."""
    from infragraph.llm.simhash import _ring_pairs

    def rows(first, n, rest):
        return [(1, i, 60, rest, 0.5, False) for i in range(first, first + n)]

    ring = spark.createDataFrame(rows(0, 200, 50) + rows(1000, 12, 54) + rows(2000, 3, 60), "shingle long, sid long, size long, rest long, away double, linked boolean")
    got = {(r["a"], r["b"]) for r in _ring_pairs(ring, 80).distinct().collect()}
    assert got == set(itertools.combinations([*range(1000, 1012), *range(2000, 2003)], 2))


def test_signatures_bound_what_sets_share():
    from infragraph.llm.simhash import most_shared, signature

    rng = random.Random(13)
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.choice([0, 1, 5, 60, 400]))}
        b = {x for x in a if rng.random() < rng.choice([0, 0.5, 0.9, 1])} | {rng.getrandbits(64) for _ in range(rng.choice([0, 3, 90, 300]))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert len(a & b) <= most_shared(signature(x), signature(y), len(a), len(b)) <= min(len(a), len(b))


# 7 ------------------------------------------------------------------------------------------------


def test_suffix_arrays():
    from infragraph.llm.suffix_array import Shard, common_prefixes, repeated_windows, suffix_array

    rng = random.Random(4)
    for alphabet in (b"a", b"ab", b"abc\x00", bytes(range(256))):
        for _ in range(15):
            base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4)]
            segments = [rng.choice(base)[rng.randint(0, 9) :] + rng.choice(base)[: rng.randint(0, 30)] for _ in range(rng.randint(1, 20))]
            shard = Shard(segments)
            symbols, nth = [], 0
            for x in shard.data.tolist():
                nth += x == 1
                symbols.append(x + 1000 if x > 1 else (500 - nth if x == 1 else 0))
            sa = suffix_array(shard)
            assert sa.tolist() == sorted(range(shard.n), key=lambda i: symbols[i:])
            plcp = common_prefixes(shard, sa)
            for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
                k = 0
                while symbols[a + k] == symbols[b + k] and symbols[a + k] > 500:
                    k += 1
                assert plcp[a] == k
            seen, want = set(), []
            for s in segments:
                for i in range(len(s) + 1):
                    w = s[i : i + 5]
                    want.append(len(w) == 5 and w in seen)
                    seen.add(w)
            assert repeated_windows(shard, 5).tolist() == [*want, False]


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeats(spark, hard, empty, hot):
    from infragraph.llm.repeats import remove_repeats

    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(260))
    more = spark.createDataFrame([(20 + i, "".join(rng.choice("xyz ") for _ in range(50)) + passage[i * 3 : 200 + i * 5] + "tail" * i) for i in range(12)], "doc_id long, text string")
    docs = more.unionByName(hard.where("doc_id is null or doc_id not in (4, 10)").select("doc_id", "text")).unionByName(hard.where("doc_id = 4").limit(1).select("doc_id", "text"))
    seen, want = set(), {}
    for i, t in sorted(texts_of(docs), key=lambda r: r[0] if r[0] is not None else -1):
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for j in range(len(raw) - 99):
            w = raw[j : j + 100]
            if w in seen:
                gone[j : j + 100] = True
            seen.add(w)
        gone = gone[: len(raw)]
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) if len(raw) else 0
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, hot=hot).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1500
    assert remove_repeats(hard).count() == hard.count() and remove_repeats(empty).count() == 0


def test_repeats_under_null_and_shared_ids(spark):
    """Rows of one id are told apart by their texts; a text longer than a piece; runs of one byte."""
    from infragraph.llm.repeats import PIECE, remove_repeats

    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(12)]
    long = "".join(rng.choices("abcdefghijklmnop ", k=PIECE + 40_000))
    rows = []
    for i in range(900):
        text = "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 60))) + rng.choice(passages)[rng.randint(0, 30) :] + "x" * rng.choice([0, 0, 400])
        rows.append((None if i % 3 == 0 else i // 4, text))
    rows += rows[:40] + [(5000, long), (5001, "head " + long[PIECE - 300 : PIECE + 300] + " tail"), (5002, long[PIECE - 300 : PIECE + 300])]

    def place(r):
        sha = hashlib.sha256(r[1].encode()).digest()
        return (-(1 << 63), b"\0" + sha) if r[0] is None else (r[0], b"\1" + sha)

    seen, want = set(), {}
    for r in sorted(set(rows), key=place):
        raw = r[1].encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 99):
            w = raw[j : j + 100]
            if w in seen:
                gone[j : j + 100] = True
            seen.add(w)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[r] = (r[0], len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=50).collect())
    assert got == Counter(want[r] for r in rows)


def test_repeats_within_one_run_of_windows(spark):
    """Periodic texts whose windows all have the anchor that no other text has."""
    from infragraph.llm.repeats import RUN, remove_repeats

    rng = random.Random(11)
    rows, want = [], {}
    for i in range(60):
        period = rng.choice([1, 2, 3, 7, 20, 30, 60])
        unit = bytes(rng.choice(b"abcdefgh") for _ in range(period - 1)) + bytes([0x20 + i])  # no unit is another's
        n = rng.randint(period + 101, min(RUN + 99, 4 * period + 150))
        raw = (unit * n)[:n]
        rows.append((i, raw.decode()))
        want[i] = (n, n - period, 1, hashlib.sha256(raw[:period]).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


# 8 ------------------------------------------------------------------------------------------------


def plain_counts(path, texts):
    """Token counts straight from the library."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, hard, empty, tmp_path, name):
    from infragraph.llm.token_counts import count_tokens, read_cache, tokenizer_version

    path, cache = tokenizer_path(name), f"file://{tmp_path}/cache"
    more = [(30 + i, t) for i, t in enumerate(["a <s> b </s> <unk>", "<|endoftext|> x", "ﬁn ", "tab\there", "a<0x41>", "\u2581a b", " a b", "é", "e\u0301"])]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = texts_of(docs)
    want = Counter((i, len(t.encode()), n) for (i, t), n in zip(rows, plain_counts(path, [t for _, t in rows]), strict=True))
    for _ in range(2):
        got = rows_of(count_tokens(docs, path, cache, limit=100))
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    known = read_cache(spark, cache, tokenizer_version(path))
    assert known.count() <= len({t for _, t in rows})
    # a warm run asks the cache: wrong counts planted there come back, and nothing is added
    stale = f"file://{tmp_path}/stale"
    known.selectExpr(f"'{tokenizer_version(path)}' as version", "digest", "n_tokens + 1000 as n_tokens").write.parquet(stale)
    assert sum(r["n_tokens"] for r in rows_of(count_tokens(docs, path, stale))) == sum(k[2] * c for k, c in want.items()) + 1000 * len(rows)
    assert read_cache(spark, stale, tokenizer_version(path)).count() == known.count()
    assert count_tokens(empty, path).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def spark_xxhash(*values):
    """Spark's xxhash64 of ints (32 bits) given as (x,) and longs."""
    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True), h)
    return h


def plain_permuted(x, size, keys, seed):
    """Swap-or-not in plain Python."""
    for r in range(1, 13):
        k = spark_xxhash((seed,), *keys, (r,))
        p = ((k - (1 << 64) if k >> 63 else k) % size - x) % size
        if spark_xxhash((seed,), *keys, (r,), max(x, p)) & 1:
            x = p
    return x


def test_mixing(spark, hard, empty):
    from infragraph.llm.mixing import mix_report, mix_sources, mixed_documents, permuted

    got = rows_of(mix_report(hard, block_words=8))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.encode().split())) for i, t in texts_of(hard))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mix_report(hard.repartition(3), block_words=8))))
    targets = {r["source"]: r["target"] for r in mix_sources(hard).sources.collect()}
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    for n in (1, 2, 7, 100):
        turned = spark.range(n).selectExpr("id", f"{n} as n", "3 as s").select(permuted("id", "n", ["s"], 1).alias("p")).collect()
        assert sorted(r["p"] for r in turned) == list(range(n))
    assert mix_report(empty).count() == 0
    mixed = mixed_documents(hard)
    assert mixed.columns == hard.columns and mixed.count() > 0


def test_mixing_recomputed(spark):
    """Draws, redraws, permutations and the words of each document, in plain Python."""
    from infragraph.llm.mixing import mix_sources

    rng = random.Random(3)
    block, shard, seed = 4, 16, 9
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "b", "c", "d", None])) for i in range(150)]
    mix = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_words=block, shard_slots=shard)
    rows = [r.asDict() for r in mix.taken().collect()]
    sources = sorted((r.asDict() for r in mix.sources.collect()), key=lambda r: r["sk"])
    assert [r["source"] for r in sources] == ["a", "b", "c", "d", None]
    blocks = {r["sk"]: -(-r["source_size"] // block) for r in sources}
    wanted = {r["sk"]: math.floor(r["target"] * blocks[r["sk"]] / r["source_size"] + 0.5) for r in sources}
    total = sum(wanted.values())
    got, excess = Counter(), []
    used = Counter()

    def use(sk, k):
        turn, i = divmod(k, blocks[sk])
        used[sk, plain_permuted(i, blocks[sk], ((sk,), turn), seed)] += 1

    for at in range(total):
        u = (spark_xxhash((seed,), at // shard, at % shard) >> 11) / (1 << 53)
        low = 0
        for sk, w in sorted(wanted.items()):
            if low / total <= u < (low + w) / total:
                got[sk] += 1
                break
            low += w
    for sk in sorted(wanted):
        for k in range(got[sk]):
            if k < wanted[sk]:
                use(sk, k)
            else:
                excess.append((sk, k))
    missing = [(sk, k) for sk in sorted(wanted) for k in range(got[sk], wanted[sk])]
    assert len(missing) == len(excess) > 0
    for e in range(len(excess)):
        use(*missing[plain_permuted(e, len(excess), (len(excess),), seed)])
    by_source = Counter()
    for r in rows:
        words = sum(used[r["sk"], x // block] for x in range(r["off"], r["off"] + r["size"]))
        assert r["taken"] == words
        by_source[r["sk"]] += r["taken"]
    for r in sources:
        assert abs(by_source[r["sk"]] - r["target"]) < 2 * block


def test_source_targets(spark):
    from infragraph.llm.mixing import source_targets

    sizes = [("b", 100), ("a", 10), (None, 1000), ("c", 0)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert got["a"] == 20 and got["b"] == 200 and got["c"] == 0 and abs(got[None] - (1.5 * 1110 - 220)) < 1e-9


# 10 -----------------------------------------------------------------------------------------------


def test_quality(hard, empty):
    from infragraph.llm.quality import cascade, default_rules, measured, quality

    got = rows_of(quality(hard))
    want = []
    for i, t in texts_of(hard):
        w = [x for x in t.replace("\t", " ").replace("\n", " ").split(" ") if x]
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        rep = {p for own in at.values() if len(own) > 1 for k in own for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.split()]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    rules = default_rules()
    for order in ([r.name for r in rules], [r.name for r in reversed(rules)]):
        other = cascade(measured(hard), rules, order)
        assert Counter((r["doc_id"], r["rejected_by"] is None and not r["base_failed"]) for r in other.collect()) == Counter((r["doc_id"], r["kept"]) for r in got)
    assert quality(empty).count() == 0


def test_quality_of_long_runs(spark):
    """Runs without a letter, of which one word would be tried from each of its places, are read once."""
    from infragraph.llm.quality import quality

    rows = [(1, "7" * 400_000), (2, "- " + "7" * 200_000 + "\n" + " " * 200_000), (3, "=" * 100_000 + "x " + "word " * 60)]
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_words"], r["kept"]) for r in quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (61, False)} and time.perf_counter() - began < 60


def test_quality_order(spark):
    from infragraph.llm.quality import Rule, estimate

    rows = spark.range(100).selectExpr("id", "repeat('x', 9) as text_")
    rules = [Rule("few", F.col("id") < 10), Rule("most", F.col("id") < 60, scans=True), Rule("same", F.col("id") < 8), Rule("rest", F.col("id") >= 60)]
    got = [(e.name, e.cost, round(e.rejected, 4)) for e in estimate(rows, rules)]
    assert got == [("rest", 1.0, 0.4), ("few", 1.0, 0.1667), ("most", 10.0, 1.0), ("same", 1.0, 0.0)]


def test_folds(spark):
    from infragraph.llm.common import fold

    got = {r["i"]: r["f"] for r in spark.range(50).select(F.col("id").alias("i"), fold("id", 10).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 10 for i in range(50)}


def test_samples_reach_the_driver_as_arrays(spark, monkeypatch):
    """The samples of shingles and fingerprints are right and are not collected as a Row for each value."""
    from pyspark.sql import DataFrame

    from infragraph.llm.simhash import common_shingles, plan_for, shingle_hashes

    texts = [f"a passage that all have in common and then text number {i}" for i in range(12)]
    held = Counter(h for t in texts for h in set(shingle_hashes(t, 3).tolist()))
    fps = spark.range(50).selectExpr("xxhash64(id) as fp")

    def refuse(self):
        raise AssertionError("collected as rows")

    monkeypatch.setattr(type(fps) if "collect" in type(fps).__dict__ else DataFrame, "collect", refuse)
    got = common_shingles(spark.createDataFrame([(t,) for t in texts], "text string"), 3, 100)
    assert got.dtype == np.uint64 and got.tolist() == sorted(h for h, n in held.items() if n >= 8)
    assert sum(p.threshold + 1 for p in plan_for(fps, 50, 2, 100)) == 3
    assert len(common_shingles(spark.createDataFrame([], "text string"), 3, 100)) == 0
