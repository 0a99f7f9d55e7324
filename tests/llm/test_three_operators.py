"""Clustering, personal data and spelling variants against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import clustering, personal, spelling
from tideline.llm.frames import table

DATA = "/root/testdata/sf0.001"

# --- clustering -------------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3):
    """(id, vector) in, {place: (cluster, distance)} out, and the centroids; every distance is computed."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    cents = [rows[i][1] for i in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in rows]

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, j), (_, v) in zip(nearest(), rows):
            groups[j].append(v)
        for j, vs in groups.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return nearest(), cents


def assert_clusters(out, rows, k=16, rounds=3):
    want, cents = plain_clusters(rows, k, rounds)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    inside = Counter()
    for d, j in want:
        inside[j] += d
    total = sum(inside.values())
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect())
    assert got == sorted((str(i), j, d, inside[j], total, shas[j]) for (i, _), (d, j) in zip(rows, want))


def whole(v):
    return [math.floor(64 * float(x)) for x in v]


def test_clusters_of_the_table_equal_all_distances(spark):
    df = table(spark, DATA, "embeddings")
    assert_clusters(clustering.clusters(df), [(r["vec_id"], whole(r["embedding"])) for r in df.collect()])


def test_ties_copies_and_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), [rng.choice([-0.5, 0.0, 0.25])] * 2 + [rng.choice([-0.02, 0.3])]) for _ in range(300)] + [(None, [0.0, 0.0, 0.3])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).repartition(3)
    assert_clusters(clustering.clusters(df, size=3, k=7), [(i, whole(v)) for i, v in rows], k=7)
    assert_clusters(clustering.clusters(df.where("vec_id < 3"), size=3, k=1), [(i, whole(v)) for i, v in rows if i is not None and i < 3], k=1)


def test_vectors_that_are_not_kept(spark):
    good = [0.1] * 64
    rows = [(1, good), (2, good[:63]), (3, None), (4, [None, *good[1:]]), (5, [float("nan"), *good[1:]]), (6, [float("-inf"), *good[1:]]), (7, [1e30, -1e300, *good[2:]])]
    out = {r["vec_id"]: r["distance"] for r in clustering.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, rounds=0).collect()}
    assert set(out) == {1, 7} and sorted(out.values())[0] == 0 and sorted(out.values())[1] > 1 << 50
    assert clustering.clusters(spark.createDataFrame(rows[1:3], "vec_id long, embedding array<double>")).collect() == []


def test_bounds_save_distances_and_lose_none():
    rng = np.random.default_rng(4)
    middles = rng.integers(-4000, 4000, (40, 8))
    rows = np.concatenate([m + rng.integers(-60, 60, (100, 8)) for m in middles])
    cents = clustering.Centroids(middles + rng.integers(-30, 30, middles.shape))
    own, upper, lower = clustering.first_assigned(rows, cents)
    computed = 0
    for _ in range(4):
        moved = np.array([rows[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else cents.at[j] for j in range(40)])
        cents = clustering.Centroids(moved, cents.at)
        own, upper, lower, n = clustering.reassigned(rows, own, upper, lower, cents)
        computed += n
        every = np.array([clustering.squared(rows, c) for c in cents.at])
        assert (own == every.argmin(axis=0)).all()  # the first of equals
        assert (upper >= np.sqrt(every.min(axis=0))).all() and (lower <= np.sqrt(np.partition(every, 1, axis=0)[1])).all()
    assert computed < 0.2 * 4 * rows.shape[0] * 40


# --- personal data ----------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out[kind].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    rng, some = random.Random(3), Counter()
    for letters, n in (("a@.1", 30), ("+1 -().2", 40), ("1. -+@a4", 60), ("12.", 30), ("aé@.1\"[]:=/😀", 50), ("0123456789 -", 60), ("0- ", 45)):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
            got, want = personal.spans(text), plain_base(text)
            assert {k: got[k] for k in want} == want, text
            some.update({k: len(v) for k, v in want.items()})
    assert min(some[k] for k in PATTERNS) > 20


def test_spans_of_the_table(spark):
    docs = table(spark, DATA, "documents")
    got = {r["doc_id"]: r for r in personal.find_personal(docs).collect()}
    for r in docs.collect():
        want = plain_base(r["text"] or "")
        assert [got[r["doc_id"]][f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        listed = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert got[r["doc_id"]]["spans"].startswith(listed)


def test_added_spans():
    def found(text):
        return {k: [text[a:b] for a, b in v] for k, v in personal.spans(text).items() if v}

    assert found("my IBAN: DE89 3704 0044 0532 0130 00 ok") == {"account": ["DE89 3704 0044 0532 0130 00"]}
    assert found("IBAN DE89 3704 0044 0532 0130 01") == {}
    assert found("SSN 123-45-6789, ssn: 000-12-3456") == {"account": ["123-45-6789"]}
    assert found("Account number 123456789, recount 123456789") == {"account": ["123456789"]}
    assert found("see https://bob:pw123@host.org/x") == {"email": ["pw123@host.org"], "login": ["bob:pw123"]}
    assert found('"john doe"@example.com jürgen@münchen.de a@[1.2.3.4] @x a@b x@[1.2.3.400]') == {"ip": ["1.2.3.4"], "mailbox": ['"john doe"@example.com', "jürgen@münchen.de", "a@[1.2.3.4]"]}
    assert found('password = "abc123def456" token of the time') == {"secret": ["abc123def456"]}


def test_work_follows_the_text_and_cases_are_defined(spark):
    for piece in ("1", "1.", "a@", "@", "+1", "iban ", "token=", "http://", '"@', "é@a", "+1 1", "a@a."):
        personal.spans(piece * 50_000)  # quadratic work would take minutes
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a@b.co"), (2, "😀" + "x" * 3_000_000 + " a@b.co")], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in personal.find_personal(df).collect())
    assert got == [(0, "email:0:6"), (1, ""), (1, ""), (2, "email:3000002:3000008")]
    assert personal.find_personal(df.limit(0)).collect() == []


# --- spelling variants ------------------------------------------------------------------------------------------------------


def plain_variants(rows, least=6, often=5, ratio=5, modulus=199):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    cut = {w: [w[:k] + w[k + 1 :] for k in range(len(w))] for w in words}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return b in cut[a] if len(a) > len(b) else a in cut[b]

    others = {w: [o for o in words if abs(len(o) - len(w)) <= 1 and o != w and near(w, o)] for w in words}
    form = {}
    for w in words:
        best = min(others[w], key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(others[w]), words[form[w]] if w in form else 0) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_variants_of_the_table_equal_all_pairs(spark):
    docs = table(spark, DATA, "documents").withColumn("word", F.lit(1)).repartition(3)
    assert rows_of(spelling.variants(docs)) == plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_small_alphabets_chains_and_cases(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        word = "".join(rng.choice("aabé") for _ in range(rng.randint(6, 9)))
        rows.append((rng.randrange(50) if i % 9 else None, " ".join([word] * rng.choice([1, 5, 30, 200]))))
    chain = [("abcdefg", 5), ("abcdefgh", 25), ("abcdefghi", 125), ("abcdefghij", 625), ("Abcdefghijk", 3125)]
    rows += [(1000, f"{w} " * n) for w, n in chain] + [(7, None), (7, ""), (7, "×÷abcdef1abcdefé"), *[(8, "z" * 5000 + " " + "z" * 4999 + "y")] * 6]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(spelling.variants(df, modulus=7))
    assert got == plain_variants(rows, modulus=7) and max(r[4] for r in got) > 5
    unslipped = {r["word"]: r["root"] for r in spelling.variants(df, modulus=0).collect()}
    assert unslipped["abcdefg"] == "abcdefghijk"
    assert spelling.variants(df.limit(0)).collect() == []
