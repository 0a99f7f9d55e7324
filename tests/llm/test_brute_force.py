"""Operators and the pipeline against plain Python that compares everything with everything."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import decontamination, media, mixing, pulearning, quality, sharding
from tideline.llm.frames import table

DATA = "/root/testdata/sf0.001"


def h32(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:8], 16)


def greedy_tiles(words, item, least):
    """Longest common run of unmarked words again and again, by looking at every pair of places."""
    a, b, tiles = [False] * len(words), [False] * len(item), []
    while True:
        best = (least - 1, None)
        for i in range(len(words)):
            for j in range(len(item)):
                n = 0
                while i + n < len(words) and j + n < len(item) and not a[i + n] and not b[j + n] and words[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, (i, j))
        n, at = best
        if at is None:
            return tiles
        for k in range(n):
            a[at[0] + k] = b[at[1] + k] = True
        tiles.append(n)


def test_tiling_equals_all_places():
    rng = random.Random(8)
    some = 0
    for _ in range(250):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        item = [rng.choice(letters) for _ in range(rng.randint(1, 24))]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):  # pieces of the item anywhere
            k = rng.randint(0, len(item))
            at = rng.randint(0, len(words))
            words[at:at] = item[k : k + rng.randint(3, 12)]
        block = decontamination.Block([decontamination.codes(item)])
        got = {i: (c, n, m) for i, c, n, m in block.found(decontamination.codes(words), 0.0)}
        want = greedy_tiles(words, item, min(decontamination.SEED, len(item)))
        assert got == ({0: (sum(want), len(want), max(want))} if want else {})
        some += bool(want)
    assert some > 50


def test_windows_give_the_same_tiles(monkeypatch):
    rng = random.Random(9)
    some = 0
    for _ in range(300):
        letters = "abcdefgh"[: rng.randint(1, 6)]
        item = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        block = decontamination.Block([decontamination.codes(item)])
        found = []
        for pairs in (1 << 20, -1):
            monkeypatch.setattr(decontamination, "PAIRS", pairs)
            found.append(list(block.found(decontamination.codes(words), 0.0)))
        assert found[0] == found[1], (item, words)
        some += len(found[0])
    assert some > 50


def test_repeated_words_take_linear_memory():
    import resource
    import time

    for n, m in ((300_000, 15), (40_000, 4000)):
        block = decontamination.Block([decontamination.codes(["same"] * m)])
        before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
        assert list(block.found(decontamination.codes(["same"] * n), 0.6)) == [(0, m, 1, m)]
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000 and time.time() - began < 20
    item = ["a", "b"] * 500 + ["c"] * 300 + ["a"] * 700
    block = decontamination.Block([decontamination.codes(item)])
    assert list(block.found(decontamination.codes(["a"] * 9000 + ["c"] * 5000 + ["a", "b"] * 4000), 0.6))[0][1] == len(item)


def test_leaks_of_the_table_equal_all_pairs(spark):
    docs, bench = (table(spark, DATA, n) for n in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        w = words(r["text"])
        runs = defaultdict(set)
        for k in range(len(w) - 4):
            runs[tuple(w[k : k + 5])].add(k)
        for i, x in items.items():
            near = {k for j in range(len(x) - 4) for k in runs.get(tuple(x[j : j + 5]), ())}
            if near:  # what lies far from every shared run can't be in a tile
                mine = sorted({p for k in near for p in range(k, k + 5)})
                pieces = [w[p] if p in set(mine) else f"\0{p}" for p in range(mine[0], mine[-1] + 1)]
                if sum(greedy_tiles(pieces, x, 5)) >= decontamination.COVERAGE * len(x):
                    want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == want and got


def test_posteriors_equal_plain_sums(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    prior = sum(r["document_score"] for r in rows) / len(rows)
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        hosts[r["host"]].append(r["document_score"])
        paths[r["host"], r["path"]].append(r["document_score"])
    mean = lambda x: sum(x) / len(x)
    inside = lambda groups: sum((v - mean(x)) ** 2 for x in groups for v in x) / (len(rows) - len(groups))
    n, k = len(rows), len(hosts)
    s = inside(hosts.values())
    between = (sum(len(x) * (mean(x) - prior) ** 2 for x in hosts.values()) - (k - 1) * s) / (n - sum(len(x) ** 2 for x in hosts.values()) / n)
    of_hosts = max(1.0, s / between) if between > s / quality.MOST else quality.MOST
    s = inside(paths.values())
    between = (sum(len(y) * (mean(y) - mean(hosts[h])) ** 2 for (h, _), y in paths.items()) - (len(paths) - k) * s) / (n - sum(len(y) ** 2 / len(hosts[h]) for (h, _), y in paths.items()))
    of_paths = max(1.0, s / between) if between > s / quality.MOST else quality.MOST
    odds = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    for r in rows:
        x, y = hosts[r["host"]], paths[r["host"], r["path"]]
        host = (sum(x) + of_hosts * prior) / (len(x) + of_hosts)
        path = (sum(y) + of_paths * host) / (len(y) + of_paths)
        assert r["host_posterior"] == pytest.approx(host) and r["path_posterior"] == pytest.approx(path)
        p = r["document_score"]
        score = 0.0 if p == 0 else 1 / (1 + math.exp(-(math.log(p / (1 - p)) + quality.SITE_SHARE * (odds(path) - odds(prior)))))
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["kept"] == (score >= quality.KEEP)


def test_toxicity_finds_held_out_rows(spark):
    rng = random.Random(9)
    plain, toxic = [f"w{k}" for k in range(300)], ["moron", "idiot", "vermin", "scum"]
    rows, labels = [], []
    for i in range(1600):
        bad = i % 8 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(toxic)
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    out = pulearning.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1600) if zlib.crc32(str(i).encode()) % 4 == 2}
    truth = {r["doc_id"]: any(w in toxic for w in rows[r["doc_id"]][1].split()) for r in held}
    found = [r["doc_id"] for r in held if r["score"] >= 0.3]
    assert sum(truth[i] for i in found) >= 0.95 * sum(truth.values()) and sum(not truth[i] for i in found) <= 0.02 * len(held)


def test_the_risk_is_not_negative():
    """Positives that the unlabelled texts lack would drive the plain risk below zero: the correction turns that gradient round."""
    p, u = [np.array([0])] * 50, [np.zeros(0, int)] * 200
    w, b = pulearning.fit(p, u, 0.5, np.zeros(1))
    sp, su = 1 / (1 + math.exp(-(w[0] + b))), 1 / (1 + math.exp(-b))
    assert su - 0.5 * sp > -0.2 and sp > su


def test_media_equal_texts_and_bytes(spark):
    docs = table(spark, DATA, "documents")
    out = {r["doc_id"]: r for r in media.store_texts(docs).collect()}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        x = out[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"]) == (len(data), len(payload))
        assert x["payload_sha256"] == hashlib.sha256(payload).hexdigest() and x["tail_crc32"] == zlib.crc32(payload[-64:])


# --- the pipeline ---------------------------------------------------------------------------------------------------------


def one_of_each(docs):
    """The least id of each group of texts that chains of 80 per cent of five-word shingles link, by all pairs."""
    sets = {}
    for i, r in docs.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: r for i, r in docs.items() if top(i) == i}


def filled(budget, children):
    """children {name: (capacity, weight)}: parts of the budget, smallest capacity per weight first."""
    left, names, out = budget, sorted(children, key=lambda n: (children[n][0] * 1_000_000 / children[n][1], n)), {}
    while names:
        n = names[0]
        capacity, weight = children[n]
        open_ = sum(children[x][1] for x in names)
        if capacity * open_ <= left * weight:
            out[n] = capacity
            left -= capacity
            names.pop(0)
        else:
            done = 0
            for x in names:
                low = left * done // open_
                done += children[x][1]
                out[x] = left * done // open_ - low
            break
    return out


def mixed(docs, share):
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for i, r in docs.items()}
    leaf = {i: (f"domain{h32(r['source']) % 4}", r["lang"] or "", r["source"] or "") for i, r in docs.items()}
    leaves = defaultdict(int)
    for i, x in leaf.items():
        leaves[x] += tokens[i]
    target = {(): sum(leaves.values()) * round(share * 1000) // 1000}
    for depth in (1, 2, 3):
        groups = defaultdict(dict)
        for x, n in leaves.items():
            c, w = groups[x[: depth - 1]].get(x[:depth], (0, 0))
            groups[x[: depth - 1]][x[:depth]] = (c + n, w + 1)
        target = {k: v for up, children in groups.items() for k, v in filled(target[up], children).items()}
    kept = {}
    for x, n in leaves.items():
        whole = target[x] // n if n else 0
        rest, ahead = target[x] - whole * n, 0
        for i in sorted((i for i in docs if leaf[i] == x), key=lambda i: (h32(mixing.SEED, whole, i), i)):
            if whole or rest > 0 and 2 * ahead + tokens[i] <= 2 * rest:
                kept[i] = docs[i]
            ahead += tokens[i]
    return kept


def sharded(docs, shards):
    rows = []
    for i, r in docs.items():
        t = (r["text"] or "").encode()
        rows.append((hashlib.sha256(t).hexdigest(), h32(i) % sharding.SALTS, i, len(t) + 1))
    rows.sort()
    total, largest = sum(r[3] for r in rows), max(r[3] for r in rows)
    start, group, at = {}, defaultdict(int), 0
    for h, _, _, n in rows:
        start.setdefault(h, at)
        group[h] += n
        at += n
    out, slots, at = {}, defaultdict(int), 0
    for h, _, i, n in rows:
        together = group[h] <= max(largest, sharding.GROUP_SHARE * total / shards)
        middle = 2 * start[h] + group[h] if together else 2 * at + n
        s = min(shards - 1, middle * shards // (2 * total))
        out[i] = (n, s, slots[s])
        slots[s] += 1
        at += n
    return out


def test_pipeline_equals_plain_python(spark):
    """Only the classifier's verdicts are taken from the operator (they are compared above); all else is done again."""
    docs = {r["doc_id"]: r.asDict() for r in table(spark, DATA, "documents").collect()}
    kept = {r["doc_id"] for r in quality.judge(table(spark, DATA, "documents"), table(spark, DATA, "labels")).where("kept").collect()}
    rest = one_of_each({i: r for i, r in docs.items() if i in kept})
    items = [re.findall(r"[^\W_]+", (r["text"] or "").lower()) for r in table(spark, DATA, "benchmark").collect()]
    clean = {}
    for i, r in rest.items():
        w = re.findall(r"[^\W_]+", (r["text"] or "").lower())
        runs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        leak = False
        for x in items:
            if any(tuple(x[k : k + 5]) in runs for k in range(len(x) - 4)):
                near = [k for k in range(len(w) - 4) if tuple(w[k : k + 5]) in {tuple(x[j : j + 5]) for j in range(len(x) - 4)}]
                leak |= sum(greedy_tiles(w[near[0] : near[-1] + 5], x, 5)) >= decontamination.COVERAGE * len(x)
        if not leak:
            clean[i] = r
    want = sharded(mixed(clean, corpus_pipeline.MIX_SHARE), corpus_pipeline.SHARDS)
    got = {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(want) < len(clean) < len(rest) < len(docs)


def test_sites_that_differ_get_weak_priors_and_equal_ones_shrink_to_all(spark):
    frame = lambda rows: spark.createDataFrame(rows, "host string, path string, s double, ss double, n long")

    def found(paths):
        of = paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("ss").alias("host_ss"), F.sum("n").alias("host_n"))
        return quality.strengths(paths, of)

    prior, host, path = found(frame([("a", "x", 90.0, 82.0, 100), ("b", "x", 10.0, 2.0, 100)]))
    assert prior == 0.5 and host == 1.0 and path == quality.MOST
    prior, host, path = found(frame([(h, p, 50.0, 30.0, 100) for h in "abc" for p in "xy"]))
    assert (host, path) == (quality.MOST, quality.MOST)
    assert found(frame([])) == (0.5, quality.MOST, quality.MOST)
