import html
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import decontamination, html_text, language_model, media, mixing, neardup, pulearning, quality, sharding, token_counts
from tideline.llm.queries import edit_script

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, bucket string, registers string, score double, rep int"
LABELS = "doc_id long, quality int, toxic int"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        t = prose(rng, rng.randint(3, 120))
        if i % 5 == 1:
            t = t.upper().replace(" ", "!! ")
        if i % 7 == 2:
            t += " moron idiot"
        rows.append((i, t))
    rows += [(100 + k, rows[4][1]) for k in range(4)] + [(110, rows[6][1] + " tail"), (111, ""), (112, None), (None, "a null id"), (112, None), (113, "one"), (114, " \n\t "), (115, "long " * 30000)]
    rows = [(i, t, None if i == 3 else "en", "src0" if (i or 0) % 3 else None, len(t or ""), 1, 2, "x", "y", 0.5, 7) for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 1), int(i % 7 == 2)) for i in range(60)] + [(None, 1, 1), (5, None, None)], LABELS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)


def test_sharding_balances_and_keeps_groups(docs, nothing):
    rows = sharding.assign_shards(docs, 8).collect()
    assert len(rows) == docs.count()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (4, 100, 101, 102, 103)}) == 1
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 113} == {zlib.crc32(b"one")}
    assert sharding.assign_shards(nothing[0], 8).count() == 0


def test_media_round_trip(docs, nothing):
    for data in (b"", b"x" * 64, bytes(range(256)) * 700):
        payload = media.padded(data)
        stored = media.wrap(payload)
        found = media.describe(stored)
        track = found["tracks"][0]
        assert media.payload_of(stored, track) == payload and track["duration"] == track["sample_time"] == len(payload)
        a, b = track["keyframes"][-1]
        assert stored[a:b] == payload[(len(track["keyframes"]) - 1) * media.GOP * media.FRAME :][: b - a]
    assert media.describe(stored[:-5])["status"] == "error" and media.describe(None)["status"] == "error" and media.describe(b"abc")["status"] == "error"
    rows = media.store_texts(docs).collect()
    assert len(rows) == docs.count() and all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in rows)
    assert media.store_texts(nothing[0]).count() == 0
    probed = media.probe(media.store_texts(docs, keep_media=True), "media", "doc_id")
    assert probed.where("status = 'ok'").count() == docs.count()


def test_near_duplicates_equal_brute_force(docs, nothing, spark):
    rng = random.Random(3)
    base = prose(rng, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(w)))
    more = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text").where("doc_id IS NOT NULL").union(more)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(both, 2, 80).collect()}
    sets = {}
    for r in both.collect():
        w = re.findall(r"[^\x20\x09-\x0d]+", (r["text"] or "").lower())
        sets[r["doc_id"]] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    for i in sets:
        assert got[i]["component_id"] == top(i) and got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (top(i) == i)
    with_null = neardup.near_duplicates(docs, 5, 80)
    assert with_null.count() == docs.count() and with_null.where("doc_id IS NULL AND kept").count() == 1
    assert neardup.near_duplicates(nothing[0], 5, 80).count() == 0


def test_components_by_rounds(spark, monkeypatch):
    from tideline.llm import components as c

    monkeypatch.setattr(c, "AT_ONCE", 0)
    monkeypatch.setattr(c, "FOLD", 2)
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 20)] + [(40, 30), (41, 30)], "a long, b long")
    found = {r["node"]: r["component"] for r in c.components(edges).df.collect()}
    assert all(found[k] == 10 for k in range(10, 21)) and found[40] == found[41] == found[30] == 30 and len(found) == 14


def test_decontamination_catches_reordered_passages(docs, nothing, spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    cut = "junk eta THETA iota, kappa lambda mu junk junk alpha beta gamma delta epsilon zeta end"
    some = spark.createDataFrame([(900, cut), (901, "alpha beta gamma delta and nothing else"), (902, "a Tiny  item here"), (903, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(some, bench).collect()}
    assert set(got) == {(900, 1), (902, 4)} and got[900, 1]["tiles"] == 2 and got[900, 1]["coverage"] == 1
    assert {r["doc_id"] for r in decontamination.drop_contaminated(some, bench).collect()} == {901, 903}
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns
    assert decontamination.find_leaks(nothing[0], bench).count() == 0


def test_html(spark):
    trees = html_text.train()
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class=ad>Buy now</div><article><h1>Head &amp; line</h1><p>First   words here, and\nsome more of them.<p><b>Second</b>part goes on for a while.</article><script>x='<p>no</p>'</script><footer>&copy; me</footer>"
    assert html_text.extract([page], trees)[0] == "Head & line First words here, and some more of them. Secondpart goes on for a while."
    assert html_text.extract(["", "<<<>>", "<p", "</div>" * 50], trees)[0] == ""
    rng, good = random.Random(12345), 0
    for _ in range(60):
        p = html_text._layout(rng)
        nodes, segments = html_text.parse(p)
        mine = {at for at, s, _ in segments if s and "Δ" in s}
        want = " ".join("".join(" " if s is None else s for at, s, _ in segments if s is None or at in mine).split())
        good += html_text.extract([p], trees)[0] == want
    assert good >= 56
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<div>" * 3000 + "x")], "page_id long, url string, html string")
    assert html_text.main_text(df).count() == 3
    assert html.unescape("&amp;") == "&"


def test_token_counts_follow_edits(docs, nothing):
    counter = token_counts.Counter(token_counts.read_ranks())
    rng, letters = random.Random(2), "ab  \n'sé1 .,!漢\t"
    for _ in range(300):
        d = token_counts.Document("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 40, 400]))), counter)
        for _ in range(4):
            a, n = rng.randint(0, len(d.text) + 1), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 9, 200])))
            b = a + rng.choice([0, 1, 50])
            want = d.text[:a] + n + d.text[b:]
            if rng.random() < 0.5:  # kept and taken up again
                d = token_counts.Document(d.text, counter, d.tree.packed())
            d.edit(a, b, n)
            parts = counter.split(want)
            assert d.text == want and d.tree.total.tolist() == [len(want), len(parts), len(counter.encoding.encode_ordinary(want))]
    assert token_counts.count_tokens(docs, edit_script()).count() == docs.count()
    assert token_counts.count_tokens(nothing[0]).count() == 0
    stored = token_counts.build_trees(docs)
    once = token_counts.apply_edits(stored, edit_script())
    twice = token_counts.apply_edits(once.select("doc_id", "text", "tree"), F.array(F.struct(F.lit(0).alias("first"), F.lit(1).alias("last"), F.lit("Xy ").alias("text"))))
    for r in twice.collect():  # the tree of the tree's edits counts as the text itself does
        parts = counter.split(r["text"])
        assert r["text"][:3] == "Xy " and [r["n_chars_after"], r["n_pretokens_after"], r["n_tokens_after"]] == [len(r["text"]), len(parts), len(counter.encoding.encode_ordinary(r["text"]))]
    long = once.where("n_pretokens > 10000").first()
    assert long["n_reencoded"] < 100


def test_mixing_fills_and_redistributes(docs, nothing, spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100, 1), ("a", "en", "s2", 1000, 1), ("a", "fr", "s1", 50, 1), ("b", "en", "s1", 5000, 1)], "domain string, lang string, source string, capacity long, weight long")
    got = {tuple(r)[:3]: r["target"] for r in mixing.allocate(leaves, 2000).collect()}
    assert sum(got.values()) == 2000 and got["a", "en", "s1"] == 100 and got["a", "fr", "s1"] == 50
    assert got["a", "en", "s2"] == 1000 and got["b", "en", "s1"] == 850
    rows = mixing.mix(docs, 0.6)
    total = docs.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)))).first()[0]
    taken = rows.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert 0 < taken <= total * 0.6 + 30000
    assert mixing.mix(nothing[0], 0.5).count() == 0
    kept = mixing.keep_mixed(docs, 0.7)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_language_model_is_normalised_and_base_is_exact(docs, nothing):
    rows = language_model.score(docs.where("doc_id < 60")).collect()
    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in docs.where("doc_id < 60").collect()}
    counts: dict = {}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for x in [*w, None]:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*texts[r["doc_id"]], None]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in counts for x in w) and r["train_tokens"] == n and r["score"] < 0
    assert language_model.score(docs).count() == docs.count()
    assert language_model.score(nothing[0]).count() == 0


def test_classifiers(docs, labels, nothing):
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    judged = {r["doc_id"]: r["kept"] for r in rows}
    assert all(judged[i] == (i % 5 != 1) for i in range(60))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judge(docs, nothing[1]).count() == docs.count() and quality.judge(*nothing).count() == 0
    scores = pulearning.score(docs, labels).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert pulearning.score(docs, nothing[1]).count() == docs.count() and pulearning.score(*nothing).count() == 0


def test_pipeline_has_the_columns_of_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert set(out.columns) == set(docs.columns), name
        docs = out
    assert 0 < corpus_pipeline.STAGES[-1][1](spark, docs, d).count() < before
