"""The training-data operators against brute force, on small tables with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from isophase.llm import components, debruijn, decontaminate, license_scan, mixing, preference, quality_dsir, simhash, suffix_dedup, url_filter, weak_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, core long, fp long, key string"


def corpus(spark, rows):
    """Documents with columns whose names clash with those used inside the operators."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, 2, "k") for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ab", "é", "st", "on", "ß"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 60, 200, 400]))) for _ in range(24)]
    shared = " ".join(word() for _ in range(90))
    texts += [texts[3], texts[3], f"{shared} {texts[5]}", f"{texts[6]}\t{shared}", shared, shared[7:], "x " * 400, "", None, None]
    long = " ".join(word() for _ in range(30_000))
    texts += [long, long[:-3] + "zzz"]
    return [(i if i % 11 else None, t, rng.choice(["a", "b", "c", None])) for i, t in enumerate(texts)] + [(7, texts[7], "a"), (7, shared, "b")]


def body(t):
    return (t or "").encode()


@pytest.mark.parametrize("step", [suffix_dedup.STEP, 1])
def test_suffix_dedup(spark, rows, step):
    count = Counter(b[i : i + 200] for _, t, _ in rows for b in [body(t)] for i in range(len(b) - 199))
    want = []
    for d, t, _ in rows:
        b, gone = body(t), bytearray(len(body(t)))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), sum(g and not p for p, g in zip(b"\0" + gone, gone, strict=False)), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.suffix_dedup(corpus(spark, rows), step=step).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(bytes(r.kept).decode() is not None for r in got)


@pytest.mark.parametrize("block", [debruijn.BLOCK, 7])
def test_substring_dedup(spark, rows, block):
    order = lambda d: 1 << 62 if d is None else d
    first = {}
    for d, t, _ in rows:
        w = body(t).split()
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, 1 << 62), order(d))
    want = []
    for d, t, _ in rows:
        w = body(t).split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order(d):
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = debruijn.substring_dedup(corpus(spark, rows), block=block).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def slow_fingerprint(t):
    w = body(t).lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, rows):
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        low[root(i)] = min([x for x in (low.get(root(i)), d) if x is not None], default=None)
    want = [(d, f"{fps[i]:016x}", low[root(i)]) for i, (d, _, _) in enumerate(rows)]
    got = simhash.near_duplicates(corpus(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(corpus(spark, [])).count() == 0


def test_local_links_of_clusters_and_noise():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 900, np.uint64)
    near = np.concatenate([seeds[:3, None] ^ (np.uint64(1) << rng.integers(0, 64, (3, 300)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (3, 300)).astype(np.uint64))]).ravel()
    fps = np.unique(np.concatenate([seeds, near]))

    def classes(links):
        parent = {int(x): int(x) for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return {x: root(x) for x in parent}

    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    assert classes(simhash.local_links(fps, leaf=32)) == classes(zip(fps[i].tolist(), fps[j].tolist(), strict=True))


@pytest.mark.parametrize("levels,most", [(0, 1 << 15), (2, 1 << 15), (2, 40), (0, 5)])
def test_shards_hold_every_link(spark, levels, most):
    """Noise and tight clusters: whatever the levels and the size of shards, linked fingerprints meet in one."""
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 400, np.uint64)
    bit = lambda shape: np.uint64(1) << rng.integers(0, 64, shape).astype(np.uint64)
    near = (seeds[:2, None] ^ bit((2, 150)) ^ bit((2, 150)) ^ bit((2, 150))).ravel()
    fps = np.unique(np.concatenate([seeds, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    groups = {}
    for r in simhash.shards(df, levels=levels, most=most).collect():
        groups.setdefault(r.shard, set()).add(r.fp)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    where = {}
    for k, g in groups.items():
        for x in g:
            where.setdefault(x, set()).add(k)
    signed = fps.view(np.int64).tolist()
    assert len(i) > 300 and all(where[signed[a]] & where[signed[b]] for a, b in zip(i.tolist(), j.tolist(), strict=True))
    assert set(where) == set(signed) and max(map(len, groups.values())) <= max(3 * most, simhash.LEAF)


def test_blocks_grow_with_the_number_of_fingerprints():
    assert simhash.blocks_for(10) == 5 and simhash.blocks_for(10**9) == 6 and simhash.blocks_for(10**12) > 6
    assert len(simhash.block_keys(6)) == 15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 100), (7, 7), (105, 103)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_license_scan(spark):
    texts = ["Released under the MIT License.", "cc-by and CC BY-NC 4.0: licensed under CC BY-NC", None, "", "mit", "gnu general public licenses", "GNU  General\nPublic License, the Apache license"]
    texts.append("Permission is hereby granted, free of charge, to any person getting a copy of this software and its associated documentation files")
    docs = corpus(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(None, texts[0], "a"), (0, texts[0], "b")])
    got = sorted(license_scan.license_scan(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id or 0] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        places = [(i, x) for p, x in license_scan.PHRASES.items() for q in [p.split()] for i in range(len(words)) if words[i : i + len(q)] == q]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[-2].labels == "mit"


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/fr/1", "HTTP://X.ORG/fr/2?x#y", "https://m.example.com/de/", "http://notexample.com/de/", None, "", "no-scheme/fr/", "ftp://net", "http://b.net/?q=://x"]
    pages = spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert [got[i].rule for i in range(10)] == ["example.net/en/", "net/", "org/fr/", "example.com/de/", None, None, None, None, None, "net/"]
    assert (got[2].host, got[2].path, got[5].host, got[7].path, got[8].host) == ("x.org", "/fr/2", "", "", "net")
    assert [got[i].verdict for i in (0, 1, 2, 3, 9)] == ["allow", "block", "allow", "block", "block"]
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_model_generalises(spark):
    rows = [(f"host{i % 7}.{'bad' if i % 2 else 'good'}.test", f"/{i}/", bool(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "host string, path string, blocked boolean")
    w, b = url_filter.fit(df.where("path < '/3'"))
    p = url_filter.blocked_probability(df.host, df.path, w, b)
    assert df.where((p >= 0.5) == df.blocked).count() > 390


def test_url_filter_without_both_kinds_of_labels_and_with_long_urls(spark):
    urls = ["https://a.test/" + "x" * 20_000, "http://" + "b." * 3000 + "net/de/", None]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for rows, want in (([], "allow"), ([("h.test", "/", True)], "block"), ([("h.test", "/", False)], "allow")):
        labelled = spark.createDataFrame(rows, "host string, path string, blocked boolean")
        got = {r.page_id: r for r in url_filter.url_filter(pages, labelled=labelled).collect()}
        assert [got[i].verdict for i in range(3)] == [want, "block", want]
        assert got[1].rule == "net/" and got[0].rule is None


def test_mix(spark, rows):
    docs = corpus(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(body(t).split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    assert all(r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    assert sum(r.taken for r in got) <= total
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    left, open_, target = float(total), sorted(sizes, key=lambda s: (s is None, s)), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(open_)}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        for s in over or open_:
            target[s] = min(share[s], 3 * sizes[s])
            left -= 3 * sizes[s] if over else 0
        open_ = [s for s in open_ if s not in over] if over else []
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in target.values()}
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).drop("row").collect()), key=str) == sorted((tuple(r)[1:] for r in got), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_narrows(spark, monkeypatch):
    docs = corpus(spark, [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(600)])
    want = sorted(map(tuple, mixing.mix(docs).drop("row").collect()))
    monkeypatch.setattr(mixing, "FEW", 20)
    assert sorted(map(tuple, mixing.mix(docs, slots=8).drop("row").collect())) == want


def test_mix_of_rows_that_are_alike(spark):
    """A third of the rows share a null id, many of these their text too: each is served by itself, whatever the partitions."""
    rows = [(None, "w " * (1 + i % 2), "a", i) for i in range(200)] + [(i, "w " * (1 + i % 5), "abc"[i % 3], i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    got = [mixing.mix(docs.repartition(p)).collect() for p in (1, 4)]
    assert [len({r.row for r in x}) for x in got] == [600, 600]
    digest = [Counter((r.doc_id, r.size, r.target, r.taken) for r in x) for x in got]
    assert digest[0] == digest[1]
    total = sum(r.size for r in got[0])
    assert total - 20 <= sum(r.taken for r in got[0]) <= total
    for source_target in {r.target for r in got[0]}:
        assert abs(sum(r.taken for r in got[0] if r.target == source_target) - source_target) <= 10
    stage = mixing.stage_mix(spark, docs, "").collect()
    assert Counter((r.doc_id, len(r.text.split()), r.target, r.taken) for r in stage) == Counter({k: n for k, n in digest[0].items() if k[3]})
    assert mixing.stage_mix(spark, docs.limit(0), "").count() == 0


def test_quality_rules(spark, rows):
    def base(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)

    more = [*rows, (900, "a b\na b\n\n \n \na b #*|", "a"), (901, "LOUD!! " * 50, "a")]
    got = weak_rules.quality_rules(corpus(spark, more)).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[c] for c in cols)) for r in got) == Counter((d, *base(t)) for d, t, _ in more)
    assert not any(r.kept and r.base_failed for r in got)
    assert weak_rules.quality_rules(corpus(spark, [])).count() == 0


def pattern(votes):
    return int("".join("012"["agb".index(v)] for v in votes), 3)


def test_weak_supervision_separates():
    """Junk that two rules see goes; what one rule sees alone stays, which all-must-pass would drop."""
    seen = {"gggggggggg": 900, "bbgggggggg": 30, "gggbbggbgg": 40, "gagggggggg": 20, "gggggggggb": 10}
    post = dict(zip(seen, weak_rules.fit(np.array([pattern(v) for v in seen]), np.array(list(seen.values()), float)), strict=True))
    assert post["gggggggggg"] > 0.99 and post["gagggggggg"] > 0.9 and post["gggggggggb"] > 0.5
    assert post["bbgggggggg"] < 0.1 and post["gggbbggbgg"] < 0.1


@pytest.mark.parametrize("size", [1, 1000])
def test_weak_supervision_when_most_documents_fire_one_rule(size):
    seen = {"gggggggggg": 350 * size, "bggggggggg": 600 * size, "ggbbbggggg": 50 * size}
    post = weak_rules.fit(np.array([pattern(v) for v in seen]), np.array(list(seen.values()), float))
    assert post[0] > 0.9 and post[1] > 0.9 and post[2] < 0.1


def test_weak_supervision_learns_from_the_data():
    """The same pattern is kept or not by what its votes go together with elsewhere: without the rounds both are equal."""
    often, seldom = {"gggggggggg": 900, "ggbbgggggg": 80, "ggbggggggg": 4}, {"gggggggggg": 900, "ggbbgggggg": 1, "ggbggggggg": 80}
    got = [dict(zip(x, weak_rules.fit(np.array([pattern(v) for v in x]), np.array(list(x.values()), float)), strict=True)) for x in (often, seldom)]
    assert got[0]["ggbbgggggg"] < 0.1 and got[1]["ggbggggggg"] > 0.9
    assert got[0]["ggbggggggg"] < got[1]["ggbggggggg"]


def test_quality_rules_against_labels(spark):
    """Better than all-must-pass on labelled documents: no more junk kept, and clean documents kept that it drops."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id: r.kept for r in weak_rules.quality_rules(docs).collect()}
    clean = [kept[r.doc_id] for r in docs.collect() if labels.get(r.doc_id) == 1 and len((r.text or "").split()) >= 20]
    junk = [kept[d] for d, q in labels.items() if q == 0 and d in kept]
    assert sum(clean) > 0.98 * len(clean) and sum(junk) <= 0.05 * len(junk)


def test_decontaminate(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(4)] + ["tiny item", None, ""]
    filler = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    edited = items[1].split()
    edited[5], edited[17] = "other", "words"
    del edited[24]
    texts = [filler(300), f"{filler(50)} {items[0].upper()}. {filler(50)}", f"{filler(20)} {' '.join(edited)}", items[2], None, "", filler(3000)]
    docs = corpus(spark, [(i, t, "a") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2)} and got[1, 0] == got[3, 2] == 1.0 and 0.6 < got[2, 1] < 1
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block=31).collect()}
    assert blocks == set(got)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_part_that_many_texts_and_items_share(spark):
    """Seeds that many items have, and many texts, still find the items that a text holds."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    filler = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    stem = filler(24)
    items = [f"{stem} {filler(6)}" for _ in range(decontaminate.RARE + 15)]
    texts = [f"{filler(40)} {stem} {filler(40)}", filler(60), items[3], f"{filler(9)} {' '.join(items[5].split()[20:])}"]
    docs = corpus(spark, [(i, t, "a") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    every = range(len(items))
    assert got == {(0, i) for i in every} | {(2, i) for i in every}  # the stem is 24 of 30 words of each item


def all_pairs(items, texts):
    """Items that some stretch of a text aligns with, by Smith-Waterman of every item with every whole text."""
    held = decontaminate.Items.of(list(enumerate(x.encode() for x in items)))
    return {(d, i) for d, t in enumerate(texts) for i, own in enumerate(held.words) if decontaminate.align(own, held.numbers(t.encode()))[0] >= 2 * len(own) * decontaminate.COPY}


@pytest.mark.parametrize("size,step", [(40, 3), (40, 4), (25, 3), (25, 5), (40, 0.1), (25, 0.2), (25, 0.33), (60, 0.33)])
def test_recall_of_edited_copies(size, step):
    """Words changed at every third, fourth or fifth place, or a tenth to a third of them at random places."""
    rng = random.Random(size)
    vocab = [f"w{i}" for i in range(3000)]
    filler = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [filler(size) for _ in range(120)]
    held = decontaminate.Items.of([(i, " ".join(x).encode()) for i, x in enumerate(items)])
    found = right = 0
    for i, x in enumerate(items):
        odd = (lambda k: k % step == step - 1) if step >= 1 else (lambda k: rng.random() < step)
        text = " ".join([*filler(50), *(f"zz{k}" if odd(k) else w for k, w in enumerate(x)), *filler(50)]).encode()
        score = decontaminate.align(held.words[i], held.numbers(text))[0]
        if score >= 2 * size * decontaminate.COPY:
            right += 1
            found += any(c[0] == i for c in decontaminate.copies(held, text))
    assert right > 40 and found >= 0.97 * right, (found, right)


def test_decontaminate_against_all_pairs():
    """Texts and items of few words, copies edited, cut and repeated: what is found is what aligns, and every copy is."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    filler = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [filler(rng.choice([3, 12, 25, 40])) for _ in range(25)]
    texts = []
    for i in range(80):
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, len(own) // 4)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], ["new"], [own[k], "put"]])
            own = own or ["new"]
        texts.append(" ".join([*filler(rng.choice([0, 30, 400])), *own, *filler(rng.choice([0, 50]))]))
    items = [" ".join(x) for x in items]
    held = decontaminate.Items.of(list(enumerate(x.encode() for x in items)))
    got = {(d, c[0]) for d, t in enumerate(texts) for c in decontaminate.copies(held, t.encode())}
    want = {(d, i) for d, i in all_pairs(items, texts) if len(items[i].split()) >= 4}
    assert {x for x in got if len(items[x[1]].split()) >= 4} <= want
    assert len([x for x in want if x not in got]) <= 0.05 * len(want) and len(want) > 60


def test_decontaminate_stage_rows(spark, tmp_path):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    item = filler(30)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(5, filler(9), "a"), (5, f"x {item}", "a"), (None, item, "a"), (None, "free", "b"), (None, None, "c"), (7, "free " * 3000 + item, "a")]
    docs = corpus(spark, rows).withColumn("row", F.lit(1)).withColumn("k1", F.lit("z"))
    got = decontaminate.stage_decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.text) == sorted([("5", rows[0][1]), ("None", "free")])
    assert got.where("text is null").count() == 1
    assert decontaminate.stage_decontaminate(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_align_against_plain_smith_waterman():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(0, table[i][j] + (2 if x == y else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, table))


def test_preferences(spark):
    talk = [(1, 0, "system", "be kind"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", None), (1, 4, "assistant", "b"), (2, 0, "user", "only"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    table = spark.createDataFrame([(*t, 5) for t in talk], "conv_id long, turn long, role string, text string, kind long")
    chosen, rejected = preference.last_reply_pairs(table)
    for part in (1, 512):
        got = preference.format_preferences(chosen, rejected, part).collect()
        text = {}
        for r in sorted(got, key=lambda r: r.part):
            text[r.pair, r.kind] = text.get((r.pair, r.kind), "") + r.text
            for m in r.masks:
                assert r.kind != "prompt" and r.text[m.start : m.end].endswith(preference.END)
        full = lambda c: "".join(f"<|im_start|>{r}\n{x or ''}<|im_end|>\n" for k, _, r, x in talk if k == c)
        assert all(text[c, "prompt"] + text[c, "chosen"] == full(c) for c in (1, 2, None, 3))
        assert text[1, "rejected"] == "<|im_start|>assistant\na<|im_end|>\n"
        assert text[2, "chosen"] == text[2, "rejected"] == ""
    assert preference.format_preferences(*preference.last_reply_pairs(table.limit(0))).count() == 0


def test_importance_resampling(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        toxic, junk = i % 9 == 0, i % 7 == 3
        if toxic:
            words = [w if rng.random() > 0.05 else rng.choice(["vile", "foul"]) for w in words]
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words), "a"))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(None, None, "a"), (5000, "", "b")]
    got = quality_dsir.quality_resample(corpus(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id is not None and r.doc_id % 2 == 0 and r.doc_id < 1500]
    right = sum(r.kept == (r.doc_id % 9 != 0 and r.doc_id % 7 != 3) for r in held_out)
    assert right > 0.95 * len(held_out)
    assert not any(r.kept for r in got if r.doc_id in (None, 5000))


def test_the_noise_decides_among_equal_weights(spark):
    """Documents of the same words in another order weigh the same: the noise alone picks half of them, the same each time."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.sample(words, 30)), "a") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_dsir.quality_resample(corpus(spark, rows), labels, keep=0.5).collect()}
    assert len({round(r.score, 9) for r in got.values()}) == 1
    kept = {d for d, r in got.items() if r.kept}
    assert len(kept) == 150 and 40 < len([d for d in kept if d < 150]) < 110
    again = quality_dsir.quality_resample(corpus(spark, rows).repartition(3), labels, keep=0.5).where("kept").collect()
    assert {r.doc_id for r in again} == kept


def test_the_noise_has_its_natural_scale(spark):
    """A row with weight w is above one with weight 0 in 1 / (1 + exp(-w)) of the cases."""
    df = spark.range(20_000).select(quality_dsir.gumbel(F.lit("a"), F.col("id")).alias("a"), quality_dsir.gumbel(F.lit("b"), F.col("id")).alias("b"))
    for w in (0.0, 1.0, 3.0):
        share = df.where(F.col("a") + w > F.col("b")).count() / 20_000
        assert abs(share - 1 / (1 + np.exp(-w))) < 0.02


def test_log_ratios_and_calibration():
    raw, target = np.zeros(quality_dsir.BUCKETS, np.int64), np.zeros(quality_dsir.BUCKETS, np.int64)
    raw[:50], target[:50] = 1000, 400  # everyday words: 40 % of the raw text like the target
    raw[50:60], raw[60], target[60] = 800, 100, 90
    ratio = quality_dsir.log_ratios(raw, target)
    assert not ratio[:50].any() and not ratio[100:].any()
    assert (ratio[50:60] < -5).all() and not ratio[60]  # supported, but less than SLACK
    assert np.isclose(ratio[50], np.log(0.5 / (800 * 0.4 + 0.5)), atol=0.01)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, 20_000)
    slope, intercept = quality_dsir.calibration(x, (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 1)))).astype(int))
    assert abs(slope - 1.5) < 0.1 and abs(intercept + 1) < 0.1
    apart = quality_dsir.calibration(np.array([-9.0, -8, 2, 3]), np.array([0, 0, 1, 1]))
    assert 0 < apart[0] < 10


def test_counts_are_added_over_tasks(spark, rows, monkeypatch):
    docs = corpus(spark, rows).select(F.col("text").cast("binary").alias("body"), (F.col("source") == "a").alias("target")).repartition(5)
    raw, target = quality_dsir.bucket_counts(docs)
    want = [Counter(), Counter()]
    for _, t, s in rows:
        for part in quality_dsir.features(body(t)):
            want[0].update(part.tolist())
            if s == "a":
                want[1].update(part.tolist())
    for got, w in zip((raw, target), want, strict=True):
        assert {i: got[i] for i in np.flatnonzero(got)} == dict(w)


def test_quality_of_tables_without_labels_or_rows(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_dsir.quality_resample(corpus(spark, rows), labels).collect()
    assert [r.kept for r in got] == [r.score > quality_dsir.EMPTY for r in got] and len(got) == len(rows)
    one = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_dsir.quality_resample(corpus(spark, rows), one).count() == len(rows)
    assert quality_dsir.quality_resample(corpus(spark, []), one).count() == 0


def test_kth_largest(spark):
    values = [float(random.Random(1).randint(0, 60)) / 7 for _ in range(300)] + [-1e9]
    values += [1e9, 3.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 5, 150, 303):
        assert quality_dsir.kth_largest(df, "x", k, slots=4) == sorted(values, reverse=True)[k - 1]
