"""The near-duplicate stage, and the whole pipeline, against brute force on small tables."""

import random

import pytest

import corpus_pipeline
from isophase.llm import decontaminate, mixing, quality_dsir, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root long"


def kept(rows):
    """One of each group of rows whose fingerprints of 5-word shingles links of 4 bits connect: the smallest id, null last."""
    prints = [simhash.fingerprint((t or "").encode(), 5) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), (True, 0)), (d is None, d or 0))
    return sorted(low.values())


def corpus(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1) for d, t in rows], SCHEMA)


def test_simhash_stage(spark):
    rng = random.Random(5)
    text = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)]
    texts = [None, "", " ", "one", "One", "a b c d", "a b c d e"]
    for n in (12, 40, 300, 4000):
        base = text(n)
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 6):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(n)] = "new" + str(rng.randrange(1000))
            texts.append(" ".join(own))
    rng.shuffle(texts)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(4, texts[4]), (5, texts[20])]
    for parts in (1, 3):
        got = simhash.stage_simhash(spark, corpus(spark, rows).repartition(parts), "")
        assert got.columns == corpus(spark, []).columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == kept(rows)
    assert simhash.stage_simhash(spark, corpus(spark, []), "").count() == 0


def test_rows_of_one_id_with_different_texts_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = corpus(spark, [(1, a), (5, a), (5, b), (5, b), (None, b)])
    for parts in (1, 2, 3):
        got = simhash.stage_simhash(spark, docs.repartition(parts), "").collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (5, b)]


def without_repeats(texts):
    """Texts without the bytes under 200-byte strings that start twice."""
    from collections import Counter

    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for t, b in zip(texts, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append(t if t is None or not any(gone) else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode())
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(500)]
    filler = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items, passage = [filler(30) for _ in range(5)], filler(60)
    rows = []
    for i in range(400):
        t = filler(rng.randint(40, 120))
        t = f"{t} {items[i % 5]}" if i % 40 == 3 else f"{t} {passage}" if i % 25 == 4 else " ".join(w.upper() + "!!" for w in t.split()) if i % 8 == 5 else t
        rows.append((i if i % 50 else None, t))
    rows += [rows[1], (7, rows[9][1]), (9, filler(50)), (None, None), (None, ""), (500, filler(3000))]
    path = tmp_path_factory.mktemp("corpus")
    corpus(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 5), 0) for i in range(1, 400, 2)] + [(2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_pipeline_stage_by_stage(spark, folder):
    """Each stage's rows from its own input, by brute force or by what its operator says of every row."""
    sf, rows, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda r: (str(r.doc_id), r.text)
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["quality", "simhash", "suffix_dedup", "decontaminate", "mix"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = now.collect(), corpus_pipeline.materialize(stage(spark, now, sf))
        after = out.collect()
        if name == "quality":
            said = quality_dsir.quality_resample(now, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").count()
            assert len(after) == said and 0.75 * len(before) < said < 0.95 * len(before)
            assert not [r for r in after if r.text and r.text.isupper()]
        elif name == "simhash":
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == kept([(r.doc_id, r.text) for r in before])
        elif name == "suffix_dedup":
            want = without_repeats([r.text for r in before])
            assert sorted((str(r.doc_id), t) for r, t in zip(before, want, strict=True)) == sorted(map(key, after))
            assert all(r.n_chars == len(r.text or "") for r in after)
        elif name == "decontaminate":
            held = decontaminate.Items.of([(i, x.encode()) for i, x in enumerate(items)])
            best = lambda t: max(decontaminate.align(own, held.numbers((t or "").encode()))[0] / (2 * len(own)) for own in held.words)
            assert sorted(map(key, after)) == sorted(key(r) for r in before if best(r.text) < decontaminate.COPY)
            assert len(after) < len(before)
        else:
            served = mixing.mix(now).where("taken > 0").collect()
            assert sorted((str(r.doc_id), r.taken) for r in after) == sorted((str(r.doc_id), r.taken) for r in served)
        if name != "mix":
            assert out.columns == docs.columns
        now = out
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, after))


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    sf, _, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert suffix_dedup.stage_suffix_dedup(spark, corpus(spark, []), "").count() == 0
