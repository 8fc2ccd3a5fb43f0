"""Long license templates with a word put in at every place."""

from isophase.llm import license_scan as ls


def best_band(words, template):
    """Largest share of the template's k-grams on diagonals no more than DRIFT apart, by brute force."""
    grams = lambda w: [tuple(w[i : i + ls.K]) for i in range(len(w) - ls.K + 1)]
    votes = [(p - a, a) for p, g in enumerate(grams(words)) for a, t in enumerate(grams(template)) if g == t]
    return max(len({a for e, a in votes if d <= e <= d + ls.DRIFT}) for d, _ in votes) / (len(template) - ls.K + 1)


def matches(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = ls.scanned(docs)
    n = ls.template_grams(spark).select("template", "n").distinct()
    return ls.license_matches(own).join(own.select("row", "doc_id"), "row").join(n, "template").collect()


def test_one_word_put_in_anywhere(spark):
    rows = []
    for text, label in ls.TEMPLATES.items():
        t = text.split()
        if len(t) >= ls.LONG:
            rows += [(" ".join(["before", *t[:p], "zz", *t[p:], "after"]), label, t) for p in range(1, len(t))]
    assert len(rows) > 100
    got = {}  # the template's own matches: the phrase 'apache license' gives that label too
    for r in matches(spark, [text for text, _, _ in rows]):
        if not r.is_base:
            got[r.doc_id, r.label] = max(r.share, got.get((r.doc_id, r.label), 0))
    for i, (text, label, t) in enumerate(rows):
        want = best_band(text.split(), t)
        assert want >= ls.SHARE
        assert got.get((i, label), 0) >= want - 1e-12, text


def test_overlapping_matches_are_one(spark):
    text = next(t for t, label in ls.TEMPLATES.items() if label == "apache").split()
    text.insert(11, "zz")
    found = [r for r in matches(spark, [" ".join(text + ["other"] * 60 + text)]) if r.label == "apache" and not r.is_base]
    assert sorted((r.first, r.last) for r in found) == [(0, len(text) - 1), (len(text) + 60, 2 * len(text) + 59)]


def test_words_out_of_order_are_no_match(spark):
    """Every k-gram of a template, scattered or repeated, is not the template."""
    t = max((x for x in ls.TEMPLATES), key=len).split()
    scattered = " ".join(f"{a} {b} filler{i} filler{i} filler{i} filler{i} filler{i}" for i, (a, b) in enumerate(zip(t, t[1:], strict=False)))
    repeated = " ".join(t[:3] * 40)
    assert not [r for r in matches(spark, [scattered, repeated]) if r.n == len(t)]


def test_scores_against_brute_force(spark):
    """Score, labels and spans of texts with words of templates left out or changed, at every share from half to all."""
    import random

    rng = random.Random(7)
    long = [(x.split(), label) for x, label in ls.TEMPLATES.items() if len(x.split()) >= ls.LONG]
    texts = []
    for t, _ in long:
        for drop in range(0, len(t) // 2, 2):
            gone = set(rng.sample(range(len(t)), drop))
            texts.append(" ".join(["pre"] * 5 + [f"x{i}" if i in gone else w for i, w in enumerate(t)] + ["post"] * 5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in ls.license_scan(docs).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        shares = {label: best_band(words, t) for t, label in long if any(w in t for w in words) and set(zip(t, t[1:], strict=False)) & set(zip(words, words[1:], strict=False))}
        want = {label for label, x in shares.items() if x >= ls.SHARE}
        assert want <= set(found[i].labels.split(",")), text
        assert found[i].score >= max([x for x in shares.values() if x >= ls.SHARE], default=0) - 1e-12


def test_null_ids_and_long_texts(spark):
    """Different texts that share an id and a 32-bit hash are separate rows; a text of one phrase, very often, is counted whole."""
    from pyspark.sql import functions as F

    seen = spark.range(300_000).select(F.concat(F.lit("mit license "), "id").alias("a"), F.concat(F.lit("plain words "), "id").alias("b"))
    left, right = seen.select("a", F.hash("a").alias("h")), seen.select("b", F.hash("b").alias("h"))
    pair = left.join(right, "h").first()
    many = "the license mit license " * 5000
    docs = spark.createDataFrame([(None, pair.a, "x"), (None, pair.b, "x"), (None, pair.a, "x"), (3, many, "x"), (3, None, "x"), (3, "", "x")], "doc_id long, text string, words string")
    got = sorted(((r.n_words, r.n_base, r.base_labels) for r in ls.license_scan(docs).collect()))
    assert got == [(0, 0, ""), (0, 0, ""), (3, 0, ""), (3, 1, "mit"), (3, 1, "mit"), (20_000, 5000, "mit")]
    assert ls.license_scan(docs.limit(0)).count() == 0
