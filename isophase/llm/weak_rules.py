"""Quality rules combined by weak supervision.

Each rule votes good or bad on a document or abstains. A text's pattern of votes is all that is modelled, as a mixture of
latent classes: clean text, and kinds of junk. Expectation maximisation estimates how many documents are of each class and
how often each rule calls a document of the class bad. A class is junk only if two rules at least call most of its
documents bad: what one rule sees alone nothing corroborates, so it is taken for that rule's false alarms. The posterior
probability of not being junk replaces "all rules must pass": a document with one bad vote can stay, and rules that fire
together on the same kind of junk do not count as independent proofs beyond their class. There are at most
``3 ** len(RULES)`` patterns, so the counts per pattern that come to the driver are bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the base measures: symbols, words in a window, fewest words, and the largest share of repeated words.
SYMBOLS, WINDOW, FEWEST, REPEATED = "#*$%&|<>", 8, 20, 0.30

#: Rules: a measure, the value from which on it votes good, and the one from which on bad (between them it abstains); good
#: is on the side of the smaller values if it is below bad.
RULES = (
    ("symbols_per_word", 0.01, 0.10),
    ("letter_share", 0.90, 0.75),
    ("dup_line_share", 0.05, 0.30),
    ("repeat_share", 0.05, 0.30),
    ("stutter_share", 0.02, 0.20),
    ("capital_share", 0.20, 0.50),
    ("exclamation_share", 0.05, 0.30),
    ("distinct_share", 0.45, 0.35),
    ("top_word_share", 0.15, 0.30),
    ("odd_word_length", 0.25, 0.75),
)
#: Words in a block of which the distinct ones are counted.
BLOCK = 200

#: Rounds of expectation maximisation. What is assumed beforehand: the share of junk, how often a rule calls clean text
#: bad, how often the rule that a kind of junk starts from calls it bad and how often the others do. All this weighs as
#: much as ``PSEUDO`` documents, however large the corpus is.
ROUNDS, JUNK, ON_CLEAN, ON_OWN, ON_OTHER, PSEUDO = 200, 0.1, 0.02, 0.8, 0.15, 20.0

_SYMBOL_BYTES = SYMBOLS.encode()
_NO_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_KEEP_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOL_BYTES)
_CONTINUATION = bytes(range(0x80, 0xC0))


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word, 9)
        if len(self) < 200_000:
            self[word] = code
        return code


_codes = _Codes()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words whose sequence occurs at least twice in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    name = np.zeros(n, np.uint64)
    for i in range(window):
        name = (name ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measure(body: bytes) -> dict[str, float]:
    """Base measures and the measures that the rules look at."""
    words = body.split()
    n = len(words)
    chars = sum(map(len, words)) - (len(body) - len(body.translate(None, _CONTINUATION)))
    symbols = len(body.translate(None, _KEEP_SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in body.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    many = max(1, n)
    capitals = sum(map(bytes.isupper, words))
    code = np.fromiter(map(_codes.__getitem__, words), np.uint64, n)
    top = int(np.unique(code, return_counts=True)[1].max()) if n else 0
    distinct = sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK))
    mean = chars / many
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "symbols_per_word": symbols / many, "letter_share": len(body.translate(None, _NO_LETTERS)) / max(1, sum(map(len, words))), "stutter_share": int((code[1:] == code[:-1]).sum()) / many, "distinct_share": distinct / many, "dup_line_share": dup / max(1, lines), "repeat_share": repeat / many,
        "capital_share": capitals / many, "exclamation_share": body.count(b"!") / many, "top_word_share": top / many, "odd_word_length": 0.0 if 3.5 <= mean <= 10 else 0.5 if 2.5 <= mean <= 14 else 1.0,
    }


def votes(m: dict[str, float]) -> int:
    """Pattern of votes in base 3: for each rule 0 abstains, 1 good, 2 bad."""
    pattern = 0
    for name, good, bad in RULES:
        x = m[name]
        if bad < good:
            x, good, bad = -x, -good, -bad
        pattern = pattern * 3 + (2 if x >= bad else 1 if x <= good else 0)
    return pattern


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [measure(t.as_py() or b"") for t in batch.column(1)]
        cols = [pa.array([m[k] for m in got], pa.int64()) for k in _BASE]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([votes(m) for m in got], pa.int32())], names=["doc_id", *_BASE, "pattern"])


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int = len(RULES)) -> np.ndarray:
    """Posterior that a document of each pattern is not junk, by expectation maximisation over the pattern counts.

    Given the class, rules are taken as independent, and an abstention as saying nothing. Class 0 is clean text; each of
    the others starts from one rule.
    """
    if not len(patterns):
        return np.empty(0)
    vote = patterns[:, None] // 3 ** np.arange(rules - 1, -1, -1) % 3
    says_good, says_bad = (vote == 1).astype(float), (vote == 2).astype(float)
    assumed = np.vstack([np.full(rules, ON_CLEAN), np.full((rules, rules), ON_OTHER) + np.eye(rules) * (ON_OWN - ON_OTHER)])
    begin = np.array([1 - JUNK] + [JUNK / rules] * rules)
    bad_vote, share = assumed.copy(), begin.copy()
    for _ in range(ROUNDS):
        like = np.log(share) + says_bad @ np.log(bad_vote).T + says_good @ np.log1p(-bad_vote).T
        post = np.exp(like - like.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = counts[:, None] * post
        share = (mass.sum(axis=0) + PSEUDO * begin) / (counts.sum() + PSEUDO)
        called, voted = mass.T @ says_bad, mass.T @ (says_bad + says_good)
        bad_vote = (called + PSEUDO * assumed) / (voted + PSEUDO)
    junk = (bad_vote >= 0.5).sum(axis=1) >= 2
    return 1 - post[:, junk].sum(axis=1)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: the base measures, ``base_failed``, ``p_good`` and ``kept``.

    ``base_failed``: fewer than ``FEWEST`` words, or over ``REPEATED`` of them in repeated windows. ``kept``: not
    failed, and a posterior of at least a half. A null text has no words and fails; rows with one id and text have
    equal results. Other columns are not looked at; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in _BASE) + ", pattern int"
    seen = materialize(own.mapInArrow(_measured, schema))
    counts = seen.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** len(RULES) rows
    good = fit(np.array([r["pattern"] for r in counts], np.int64), np.array([r["count"] for r in counts], float))
    rows = [(r["pattern"], float(p)) for r, p in zip(counts, good, strict=True)]
    table = docs.sparkSession.createDataFrame(rows, "pattern int, p_good double")
    failed = (F.col("n_words") < FEWEST) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * REPEATED)) * F.col("n_words"))
    out = seen.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return out.select("doc_id", *_BASE, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= 0.5)).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
