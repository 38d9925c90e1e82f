import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm import language

SYLLABLES = {"xx": ["ba", "do", "ki", "lu"], "yy": ["sch", "ung", "ein", "ä"], "zz": ["ção", "ou", "nh", "e"]}


def make(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(600):
        lang = list(SYLLABLES)[i % 3]
        word = lambda: "".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 5))))
        rows.append((i, " ".join(word() for _ in range(30)), lang, 0.0, True))
    rows += [(600, None, "xx", 0.0, True), (601, " 12 .,", None, 0.0, True), (602, "", "yy", 0.0, True), (603, "Ungschein " * 20000, None, 0.0, True)]
    rows += [(None, "badoki", "xx", 0.0, True), (604, "ба до ки лу", None, 0.0, True), (5, rows[5][1], "zz", 0.0, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean")


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark)


def test_held_out_accuracy_and_edge_cases(docs):
    out = language.identify(docs, language.learn(docs)).collect()
    assert len(out) == 607
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.lang_pred == truth[r.doc_id] and not r.rejected
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (600, 601, 602)] == ["und"] * 3 and by[600].score == 0
    assert by[603].lang_pred == "yy" and by[None].lang_pred == "xx" and by[604].rejected


def test_held_out_languages_are_never_learned(spark, docs):
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a, b = language.learn(docs), language.learn(wrong)
    assert a.languages == b.languages and all(np.array_equal(x, y) for x, y in zip(a.logs, b.logs)) and a.calibration == b.calibration


def grams_of(texts):
    found = Counter()
    for text in texts:
        for w in text.split():
            padded = " " * 3 + w + " "
            found.update(padded[i : i + 4] for i in range(len(w) + 1))
    return dict(found)


class Brute:
    """Interpolated Kneser-Ney from plain dictionaries."""

    def __init__(self, grams, letters):
        self.letters, self.counts = letters, {4: dict(grams)}
        for n in (3, 2, 1):
            self.counts[n] = dict(Counter(g[1:] for g in {x[-(n + 1) :] for x in grams}))
        self.discount, self.total, self.kinds = {}, {}, {}
        for n, own in self.counts.items():
            ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
            self.discount[n] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            for g, c in own.items():
                key = n, g[:-1]
                self.total[key] = self.total.get(key, 0) + c
                self.kinds[key] = self.kinds.get(key, 0) + 1

    def __call__(self, context, letter):
        p = 1 / (len(self.letters) + 1)
        for n in range(1, 5):
            key = n, context[len(context) - n + 1 :] if n > 1 else ""
            if self.total.get(key):
                d = self.discount[n]
                p = max(self.counts[n].get(key[1] + letter, 0) - d, 0) / self.total[key] + d * self.kinds[key] / self.total[key] * p
        return p


def test_models_equal_plain_dictionaries():
    texts = {"a": ["abab abba baab cab", "abc abab", "ba"], "b": ["bcd dcb ccc", "bcd bcdd"]}
    grams = {k: grams_of(v) for k, v in texts.items()}
    models, letters = language.train(grams), {g[-1] for own in grams.values() for g in own}
    brutes = [Brute(grams[k], letters) for k in models.languages]
    for word in ["abab", "abc", "bcd", "dad", "xyz", "cabbage", "b"]:
        logs, sizes = models.score([word])
        padded = " " * 3 + word + " "
        want = [sum(math.log(p(padded[i : i + 3], padded[i + 3])) for i in range(len(word) + 1)) for p in brutes]
        assert sizes.tolist() == [len(word) + 1] and np.allclose(logs[0], want, atol=1e-4), word
    for context in ("   ", " ab", "bab", "zzz", "abc"):
        for p in brutes:
            assert abs(sum(p(context, x) for x in letters) + p(context, "?") - 1) < 1e-12


def test_all_documents_are_counted(spark, docs):
    """The counts are those of every document that may be learned from and doesn't calibrate."""
    models = language.learn(docs, aside=0)
    texts = {}
    for r in docs.where("lang is not null and text is not null").collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            texts.setdefault(r.lang, []).append(" ".join(language.words_of(r.text)))
    want = language.train({k: grams_of(v) for k, v in texts.items()})
    assert models.languages == want.languages and all(np.array_equal(x, y) for x, y in zip(models.logs, want.logs))


def test_no_languages_and_no_documents(docs):
    from pyspark.sql import functions as F

    none = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none is None and {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.learn(docs)).count() == 0
