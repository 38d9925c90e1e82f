import math
import zlib

import numpy as np
import pytest

from sievework.llm import toxicity
from sievework.llm.toxicity import EXACT, FUZZY, STEM, Automaton, edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def brute_kind(word, terms):
    found = 0
    for term, stem in terms.items():
        most = edits(len(term) - 2 * stem)
        d = min(distance(word[:k], term) for k in range(len(word) + 1)) if stem else distance(word, term)
        kind = (STEM if stem else EXACT) if d == 0 else FUZZY if d <= most else 0
        found = min(found or 9, kind or 9) % 9
        if kind == EXACT:
            return EXACT
    return found


def test_automaton_equals_edit_distance():
    terms = {"idiot": False, "scum": False, "worthless": False, "disgusting": False, "vequam": True, "trash": False}
    automaton, rng = Automaton(terms), np.random.default_rng(4)
    words = set(terms) | {"", "i", "scm", "vequamly", "veqamly"}
    for term in terms:
        for _ in range(150):
            w = list(term)
            for _ in range(int(rng.integers(1, 4))):
                k, ch = int(rng.integers(len(w) + 1)), "abcdiost"[int(rng.integers(8))]
                w = [w[:k] + [ch] + w[k:], w[:k] + w[k + 1 :], w[:k] + [ch] + w[k + 1 :]][int(rng.integers(3))]
            words.add("".join(w))
    for w in words:
        kind = automaton.kind(w)
        assert (kind > 0) == (brute_kind(w, terms) > 0), w
        if w in terms and not terms[w]:
            assert kind == EXACT


def test_context_tells_quotation_from_abuse():
    kinds = toxicity.Kinds(Automaton({"idiot": False}))
    plain, quoted, said = (toxicity.features(t, kinds, frozenset({"said"})) for t in ("you idiot go", 'a sign with "idiot" on it', "she said idiot is rude"))
    assert plain[0] > 0 and plain[3] == 0
    assert quoted[0] == 0 and quoted[3] > 0 and said[3] > 0


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = list(rng.choice(words, 40))
        if toxic:
            text[int(rng.integers(40))] = ["moron", "clown", "grumlex" + str(rng.choice(words))][int(rng.integers(3))]
        docs.append((i, " ".join(text), 1, 0))
        labels.append((i, int(toxic)))
    docs += [(900, None, 1, 0), (901, "", 1, 0), (902, "you moronn", 1, 0), (903, "long " * 30000, 1, 0), (None, "moron", 1, 0), (7, "w1", 1, 0)]
    labels += [(900, 0), (5, None), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    assert {"moron", "clown"} <= set(model.terms) and any(t.startswith("grum") and s for t, s in model.terms.items())
    out = toxicity.score(docs, model).collect()
    assert len(out) == 906
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            if r.doc_id < 900 and r.doc_id != 7:
                assert r.predicted == (r.doc_id % 5 == 0)
    by = {r.doc_id: r for r in out if r.doc_id not in (7,)}
    assert by[900].score == by[901].score < 0.3 and by[902].score > by[903].score


def test_held_out_labels_are_never_learned(tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert a.terms == b.terms and np.array_equal(a.weights, b.weights)


def test_terms_and_scores_equal_brute_force(tables):
    """The lexicon from plain counts over all labels that may be learned from; each score from its document alone."""
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    marked = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    texts = [(marked[r.doc_id], (r.text or "").lower().split()) for r in docs.where("text is not null").collect() if r.doc_id in marked]
    counts = {}
    for toxic, words in texts:
        for w in set(words):  # stems count words: once for each word of a document that begins so
            for key in [(w, False)] + [(w[:n], True) for n in toxicity.STEMS if len(w) > n]:
                pos, n = counts.get(key, (0, 0))
                counts[key] = pos + toxic, n + 1
    counts = {k: v for k, v in counts.items() if v[0] >= toxicity.MIN_TOXIC_DOCS}
    all_pos, all_docs = sum(t for t, _ in texts), len(texts)
    sure = math.log(len(counts)) + toxicity.SURE
    found = {}
    for key, (pos, n) in counts.items():
        odds = math.log((pos + 0.5) / (all_pos + 1)) - math.log((n - pos + 0.5) / (all_docs - all_pos + 1))
        chance = n * all_pos / all_docs
        if odds >= toxicity.MIN_LOG_ODDS and pos * math.log(pos / chance) - pos + chance >= sure and len(key[0]) >= 3:
            found[key] = pos
    assert set(model.terms) <= {term for term, _ in found} and all((t, s) in found for t, s in model.terms.items())
    for term, stem in found:  # what isn't kept is covered: by a shorter stem, or by what a stem mostly stands for
        covered = any(model.terms.get(term[:n]) for n in toxicity.STEMS if n <= len(term))
        assert term in model.terms or covered or stem
    for r in toxicity.score(docs, model).where("doc_id between 0 and 903").collect():
        text = {x.doc_id: x.text for x in docs.where(docs.doc_id == r.doc_id).collect()}[r.doc_id] if r.doc_id % 90 == 0 or r.doc_id > 900 else None
        if text is not None:
            words, hits = text.lower().split(), [0, 0, 0]
            for w in words:
                kind = Automaton(model.terms).kind(w) if brute_kind(w, model.terms) else 0
                hits[kind - 1] += kind > 0
            x = [1, *map(math.log1p, hits), 0, 0, 0, math.log1p(100 * sum(hits) / max(1, len(words))), float(sum(hits) > 0)]
            assert abs(r.score - 1 / (1 + math.exp(-float(np.dot(model.weights, x))))) < 1e-9


def test_reporting_words_are_learned(spark):
    rows = [(f"they reported that x{i} someone is a moron here" if i % 2 else f"you x{i} are a moron go away", int(i % 2 == 0)) for i in range(200)]
    rows += [("copied words before a moron in one place", 0)] * 300  # copies count once
    words = toxicity.learn_reporting(spark.createDataFrame(rows, "text string, toxic int"), {"moron": False})
    assert {"reported", "someone"} <= words and not words & {"you", "moron", "away", "copied"}


def test_no_labels_and_no_documents(spark, tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels.limit(0))
    assert not model.terms and {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0
