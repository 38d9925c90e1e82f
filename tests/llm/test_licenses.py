import math

import numpy as np
import pytest
import regex

from sievework.llm import licenses
from sievework.llm.licenses import AROUND, OTHER, TEMPLATES, scan

CASES = {
    "Released under the MIT License.": "mit",
    "first\nLicensed under the Apache License, Version 2.0.\nlast": "apache-2.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Copies of this tool may be distributed under the terms of the GNU General Public License, see COPYING": "gpl",
    "Distributed under GPLv3.": "gpl",
    "CC BY 4.0.": "cc-by",
    "Alle Rechte vorbehalten": "proprietary",
    "Tous droits réservés": "proprietary",
    "Todos los derechos reservados.": "proprietary",
    "some\nPermission is hereby granted, free of\ncharge, to any person obtaining a copy\nof this software and associated documentation\nfiles, to deal in the software without\nrestriction.": "mit",
    "Her fishing license was lost at the river": "unknown",
    "I have no permission to talk about it": "unknown",
    "nothing to see here\n\nReleased under the MIT License.": "mit",
    "nothing": None,
    "": None,
}


@pytest.fixture(scope="module")
def out(spark):
    texts = [*CASES, None, "word " * 30000 + "\nReleased under the MIT License.", "Released under the MIT License."]
    rows = [(i, t, "x", 0.5) for i, t in enumerate(texts)] + [(None, "Licensed under CC BY 4.0.", "x", 0.5)]
    return scan(spark.createDataFrame(rows, "doc_id long, text string, family string, probability double")).collect()


def test_families(out):
    by = {r.doc_id: r for r in out}
    for i, family in enumerate(CASES.values()):
        assert (by[i].family if i in by else None) == family
        if family not in (None, "unknown"):
            assert by[i].confirmed and by[i].probability > 0.25
    assert by[len(CASES) + 1].family == by[len(CASES) + 2].family == "mit" and by[len(CASES) + 1].paragraph_no == 0
    assert by[None].family == "cc-by" and by[1].paragraph_no == 0 and len(CASES) not in by


def test_held_out_surroundings(spark):
    rows = [(AROUND[-1].format(n), f) for f, own in TEMPLATES.items() for n in own] + [(t, "unknown") for t in OTHER]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.family for r in scan(docs).collect()}
    right = sum(found.get(i) == f or (f == "unknown" and i not in found) for i, (_, f) in enumerate(rows))
    assert right >= 0.93 * len(rows)


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    plan = scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert scan(docs.limit(0)).count() == 0


def brute(docs, model, threshold, families, cues):
    """The scan of (doc_id, text) in plain Python, from the model's vocabulary and weights."""
    place = {w: k for k, w in enumerate(model.stages[0].vocabulary)}
    weights, bias = model.stages[1].coefficientMatrix.toArray(), model.stages[1].interceptVector.toArray()
    split = lambda text: regex.findall(r"[\p{L}\p{N}]+", text.lower())
    pairs = lambda w: [" ".join(p) for p in zip(w, w[1:])] if len(w) > 1 else w
    notices = {f: [set(pairs(split(n))) for n in own] for f, own in TEMPLATES.items()}
    for doc_id, text in {(i, t) for i, t in docs if t is not None}:
        for number, paragraph in enumerate(regex.split(r"\r?\n[ \t\r]*\n\s*", text)):
            every, found = split(paragraph), {}
            for k in range(max(0, math.ceil((len(every) - 48) / 24)) + 1):
                words = every[24 * k : 24 * k + 48]
                if not set(words) & set(cues):
                    continue
                x = np.zeros(len(place))
                x[[place[g] for g in {*words, *pairs(words)} if g in place]] = 1
                z = weights @ x + bias
                chances = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                best = int(chances[1:].argmax()) + 1
                family = families[best] if chances[best] >= threshold else "unknown"
                near = max((len(n & set(pairs(words))) / len(n) for n in notices.get(family, [])), default=0.0)
                p, s = found.get(family, (0.0, 0.0))
                found[family] = max(p, chances[best]), max(s, near)
            for family, (p, s) in found.items():
                if family != "unknown" or len(found) == 1:
                    yield doc_id, number, family, round(p, 6), round(s, 9), s >= 0.5


def test_rows_equal_brute_force(spark, monkeypatch):
    long = " ".join(f"word{i}" for i in range(60))
    texts = [*CASES, None, f"{long} Released under the MIT License. {long}\n\n{long}\n \nLicensed under CC BY-SA 4.0. All rights reserved", " ".join(n for own in TEMPLATES.values() for n in own), *(AROUND[k % len(AROUND)].format(own[-1]) for k, own in enumerate(TEMPLATES.values())), *OTHER]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trained = licenses.train(docs)
    monkeypatch.setattr(licenses, "train", lambda _: trained)
    got = sorted(((r.doc_id, r.paragraph_no, r.family, round(r.probability, 6), round(r.similarity, 9), r.confirmed) for r in scan(docs).collect()), key=str)
    assert got == sorted(brute(rows, *trained), key=str) and len({r[2] for r in got}) > 8


def test_counts_and_examples_are_of_all_windows(spark):
    """A word that is common in many documents is no cue, and every cued window is learned from; a sample of 600 would differ."""
    rows = [(i, f"a plain text with number {i} and " + ("the permission of somebody" if i % 50 == 0 else "nothing else")) for i in range(5000)]
    rows += [(9000, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    notices = [["released", "under", "the", "mit", "license"], ["permission", "granted"]]
    seen, total = licenses.window_counts(docs, notices)
    assert total == 5000 and seen == {"the": 100, "permission": 100}
    found = licenses.examples(docs, ["permission", "mit"], list(enumerate(notices, 1))).collect()
    bare = [r for r in found if r.own]
    assert len(bare) == 100 and {r.label for r in bare} == {0.0} and {r.part for r in bare} == {0, 9}
    assert len(found) == 200 and {r.label for r in found if not r.own} == {1.0, 2.0}


def test_windows_without_a_cue_are_classified(spark, monkeypatch):
    """A notice is named whatever the cues are; a word of a notice that is common in the documents names none."""
    texts = [f"wir gehen mit nummer {i} in die stadt und mit freunden nach hause" for i in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (9000, "Released under the MIT License."), (9001, "Distributed under GPLv3.")], "doc_id long, text string")
    model, threshold, families, cues = licenses.train(docs)
    assert "mit" not in cues
    for kept in (cues, ["gplv3"]):
        monkeypatch.setattr(licenses, "train", lambda _, kept=kept: (model, threshold, families, kept))
        assert sorted((r.doc_id, r.family, r.confirmed) for r in scan(docs).collect()) == [(9000, "mit", True), (9001, "gpl", True)]
