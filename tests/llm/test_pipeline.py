"""The pipeline against brute force on a small corpus with planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

ITEM = "which of the seven old towers on the northern hill was painted green by the baker before the long winter came"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vu", "we") for b in ("ban", "dor", "fel", "gim", "hus", "jat", "lek", "mor", "nip", "rud")]
    vocabulary += [a + b for a in vocabulary for b in ("a", "is", "on")]
    text = lambda n: list(rng.choice(vocabulary, n))
    docs, labels = [], []
    for i in range(240):
        words = text(int(rng.integers(60, 120)))
        if i % 6 == 0:
            words[5] = ["moron", "scumbag"][i % 12 // 6]
        docs.append([i, " ".join(words), "en", f"s{i % 3}"])
        labels.append((i, 0, int(i % 6 == 0)))
    passage = text(50)
    docs[1][1] += " " + " ".join(passage)
    docs[2][1] += " " + " ".join(passage)
    docs[3][1] += " " + ITEM
    docs.append([300, docs[4][1], "en", "s0"])  # an exact copy
    near = docs[5][1].split()
    near[30] = "changed"
    docs.append([301, " ".join(near), "en", "s1"])
    docs += [[302, None, "en", None], [303, "", "en", "s1"]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, passage


def test_stages_do_what_brute_force_does(spark, folder):
    path, docs, passage = folder
    frame, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = corpus_pipeline.materialise(stage(spark, frame, path), name)
        seen[name] = {r.doc_id: r for r in frame.collect()}
        if k < 4:
            assert frame.columns == columns
    clean = {d[0] for d in docs if not (d[0] < 240 and d[0] % 6 == 0)}
    assert set(seen["toxicity"]) == clean
    assert set(seen["near_dedup"]) == clean - {300, 301, 303} and 302 in seen["near_dedup"] or set(seen["near_dedup"]) == clean - {300, 301, 302}
    texts = {d[0]: d[1] for d in docs}
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["near_dedup"])
    for i in (1, 2):
        assert cut[i].text.split() == texts[i].split()[: -len(passage)] and cut[i].n_chars == len(cut[i].text)
    assert all(cut[i].text == texts[i] for i in cut if i not in (1, 2))
    assert set(seen["decontamination"]) == set(cut) - {3}
    final = seen["mixing"]
    assert set(final) <= set(seen["decontamination"]) and all(r.times in (1, 2) for r in final.values())
    sizes, taken = {}, {}
    for r in seen["decontamination"].values():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in final.values():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)


def test_run_agrees_with_itself(spark, folder):
    a, b = (sorted((r.doc_id, r.text, r.times) for r in corpus_pipeline.run(spark, folder[0]).collect()) for _ in range(2))
    assert a == b


CLASHING = ["rid", "nth", "d", "k", "spans", "spans_", "times", "taken", "row", "node", "bucket", "hits", "held_out"]


def test_clashing_columns_nulls_long_texts_and_empty_tables(spark, folder, tmp_path):
    path, docs, passage = folder
    rng = np.random.default_rng(3)
    long = " ".join(f"v{x}" for x in rng.integers(10**6, size=40_000))
    rows = [(*d, len(d[1] or "")) for d in docs[:60]] + [(None, "some words without an id " + " ".join(f"u{i}" for i in range(80)), None, None, None), (None, None, None, None, None), (900, long, "en", "s2", 1), (901, long + " tail", "en", "s2", 1), (7, docs[7][1], "en", "s1", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        frame = frame.withColumn(name, F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = corpus_pipeline.materialise(stage(spark, frame, path), name)
        assert frame.columns[: len(columns)] == columns
        for r in frame.collect():
            own = "none" if r.doc_id is None else r.doc_id
            assert all(r[c] == f"{c}-{own}" for c in CLASHING), name
        if k == 1:
            found = frame.collect()
            assert sum(r.doc_id == 7 for r in found) == 1 and sum(r.doc_id in (900, 901) for r in found) == 1
            assert any(r.doc_id is None and (r.text or "").startswith("some words") for r in found)
    assert frame.columns[len(columns) :] == ["times_", "taken_"]
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.materialise(stage(spark, empty, path), name)
        assert empty.count() == 0
