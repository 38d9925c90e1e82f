import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sievework.llm import simhash

SCHEMA = "doc_id long, text string, fp string, extra int"


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA)


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t\n", "One", "one", "a B", "a b", "É x y z"]
    for _ in range(12):
        base = list(rng.choice(vocabulary, 300))
        for copies in range(4):
            texts.append(" ".join(base))
            base[int(rng.integers(300))] = "edit"
    texts += ["long " * 5000, "long " * 5000]
    out = {r.doc_id: r for r in simhash.near_groups(rows(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert len(out) == len(texts)
    assert {i: r.fingerprint for i, r in out.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in out.items()} == brute_components(fps)


def test_hot_bucket_is_dealt_anew(spark):
    """Patterns that share their low blocks exceed a small bucket bound; no link may be lost."""
    rng = np.random.default_rng(2)
    fps = {}
    for i in range(400):
        flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
        fps[sum(1 << int(b) for b in flips)] = i
    fps = {i: f for f, i in fps.items()}
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in fps.items()], "fp long, rep long")
    from sievework.operators.components import components

    found = {r.node: r.component for r in components(simhash.links(nodes, bucket_rows=20)).collect()}
    assert {i: found.get(i, i) for i in fps} == brute_components(fps)


def test_empty_table(spark):
    assert simhash.near_groups(rows(spark, [])).count() == 0


def test_null_id_and_repeated_rows(spark):
    """A row without doc_id comes back with the class of its neighbours, or with none where it has no others."""
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "a b c"), (None, "entirely other words stand here alone")]
    out = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 5)]


def test_tree_search_equals_pairs():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 100, dtype=np.uint64)
    fps[50:] = fps[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    forest = simhash.GrayForest(fps, np.array([100]))
    i, j = forest.search(np.arange(100), np.zeros(100, np.int64), 3)
    brute = {(a, b) for a, b in itertools.combinations(range(100), 2) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == brute


def test_components_on_a_long_path(spark):
    from sievework.operators.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    out = {r.node: r.component for r in components(edges.withColumn("c", F.lit(1))).collect()}
    assert out == {i: 0 for i in range(1, 201)} | {501: 500}


def test_near_duplicates_leave_one(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(3000)]
    docs, group = [], {}
    for g in range(40):
        base = list(rng.choice(vocabulary, 250))
        for copy in range(3):
            text = list(base)
            for _ in range(2 * copy):
                text[int(rng.integers(250))] = "changed" + str(int(rng.integers(1000)))
            docs.append((len(docs), " ".join(text)))
            group.setdefault(g, []).append(len(docs) - 1)
    docs += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (None, "a b"), (504, "c d"), (504, "c d")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rid string, wide int")
    out = simhash.drop_near_duplicates(frame)
    assert out.columns == frame.columns
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == [g[0] for g in group.values()] + [500, 502, 504]
    assert simhash.drop_near_duplicates(frame.limit(0)).count() == 0


def edited(rng, base, vocabulary, kind):
    """A copy of base whose five-word shingles have a Jaccard similarity of about 0.82."""
    n, cut = len(base), max(2, len(base) * 18 // 100)
    if kind == "truncated":
        return base[: n - cut]
    if kind == "appended":
        return base + list(rng.choice(vocabulary, cut))
    at = int(rng.integers(10, n - cut // 2 - 10))
    return base[:at] + list(rng.choice(vocabulary, max(1, cut // 2 - 4))) + base[at + max(1, cut // 2 - 4) :]


def jaccard(a, b):
    a, b = ({" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_block_edits_are_found_and_exact_similarity_decides(spark):
    rng = np.random.default_rng(21)
    vocabulary = [f"word{i}" for i in range(3000)]
    docs, near = [], []
    for g in range(240):
        base = list(rng.choice(vocabulary, int(rng.integers(100, 500))))
        copy = edited(rng, base, vocabulary, ("truncated", "appended", "replaced")[g % 3])
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        near.append(jaccard(base, copy) >= 0.8)
    for g in range(60):  # just below the bound: these must stay
        base = list(rng.choice(vocabulary, 300))
        docs += [(1000 + 2 * g, " ".join(base)), (1001 + 2 * g, " ".join(base[:232]))]
        near.append(False)
    assert sum(near) > 200
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    firsts = [d for d, _ in docs[::2]]
    assert kept == set(firsts) | {d + 1 for d, n in zip(firsts, near) if not n}


def test_one_large_group_of_variants_and_a_chain(spark):
    rng = np.random.default_rng(22)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, 200))
    docs = []
    for i in range(300):
        text = list(base)
        text[int(rng.integers(200))] = f"v{i}"
        docs.append((i, " ".join(text)))
    slide = list(rng.choice(vocabulary, 400))  # neighbours are near, the ends have nothing in common
    docs += [(500 + i, " ".join(slide[10 * i : 10 * i + 150])) for i in range(20)]
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == [0, 500]


def test_near_duplicates_come_from_the_index_and_sets_decide(spark, monkeypatch):
    """The Gray-order index's links reach the exact join as known ones; equal fingerprints of unlike sets make no link."""
    rng = np.random.default_rng(23)
    vocabulary = [f"word{i}" for i in range(3000)]
    docs = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, 2000))
        docs += [" ".join(base), " ".join([*base, "tail"])]
    cycle = "a b c d e " * 300
    docs += [cycle + " ".join(rng.choice(vocabulary, 30)) for _ in range(2)]
    assert len({brute_fingerprint(t, 5) for t in docs[-2:]}) == 1 and jaccard(docs[-2].split(), docs[-1].split()) < 0.8
    seen, join = [], simhash.joins.joined_sets

    def watched(sets, similarity, some, known):
        seen.append({(r.a, r.b) for r in known.collect()})
        return join(sets, similarity, some, known)

    monkeypatch.setattr(simhash.joins, "joined_sets", watched)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert kept == {*range(0, 24, 2), 24, 25}
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    node = {r.doc_id: r.node for r in frame.select("doc_id", F.xxhash64("text").alias("node")).collect()}
    near = [k for k in range(0, 24, 2) if (brute_fingerprint(docs[k], 5) ^ brute_fingerprint(docs[k + 1], 5)).bit_count() <= 3]
    assert len(near) > 6 and seen == [{tuple(sorted((node[k], node[k + 1]))) for k in near}]
