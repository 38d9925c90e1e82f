import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import similarity
from sievework.operators.components import components
from sievework.operators.similarity import contents, duplicate_decisions, shingle_sets, similar_links


def classes_of(sets, t):
    """Classes of nodes by brute force: node -> smallest node reachable."""
    to = {n: n for n in sets}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    keys = sorted(n for n in sets if sets[n])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= t * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                to[y] = x
    return {n: find(n) for n in sets}


def joined(spark, sets, t=0.8, **more):
    frame = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, tokens array<long>")
    links = similar_links(frame, t, **more)
    own = {r.node: r.component for r in components(links).collect()}
    return {n: own.get(n, n) for n in sets}, links


def mess(n, seed):
    """Chains of near sets, a template with many variants that are near only some, common tokens, tiny and empty sets."""
    rng = random.Random(seed)
    template = [rng.getrandbits(62) for _ in range(60)]
    out = {}
    for i in range(n):
        if i % 3 == 0:
            s = set(template)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(56)
                s -= set(template[at : at + 3])
                s |= {rng.getrandbits(62) for _ in range(rng.randint(0, 3))}
        elif i % 3 == 1 and i > 9:
            s = set(out[rng.choice([k for k in range(i) if k % 3 == 1]) - 5])
            for x in rng.sample(sorted(s), min(len(s), rng.randint(0, 3))):
                s.discard(x)
                s.add(rng.getrandbits(62))
        else:
            s = {rng.getrandbits(62) for _ in range(rng.randint(0, 40))} | set(template[: rng.choice([0, 5, 30])])
        out[i - 5] = s
    return out


@pytest.mark.parametrize("t,block", [(0.8, 512), (0.6, 7)])
def test_classes_equal_brute_force(spark, t, block):
    sets = mess(260, int(t * 10) + block)
    assert joined(spark, sets, t, block_sets=block)[0] == classes_of(sets, t)


def test_unlike_sets_with_the_same_common_tokens_make_few_pairs(spark, monkeypatch):
    """5,000 sets share 85 of 100 tokens and are not near: the places of the shared tokens tell."""
    common = list(range(85))
    sets = spark.range(5000).select(F.col("id").alias("node"), F.concat(F.array(*map(F.lit, common)), F.transform(F.sequence(F.lit(1), F.lit(15)), lambda k: F.col("id") * 100 + k + 1000)).cast("array<long>").alias("tokens"))
    seen = []
    near = similarity._near

    def counted(candidates, *more):
        seen.append(candidates.count())
        return near(candidates, *more)

    monkeypatch.setattr(similarity, "_near", counted)
    assert similar_links(sets).count() == 0 and sum(seen) == 0


def test_a_large_group_of_near_sets_makes_pairs_in_proportion(spark, monkeypatch):
    """3,000 variants of a text, each near the text and to about half of the others."""
    base = list(range(140))
    lost = lambda i: {(i * 37 + k) % 140 for k in range(1 + i % 9)}
    sets = {i: set(base) - lost(i) | {10_000 + i * 20 + k for k in range(len(lost(i)))} for i in range(3000)}
    seen, near = [], similarity._near

    def counted(candidates, *more):
        out = near(candidates, *more)
        seen.append(candidates.count())
        return out

    monkeypatch.setattr(similarity, "_near", counted)
    found, _ = joined(spark, sets)
    assert set(found.values()) == {0} and sum(seen) < 60 * len(sets)  # a pair with each leader of a token in the prefix, not 4.5 million


def test_only_prefixes_are_dealt(spark, monkeypatch):
    """Of 400 unlike sets that share 70 of 100 tokens, 21 tokens each are dealt, and those that all share are not among them."""
    sets = spark.range(400).select(F.col("id").alias("node"), F.expr("concat(sequence(1L, 70L), transform(sequence(1L, 30L), k -> id * 100 + k + 1000))").alias("tokens"))
    rows = similarity.prefixes(sets, 0.8)
    assert rows.count() == 400 * 21 and rows.where("token <= 70").count() == 0
    written, write = {}, similarity.materialise

    def counted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "materialise", counted)
    assert similar_links(sets).count() == 0 and written["lookups"] == 0


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_met_tokens(spark, size):
    rng = random.Random(size)
    rows = [(rng.randrange(60), rng.randrange(6) if rng.random() < 0.8 else 0) for _ in range(200)]
    nodes = {}
    for token, node in rows:
        nodes.setdefault(token, set()).add(node)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        out = [(r.token, r.node) for r in similarity.met(spark.createDataFrame([(t, v, 1, 0) for t, v in rows], "token long, node long, n int, pos int")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(out) == sorted((t, v) for t, own in nodes.items() if len(own) > 1 for v in own)


def test_classes_do_not_depend_on_the_order(spark, monkeypatch):
    sets = mess(200, 3)
    monkeypatch.setattr(similarity, "COMMON", 3)
    assert joined(spark, sets)[0] == classes_of(sets, 0.8)


def test_decisions(spark):
    long_ = " ".join(f"w{i}" for i in range(60))
    near = long_.replace("w59", "other")
    nearer = near.replace("w0 ", "another ")
    rows = [
        (3, long_), (1, near), (7, long_.upper().replace(" ", "\n\t ")), (9, nearer), (4, "short text"), (5, " Short  TEXT "), (6, "short text too"), (8, None), (2, ""), (10, " \n"), (None, near), (None, "alone here"),
    ]
    out = {(r.i, r.decision, r.related_id, r.class_id, None if r.confidence is None else float(r.confidence)) for r in duplicate_decisions(spark.createDataFrame([(*r, 1) for r in rows], "i int, t string, content int"), "i", "t").collect()}
    assert out == {
        (3, "PROBABLE_MATCH", 1, 1, round(55 / 57, 4)), (1, "NO_MATCH", None, 1, None), (7, "MATCH", 3, 1, 1.0), (9, "PROBABLE_MATCH", 1, 1, round(55 / 57, 4)), (4, "NO_MATCH", None, 4, None), (5, "MATCH", 4, 4, 1.0),
        (6, "NO_MATCH", None, 6, None), (8, "NO_MATCH", None, 8, None), (2, "NO_MATCH", None, 2, None), (10, "NO_MATCH", None, 10, None), (None, "MATCH", 1, 1, 1.0), (None, "NO_MATCH", None, None, None),
    }
    assert duplicate_decisions(spark.createDataFrame([], "i int, t string"), "i", "t").collect() == []


def test_shingles(spark):
    rows = [(1, "a b c d e F a B\tc\n d e"), (2, " a  b"), (3, ""), (4, "x " * 3000), (5, None), (6, "\u00a0 \x1c")]
    texts = contents(spark.createDataFrame(rows, "i long, t string"), "i", "t")
    assert {r.id: r.content for r in texts.collect()} == {1: "a b c d e f a b c d e", 2: "a b", 3: None, 4: ("x " * 3000).strip(), 5: None, 6: "\u00a0 \x1c"}
    assert {r.node: len(r.tokens) for r in shingle_sets(texts.withColumnRenamed("id", "node")).collect()} == {1: 6, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1}


def test_meetings_that_sizes_and_places_rule_out_are_no_lookups(spark):
    """Rows of a token: sets of 100 and 70 tokens, and two of 100 that meet too late; a pair that may be near stays, a hot token too."""
    rows = [(1, 1, 100, 0), (1, 2, 70, 0), (2, 3, 100, 15), (2, 4, 100, 0), (3, 5, 100, 3), (3, 6, 90, 0), (3, 7, 60, 0), (-4, 8, 100, 0)]
    rows += [(5, k, 4**k, 0) for k in range(9)] + [(6, k, 100 + k, 0) for k in range(3 * similarity.MEETING)]
    for size in (1, 7, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = sorted((r.token, r.node) for r in similarity.met(spark.createDataFrame(rows, "token long, node long, n int, pos int")).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert out == [(3, 5), (3, 6)] + [(6, k) for k in range(3 * similarity.MEETING)]


def test_only_sets_whose_bins_leave_room_are_made(spark):
    """Long sets that share one early token are candidates, but their sets aren't asked for; near ones are."""
    rng = random.Random(5)
    base = [rng.getrandbits(62) for _ in range(3000)]
    sets = {0: base, 1: base[:2900] + [rng.getrandbits(62) for _ in range(90)]}
    for node in range(2, 8):
        sets[node] = [7, *(rng.getrandbits(62) for _ in range(2500 + node))]
    frame, asked = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, tokens array<long>"), set()

    def some(nodes):
        asked.update(r.node for r in nodes.collect())
        return frame.join(nodes, "node", "left_semi")

    links = similarity.joined_sets(frame, 0.8, some)
    assert {(r.a, r.b) for r in links.collect()} == {(0, 1)} and asked == {0, 1}


def test_only_wanted_texts_are_dealt(spark, monkeypatch):
    """Of 5,000 texts the join that decides gets those that are wanted, and few more."""
    texts = spark.range(-2500, 2500).select(F.xxhash64("id").alias("node"), F.concat(F.lit("t"), "id").alias("content"))
    nodes = spark.range(-5, 5).select(F.xxhash64("id").alias("node"))
    seen, join = [], type(texts).join

    def counted(self, other, *more):
        seen.append(self.count())
        return join(self, other, *more)

    monkeypatch.setattr(type(texts), "join", counted)
    found = similarity.wanted(texts.unionByName(texts), nodes)
    assert sorted(r.content for r in found.collect()) == sorted(f"t{k}" for k in range(-5, 5)) and 20 <= seen[0] < 40
