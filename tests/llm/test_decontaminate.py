from collections import Counter

import pytest

from sievework.llm import decontaminate as d
from sievework.llm.decontaminate import Templates, contaminated, describe, drop_contaminated

ITEM = "A baker in Lyon sells 12 loaves each for 3 euros while Marie buys 12 rolls and pays with a 50 euros note how much is left"
OTHER = "The slow green turtle walked along the narrow river bank until the sun went down behind the hills"
SCHEMA = "doc_id long, text string, item_id int, coverage int"
DOCS = [
    (1, "Some text before. " + ITEM + " and after it more words follow here"),
    (2, ITEM.replace("12", "30").replace("Marie", "Anna").replace("50", "90").replace("Lyon", "Bonn")),
    (3, ITEM.replace("12 loaves", "30 loaves").replace("12 rolls", "31 rolls")),
    (4, "nothing to see here but ordinary words that go on for a while without any benchmark text"),
    (5, OTHER.upper().replace(" ", "\n")),
    (6, " ".join(OTHER.split()[:9]) + " something else entirely follows in this sentence and on"),
    (7, None),
    (8, ""),
    (9, "word " * 50000 + OTHER),
    (10, "one two three"),
    (None, OTHER),
    (1, "Some text before. " + ITEM),
]
BENCH = [(1, ITEM), (2, OTHER), (3, None), (4, "one two three"), (None, "x y z w v"), (5, ""), (6, "7 8 9 10 11 12 13 14 15")]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(*r, 0, 0) for r in DOCS], SCHEMA)
    return docs, spark.createDataFrame([(*r, 0) for r in BENCH], "item_id long, text string, doc_id int")


def test_finds_items_and_their_variants(tables):
    out = {(r.doc_id, r.item_id): r for r in contaminated(*tables).collect()}
    assert set(out) == {(1, 1), (2, 1), (3, 1), (5, 2), (9, 2), (10, 4), (None, 2)}
    assert out[1, 1].verbatim and not out[2, 1].verbatim and out[1, 1].coverage == out[2, 1].coverage == 1.0
    assert out[3, 1].coverage < 1.0  # 12 can't be both 30 and 31: the windows that say so don't count


def tokens_of(text):
    """(bare word, kind of slot or 0, kind if sentence openers may be names, opens a sentence) of each word."""
    out, opens, number = [], True, False
    for word in (text or "").split():
        _, flags, bare = describe(word)
        if not flags & d.EMPTY:
            unit = bool(flags & d.UNIT) and number
            kind = 1 if flags & d.NUMBER else 2 if unit else 3 if flags & d.CAPITAL and not opens else 0
            out.append((bare, kind, 3 if flags & d.CAPITAL and not kind and opens else kind, opens))
            opens, number = bool(flags & d.ENDS), bool(flags & d.NUMBER)
    return out


def brute(docs, bench):
    for doc_id, text in docs:
        doc = tokens_of(text)
        for item_id, wanted in bench:
            item = tokens_of(wanted)
            if item_id is None or not item:
                continue
            if len(item) < d.LEAST:
                bare = [w[0] for w in item]
                ends = [i + 1 == len(doc) or doc[i + 1][3] for i in range(len(doc))]
                at = [p for p in range(len(doc) - len(item) + 1) if [w[0] for w in doc[p : p + len(item)]] == bare and doc[p][3] and ends[p + len(item) - 1]]
                if at and (len(item) > 1 or len(doc) == 1):
                    yield doc_id, item_id, 1, 1, True
                continue
            width = min(d.WINDOW, len(item))
            least = min(d.LITERALS, (width + 1) // 2)
            template = lambda window, k: tuple(w[k] or w[0] for w in window)
            literal = lambda window, k: sum(w[k] == 0 for w in window)

            def keys(window):
                yield ("t", template(window, 1)) if literal(window, 1) >= least else ("v", tuple(w[0] for w in window))
                if template(window, 1) != template(window, 2) and literal(window, 2) >= least:
                    yield "t", template(window, 2)

            def fitting(hits):
                pairs = {(q, p): [((item[q + k][2], item[q + k][0]), doc[p + k][0]) for k in range(width) if item[q + k][2]] for p, q in hits}
                times = Counter(pair for at in pairs for pair in set(pairs[at]))
                first = {pair: min(at for at in pairs if pair in pairs[at]) for pair in times}
                to = {}
                for a, b in sorted(times, key=lambda x: (-times[x], first[x], x)):
                    if a not in to and not any(k[0] == a[0] and v == b for k, v in to.items()):
                        to[a] = b
                fits = {(p, q) for p, q in hits if all(to.get(a) == b for a, b in pairs[q, p])}
                return fits, all(a[1] == b for p, q in fits for a, b in pairs[q, p])

            hits, starts = set(), range(len(item) - width + 1)
            for q in starts:
                for p in range(len(doc) - width + 1):
                    if set(keys(item[q : q + width])) & set(keys(doc[p : p + width])):
                        hits.add((p, q))
            if any(0 < literal(item[q : q + width], 2) < least for q in starts):
                for shift in range(len(doc) - len(item) + 1):
                    if template(item, 2) == template(doc[shift : shift + len(item)], 2):
                        every = {(q + shift, q) for q in starts}
                        if len(fitting(every)[0]) == len(every):
                            hits |= every
            fits, same = fitting(hits)
            run = 0
            for p, q in fits:
                n = 1
                while (p + n, q + n) in fits:
                    n += 1
                run = max(run, n + width - 1)
            covered = {q for _, q in fits}
            if covered and (len(covered) >= d.COVERAGE * len(starts) or run >= d.RUN):
                yield doc_id, item_id, len(covered), len(starts), same


def test_rows_equal_brute_force(tables, spark):
    words = ITEM.split()
    more = [
        (20, "before it " + " ".join((OTHER + " " + ITEM).split()[3:30]) + " after"), (21, "7 8 9 10 11 12 13 14 15"), (22, "7 8 9 10 99 12 13 14 15"), (23, "50 12 30 " + ITEM.replace("12", "44")), (24, "12 rolls " + ITEM.replace("50", "12")),
        (25, " ".join(words[:12] + ["never"] + words[12:])), (26, ITEM.replace("Marie", "12")), (27, "sells 12 loaves each for 4 euros. " + ITEM.replace("12 loaves each for 3", "40 loaves each for 9").replace("12", "40")),
    ]
    rows = [r for r in DOCS if r[0] != 9] + more
    out = contaminated(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA), tables[1])
    got = sorted((r.doc_id or -1, r.item_id, r.windows, r.item_windows, r.verbatim) for r in out.collect())
    want = sorted((i or -1, *rest) for i, *rest in brute(rows, BENCH))
    assert got == want
    found = {r[:2] for r in got}
    assert {(20, 2), (21, 6), (25, 1)} <= found and (22, 6) not in found and (23, 1) in found


QUESTIONS = [
    (1, "Who wrote Hamlet?"), (2, "Compute 3 km 40 m plus 2 km 75 m in m."), (3, "Sort 3 9 4 1 7 2 8 6 upwards."), (4, "Alice has 3 apples and buys 4 more."), (5, "On 3 May Anna met Bob and Carl in Lyon, on 9 May Dora met Emil in Bonn."), (6, "Paris"),
    (7, "A train leaves at 30 past the hour and another one leaves at 30 past the next hour so when do both meet on the way home"),
]


def test_questions_asked_again_with_other_values(spark):
    """Short items, items of mostly slots, names that open a sentence, values that contradict each other."""
    twice = QUESTIONS[6][1].split()
    at = [i for i, w in enumerate(twice) if w == "30"]
    forty = [*twice[: at[0]], "40", *twice[at[0] + 1 :]]
    again = forty[: at[1]] + ["40"] + forty[at[1] + 1 :]
    parted = [*twice[: at[0]], "40", *twice[at[0] + 1 : at[1] - 2], "and", "then", *twice[at[1] - 2 : at[1]], "50", *twice[at[1] + 1 :]]
    rows = [
        (1, "We ask. Who wrote Hamlet? Nobody knows."), (2, "He asked who wrote hamlet in class."), (3, "Compute 7 km 10 m plus 5 km 25 m in m."), (4, "Compute 7 km 10 m plus 7 km 25 m in cm."), (5, "Then: Sort 8 1 2 3 9 5 6 4 upwards."),
        (6, "Sort 8 8 2 3 9 5 6 4 upwards."), (7, "Bob has 5 apples and buys 7 more."), (8, "Here Bob has 5 apples and buys 7 more."), (9, "Bob has 5 apples and buys 5 more."), (10, "On 4 June Ute met Karl and Otto in Rome, on 7 June Lisa met Paul in Oslo."),
        (11, "Paris"), (12, "We went to Paris"), (13, " ".join(again)), (14, " ".join(parted)), (15, "Numbers 1 2 3 4 5 6 7 8 9 10 11 12 in a table"),
    ]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    bench = spark.createDataFrame([(*r, 0) for r in QUESTIONS], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.windows, r.item_windows, r.verbatim) for r in contaminated(docs, bench).collect())
    assert got == sorted(brute(rows, QUESTIONS))
    found = {r[:2] for r in got}
    assert {(1, 1), (3, 2), (5, 3), (7, 4), (8, 4), (10, 5), (11, 6), (13, 7)} <= found
    assert not {(2, 1), (4, 2), (6, 3), (9, 4), (12, 6)} & found and not any(i == 15 for i, _ in found)


def test_text_ids(tables, spark):
    bench = spark.createDataFrame([("a", OTHER)], "item_id string, text string")
    assert {r.item_id for r in contaminated(tables[0], bench).collect()} == {"a"}


def test_blocks_give_the_same_rows(tables):
    one, many = (sorted(map(str, contaminated(*tables, block_chars=c).collect())) for c in (10**6, 60))
    assert one == many and len(one) >= 6


def test_drop_keeps_clean_rows_and_all_columns(tables):
    kept = drop_contaminated(*tables)
    assert kept.columns == tables[0].columns
    assert {4, 6, 7, 8} <= {r.doc_id for r in kept.collect()} <= {3, 4, 6, 7, 8}


def test_empty_tables(tables):
    docs, bench = tables
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == len(DOCS)


def test_placeholders():
    parse = Templates()
    x = parse(["Ann met Bob at 5 km and 7kg ... Then 3% of it".encode(), b"", b"In May"])
    kinds, sizes = dict(zip([parse.bare[w] for w in x.words], x.slot.tolist())), x.sizes
    assert kinds["ann"] == 0 and kinds["bob"] == 3 and kinds["5"] == 1 and kinds["km"] == 2 and kinds["7kg"] == 1 and kinds["3%"] == 1
    assert kinds["may"] == 3 and sizes.tolist() == [12, 0, 2]
