import hashlib
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from sievework.llm.infill import Bits, fill_in_middle, restored


@given(st.lists(st.booleans(), max_size=1500))
def test_rank_and_select(bits):
    own = Bits(np.array(bits, bool))
    assert own.rank(np.arange(len(bits) + 1)).tolist() == [sum(bits[:i]) for i in range(len(bits) + 1)]
    ones = [i for i, b in enumerate(bits) if b]
    assert own.select(np.arange(len(ones))).tolist() == ones


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (n, "plain", None, None, text)
    if h[3] % 100 < 80:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


TEXTS = [
    None, "", " ", "a", " a", "a ", "\t\n a\r\x0b\x0cb  ", "<S", "a <P> b", "<M>", "x<<S", "M> y <", "é ñ 漢字 😀 x y z", "\x1c a \x1f b \x85 c", "S> P> <S <P b",
    "word " * 400_000, "\n" * 5000, "a" * 100_000, "one two three four five six seven eight nine ten",
]


def test_equals_brute_force(spark):
    rows = [(k * len(TEXTS) + i, t) for k in range(40) for i, t in enumerate(TEXTS) if k < 3 or len(t or "") < 1000]
    rows += [(None, "no id but words"), (7, "twice the same"), (7, "twice the same"), (-5, "a negative id <")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, N string, output int").repartition(5)
    out = fill_in_middle(docs).withColumn("back", restored(*map(spark_column, ("output", "form")))).collect()
    assert len(out) == len(rows)
    key = lambda x: (str(x[0]), str(x[1:]))
    expected = sorted(((i, *brute(i, t), t or "") for i, t in rows), key=key)
    assert sorted((tuple(r) for r in out), key=key) == expected
    assert {r.form for r in out} == {"plain", "spm", "psm"}


def spark_column(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_empty_table_and_other_parameters(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert fill_in_middle(docs).collect() == []
    every = fill_in_middle(spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id int, text string"), rate=100, spm=0)
    assert {r.form for r in every.collect()} == {"psm"}


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert "Exchange" not in fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
