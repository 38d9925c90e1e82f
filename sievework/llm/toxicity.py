"""Toxicity scores from a lexicon trie intersected with Levenshtein automata (operator 7).

The lexicon is learned: whole words and word stems whose documents are marked toxic far more often than others, counted
over all labelled documents that may be learned from. Its trie and the Levenshtein automata of its terms run as one
deterministic automaton that is built as words need it: a state is the set of (trie node, edits so far) that a word's
letters can have reached. Most words leave it after three or four letters; a word is looked up once as long as a task's
memo lasts. Words around a hit tell abuse from quotation: those that are learned to stand by terms in harmless documents far
more often than in toxic ones, and quotation marks. A logistic regression weighs the counts of both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import held_out, materialise, release, utf8

STEMS = (4, 5, 6, 7)
MIN_TOXIC_DOCS, MIN_LOG_ODDS = 4, 2.5
REPORTING_LOG_ODDS = 1.0  # of words around terms in harmless documents
SURE = 2.0  # a term's surprise must exceed the logarithm of the number of candidates by this
FIT_ROWS = 20_000  # labelled documents that weights and contexts are fitted on, about, at most; chosen by a hash of doc_id
BROADCAST_LABELS = 2_000_000  # labels that are broadcast at most; more are joined by a shuffle
THRESHOLD = 0.3
REACH = 8  # words to either side of a hit that are read as its context
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_PARTS = regex.compile(r"[\p{L}\p{M}\p{N}]+|[\"“”„«»‹›]")
EXACT, STEM, FUZZY = 1, 2, 3
#: Weights before any label is seen: bias; exact, stem and fuzzy hits as abuse; the same as quotation; share of words; any.
PRIOR = np.array([-3.0, 2.0, 2.0, 0.5, 0.3, 0.3, 0.1, 0.5, 1.0])


def edits(length: int) -> int:
    """Misspellings that a term of this length may have."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """terms: text -> whether it is a stem (any ending may follow)."""

    def __init__(self, terms: dict[str, bool]):
        self.children, self.ends, self.budget = [{}], [None], [0]
        for term, stem in sorted(terms.items()):
            most = edits(len(term) - 2 * stem)
            node = 0
            self.budget[0] = max(self.budget[0], most)
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                node = nxt
                self.budget[node] = max(self.budget[node], most)
            self.ends[node] = (stem, most)
        self._reset()

    def _reset(self):
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []  # by state and letter
        self.stems: list[int] = []  # by state: kind of a stem that ends here
        self.last: list[int] = []  # by state: kind of a word that ends here
        self.start = self._number(self._close({(0, 0)}))

    def _close(self, state: set) -> tuple:
        """With letters that the word leaves out; only the fewest edits for each node."""
        todo, best = sorted(state), {}
        while todo:
            node, used = todo.pop()
            if used > self.budget[node] or best.get(node, 9) <= used:
                continue
            best[node] = used
            todo += [(child, used + 1) for child in self.children[node].values()]
        return tuple(sorted(best.items()))

    def _number(self, state: tuple) -> int:
        if (found := self.ids.get(state)) is None:
            found = self.ids[state] = len(self.states)
            ends = [(*self.ends[node], used) for node, used in state if self.ends[node] and used <= self.ends[node][1]]
            self.states.append(state)
            self.steps.append({})
            self.stems.append(min((FUZZY if used else STEM for stem, _, used in ends if stem), default=0))
            self.last.append(min((FUZZY if used else EXACT for _, _, used in ends), default=0))
        return found

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, used in self.states[state]:
            out.update((child, used + (letter != ch)) for letter, child in self.children[node].items())
            out.add((node, used + 1))
        found = self.steps[state][ch] = self._number(self._close(out))
        return found

    def kind(self, word: str) -> int:
        """EXACT, STEM, FUZZY, or 0 for a word that no term explains."""
        if len(self.states) > 50_000:
            self._reset()
        steps, stems, state, found = self.steps, self.stems, self.start, 0
        for ch in word:
            after = steps[state].get(ch)
            state = self._step(state, ch) if after is None else after
            if stems[state]:
                found = min(found or 9, stems[state])
                if found == STEM:
                    return STEM
            if not self.states[state]:
                return found
        end = self.last[state]
        return min(found, end) if found and end else found or end


def features(text: str, kinds: dict, reporting: frozenset) -> list[float]:
    """One document's numbers in the order of PRIOR (without the bias); kinds maps words to what the automaton says.

    A hit between quotation marks, or with one of the words `reporting` around it, counts as quotation.
    """
    text = text.lower()
    words = text.split()
    if not any(map(kinds.__getitem__, words)):
        return [0.0] * (len(PRIOR) - 1)
    parts = _PARTS.findall(text)
    counts, marks = [0] * 6, 0
    for i, part in enumerate(parts):
        if not part[0].isalnum():
            marks += 1
            continue
        kind = kinds[part]
        if kind:
            around = parts[max(0, i - REACH) : i + REACH + 1]
            open_ = any(not p[0].isalnum() for p in parts[max(0, i - REACH) : i]) and any(not p[0].isalnum() for p in parts[i + 1 : i + REACH + 1])
            quoted = (open_ and marks % 2 == 1) or not reporting.isdisjoint(around)
            counts[kind - 1 + 3 * quoted] += 1
    hits = counts[0] + counts[1] + counts[2]
    return [*map(math.log1p, counts), math.log1p(100 * hits / max(1, len(words))), float(hits > 0)]


class Kinds(dict):
    """A task's memo of the automaton's answers: the first kind of the words in a string without white space."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        parts = [word] if word.isalnum() else _WORDS.findall(word)
        found = self[word] = next(filter(None, map(self.automaton.kind, parts)), 0)
        return found


@dataclass
class Model:
    terms: dict[str, bool]
    reporting: frozenset
    weights: np.ndarray


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """((doc_id, text, toxic) of all documents that may be learned from, how many labels there are)."""
    marked = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = marked.count()
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marked) if count <= BROADCAST_LABELS else marked, "doc_id"), count


def learn_terms(rows: DataFrame) -> dict[str, bool]:
    """The lexicon from (text, toxic): every term whose documents are toxic beyond chance, counted over all these rows.

    What comes to the driver is the model itself: the significant terms, without those that a shorter stem covers.
    """
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}]+)")))).alias("word"))
    words = materialise(words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("docs")), "words")
    stems = [F.when(F.length("word") > n, F.struct(F.substring("word", 1, n).alias("term"), F.lit(True).alias("stem"))) for n in STEMS]
    whole = F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))
    terms = words.select("pos", "docs", F.explode(F.array(whole, *stems)).alias("t")).where("t is not null")
    terms = terms.groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("docs").alias("docs")).where(F.col("pos") >= MIN_TOXIC_DOCS)
    terms = materialise(terms, "terms")
    release(words)
    all_pos, all_docs = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not all_pos or all_pos == all_docs:
        return {}
    odds = F.log((F.col("pos") + 0.5) / (all_pos + 1)) - F.log((F.col("docs") - F.col("pos") + 0.5) / (all_docs - all_pos + 1))
    chance = F.col("docs") * F.lit(all_pos / all_docs)  # of this many toxic documents by the base rate; Chernoff's bound on more
    surprise = F.col("pos") * F.log(F.col("pos") / chance) - F.col("pos") + chance
    sure = F.log(F.lit(float(max(1, terms.count())))) + SURE
    beyond = (F.col("pos") >= MIN_TOXIC_DOCS) & (odds >= MIN_LOG_ODDS) & (surprise >= sure)
    likely = [(r.t.term, r.t.stem) for r in terms.where(beyond & (F.length("t.term") >= 3)).select("t").collect()]
    release(terms)
    if not likely:
        return {}
    # copies of a document are no independent signs: what counts in the end are different places, by the words on either side
    found = {(r.term, r.stem): r.pos for r in _places(rows, likely).where(beyond).collect()}
    kept: dict[str, bool] = {}
    longest: dict[str, int] = {}  # of a term without its last letter
    for (term, _), pos in found.items():
        longest[term[:-1]] = max(longest.get(term[:-1], 0), pos)
    for (term, stem), pos in sorted(found.items(), key=lambda x: (len(x[0][0]), not x[0][1], x[0][0])):
        longer = longest.get(term, 0) if stem else 0
        same = found.get((term, False), 0) if stem else 0
        if any(kept.get(term[:n]) for n in STEMS if n < len(term) or n == len(term) and not stem):
            continue
        if stem and max(longer, same) >= 0.9 * pos:
            continue
        kept[term] = stem
    return dict(sorted(kept.items()))


def _places(rows: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """(term, stem, pos, docs): in how many different surroundings each term stands, and in how many that no harmless document has."""
    shared = rows.sparkSession.sparkContext.broadcast(({t for t, stem in terms if not stem}, {t for t, stem in terms if stem}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, begun = shared.value
        sizes = sorted({len(t) for t in begun})
        for batch in batches:
            found = set()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = _WORDS.findall((text.as_py() or b"").decode().lower())
                for i, word in enumerate(words):
                    own = [(word, False)] if word in whole else []
                    own += [(word[:n], True) for n in sizes if len(word) > n and word[:n] in begun]
                    if own:
                        place = xxhash.xxh64_intdigest(" ".join(words[max(0, i - 1) : i] + ["|"] + words[i + 1 : i + 2])) >> 1
                        found.update((term, stem, place, label) for term, stem in own)
            if found:
                columns = zip(zip(*found), (pa.string(), pa.bool_(), pa.int64(), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["term", "stem", "place", "toxic"])

    places = rows.select(utf8("text").alias("t"), "toxic").mapInArrow(run, "term string, stem boolean, place long, toxic int")
    places = places.groupBy("term", "stem", "place").agg(F.min("toxic").alias("toxic"))
    return places.groupBy("term", "stem").agg(F.sum("toxic").alias("pos"), F.count("*").alias("docs"))


def learn_reporting(rows: DataFrame, terms: dict[str, bool]) -> frozenset:
    """Words that stand around terms in harmless documents far more often than in toxic ones, beyond chance; copies count once."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(Automaton(shared.value))
        for batch in batches:
            found = set()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = [p for p in _PARTS.findall((text.as_py() or b"").decode().lower()) if p[0].isalnum()]
                hits = [i for i, w in enumerate(words) if kinds[w]]
                for i in hits:
                    around = words[max(0, i - REACH) : i + REACH + 1]
                    place = xxhash.xxh64_intdigest(" ".join(around)) >> 1
                    found.update((w, place, label) for w in {"", *around} if not kinds[w])  # the empty word counts places
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int32()))], ["word", "place", "toxic"])

    near = rows.select(utf8("text").alias("t"), "toxic").mapInArrow(run, "word string, place long, toxic int")
    near = near.groupBy("word", "place").agg(F.max("toxic").alias("toxic")).groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("neg"), F.count("*").alias("docs")).where(F.col("neg") >= MIN_TOXIC_DOCS)
    near = materialise(near, "contexts")
    whole = near.where("word = ''").first()
    if not whole or whole.neg == whole.docs:
        return frozenset()
    odds = F.log((F.col("neg") + 0.5) / (whole.neg + 1)) - F.log((F.col("docs") - F.col("neg") + 0.5) / (whole.docs - whole.neg + 1))
    chance = F.col("docs") * F.lit(whole.neg / whole.docs)
    surprise = F.col("neg") * F.log(F.col("neg") / chance) - F.col("neg") + chance
    sure = F.log(F.lit(float(max(1, near.count())))) + SURE
    found = near.where((odds >= REPORTING_LOG_ODDS) & (surprise >= sure) & (F.length("word") >= 3)).select("word").collect()  # the model
    return frozenset(r.word for r in found)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, each halved until the loss falls, drawn towards PRIOR."""
    x, w = np.hstack([np.ones((len(x), 1)), x]), PRIOR.copy()

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.25 * ((w - PRIOR) ** 2).sum()

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (p - y) + 0.5 * (w - PRIOR))
        while np.abs(step).max() > 1e-8 and loss(w - step) > now:
            step /= 2
        w, before = w - step, now
        now = loss(w)
        if before - now < 1e-9:
            break
    return w


def _with_features(rows: DataFrame, terms: dict[str, bool], reporting: frozenset, last: str, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, last) and the features, or the score where there are weights."""
    shared = rows.sparkSession.sparkContext.broadcast((terms, reporting, weights))  # the model: what was learned beyond chance
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, reporting, weights = shared.value
        kinds = Kinds(Automaton(terms))
        for batch in batches:
            x = np.array([features((t.as_py() or b"").decode(), kinds, reporting) for t in batch.column(1)]).reshape(-1, len(PRIOR) - 1)
            if weights is None:
                out = pa.array(x.tolist(), pa.list_(pa.float64()))
            else:
                out = pa.array(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), out, batch.column(2)], ["doc_id", "out", last])

    kind = "array<double>" if weights is None else "double"
    last_type = rows.schema[last].dataType.simpleString()
    return rows.select("doc_id", utf8("text").alias("t"), last).mapInArrow(run, f"doc_id {id_type}, out {kind}, {last} {last_type}")


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled documents that are not held out. Several labels of a document count as toxic if one is.

    Terms are counted over all of them; contexts and weights are fitted on about `fit_rows`.
    """
    rows, count = _labelled(docs, labels)
    terms = learn_terms(rows)
    share = int(1_000_000 * min(1.0, fit_rows / max(1, count)))
    some = materialise(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share), "labelled")
    reporting = learn_reporting(some, terms)
    found = _with_features(some, terms, reporting, "toxic", None).select("out", "toxic").collect()
    release(some)
    if not found:
        return Model(terms, reporting, PRIOR)
    return Model(terms, reporting, fit(np.array([r.out for r in found]), np.array([float(r.toxic) for r in found])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    A null, empty or wordless text has no hits and gets the score of such a text. Repeated rows get equal scores; a null
    doc_id is never held out. Where no label may be learned from, the weights are PRIOR. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    out = _with_features(rows, model.terms, model.reporting, "held_out", model.weights).withColumnRenamed("out", "score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score() reaches threshold; all columns are returned and nothing is shuffled.

    A null, empty or wordless text has no hits and is judged as such a text is; repeated rows are judged alike; column names
    don't matter; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, reporting, weights = Kinds(Automaton(shared.value.terms)), shared.value.reporting, shared.value.weights
        for batch in batches:
            x = np.array([features(t.as_py() or "", kinds, reporting) for t in batch.column(place)]).reshape(-1, len(PRIOR) - 1)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
