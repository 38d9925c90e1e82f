"""Language identification with interpolated Kneser-Ney character models (operator 1).

One model per language over the characters of padded words, orders 1 to ORDER. All models share sorted arrays of n-gram
hashes; a row beside a hash has every language's log probability of that n-gram, and for contexts their back-off weights,
so that one binary search serves all languages. A word is scored once as long as a task's memo lasts; a document takes the
language with the lowest cross-entropy a character.

Spark counts the n-grams of the highest order over all documents that may be learned from; the other orders follow from
those, as every shorter n-gram ends one of them. What comes to the driver is a row for each distinct one, the model itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import held_out, mix, starts, utf8

ORDER, PAD = 4, " "
ASIDE, ASIDE_CHARS = 150, 4000  # documents of each language that calibrate instead of being counted, about, and characters of each at most
UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
POWERS = [np.uint64(pow(0x100000001B3, n, 1 << 64)) for n in range(ORDER)]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the n-gram ending at every predicted character of the padded words; characters per word."""
    joined = "".join(PAD * (ORDER - 1) + w + PAD for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    at = np.arange(sizes.sum()) + np.repeat((np.arange(len(words)) + 1) * (ORDER - 1), sizes)
    out, total = [], np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        total = total + np.concatenate([np.zeros(n, np.uint64), codes[: len(codes) - n]]) * POWERS[n]
        out.append(mix(total[at] ^ np.uint64(n + 1) << np.uint64(56)))
    return out, sizes


def contexts(words: list[str]) -> list[np.ndarray]:
    """For each order above 1 the hash of the characters before every predicted one."""
    joined = "".join(PAD * (ORDER - 1) + w + PAD for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    at = np.arange(sizes.sum()) + np.repeat((np.arange(len(words)) + 1) * (ORDER - 1), sizes)
    out, total = [], np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER):
        total = total + np.concatenate([np.zeros(n, np.uint64), codes[: len(codes) - n]]) * POWERS[n]
        out.append(mix(total[at] ^ np.uint64(n + 101) << np.uint64(56)))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and which of them really hold what is wanted."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order, sorted
    logs: list[np.ndarray] = field(default_factory=list)  # log probabilities: a row a key, a column a language
    context_keys: list[np.ndarray] = field(default_factory=list)  # by order from 2
    weights: list[np.ndarray] = field(default_factory=list)  # log back-off weights
    floor: np.ndarray | None = None  # log probability of a character never seen
    calibration: tuple[float, float] = (0.0, 1.0)  # of the margin
    worst: np.ndarray | None = None  # each language's highest cross-entropy that counts as its own

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities: a row a word, a column a language; characters a word)."""
        by_order, sizes = grams(words)
        before = contexts(words)
        out = np.zeros((len(by_order[0]), len(self.languages)), np.float32)
        todo = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            at, hit = find(self.keys[n - 1], by_order[n - 1][todo])
            out[todo[hit]] += self.logs[n - 1][at[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                at, hit = find(self.context_keys[n - 2], before[n - 2][todo])
                out[todo[hit]] += self.weights[n - 2][at[hit]]
        out[todo] += self.floor
        return np.add.reduceat(out, starts(sizes), axis=0, dtype=np.float64), sizes


def suffixes(codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What grams() and contexts() give, for n-grams of the highest order as rows of characters' codes."""
    by_order, before, total = [], [], np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        total = total + codes[:, ORDER - 1 - n] * POWERS[n]
        by_order.append(mix(total ^ np.uint64(n + 1) << np.uint64(56)))
    total = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER):
        total = total + codes[:, ORDER - 1 - n] * POWERS[n]
        before.append(mix(total ^ np.uint64(n + 101) << np.uint64(56)))
    return by_order, before


def train(grams_of: dict[str, dict[str, int]]) -> Models:
    """Interpolated Kneser-Ney: raw counts at the highest order, counts of distinct left neighbours below, one discount an order.

    grams_of: of each language how often each n-gram of ORDER characters comes in its padded words.
    """
    models = Models(sorted(grams_of))
    counted = []
    for language in models.languages:
        own = grams_of[language] or {PAD * ORDER: 1}
        codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, ORDER) + np.uint64(1)
        counted.append((*suffixes(codes), np.fromiter(own.values(), np.float64, len(own))))
    below = below_keys = None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([c[0][n - 1] for c in counted]))
        context_keys = np.unique(np.concatenate([c[1][n - 2] for c in counted])) if n > 1 else np.zeros(1, np.uint64)
        logs, weights = np.zeros((len(keys), len(counted))), np.zeros((len(context_keys), len(counted)))
        # of every key: its context and its shorter gram (the same in every language)
        context_of, shorter = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for by_order, before, _ in counted:
            at = np.searchsorted(keys, by_order[n - 1])
            if n > 1:
                context_of[at] = np.searchsorted(context_keys, before[n - 2])
                shorter[at] = np.searchsorted(below_keys, by_order[n - 2])
        for k, (by_order, _, times) in enumerate(counted):
            if n == ORDER:
                count = np.bincount(np.searchsorted(keys, by_order[n - 1]), times, len(keys))
            else:
                pairs = np.unique(np.stack([by_order[n], by_order[n - 1]], 1), axis=0)  # a left neighbour makes a longer gram
                count = np.bincount(np.searchsorted(keys, pairs[:, 1]), minlength=len(keys)).astype(float)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            total = np.bincount(context_of, count, len(context_keys))
            kinds = np.bincount(context_of, count > 0, len(context_keys))
            seen = total > 0
            back = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
            lower = np.exp(below[shorter, k]) if n > 1 else np.full(len(keys), 1.0 / (len(keys) + 1))
            own = np.where(seen[context_of], np.maximum(count - discount, 0) / np.maximum(total[context_of], 1), 0)
            logs[:, k] = np.log(own + back[context_of] * lower)
            weights[:, k] = np.log(back)
        if n == 1:
            models.floor = (weights[0] - np.log(len(keys) + 1)).astype(np.float32)
        else:
            models.context_keys.append(context_keys)
            models.weights.append(weights.astype(np.float32))
        models.keys.append(keys)
        models.logs.append(logs.astype(np.float32))
        below, below_keys = logs, keys
    return models


class Scorer:
    """Cross-entropies of texts, with a memo of words."""

    def __init__(self, models: Models):
        self.models, self.memo = models, {}
        self.table, self.sizes = np.zeros((0, len(models.languages))), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities a language, characters) of each text."""
        if len(self.memo) > 300_000:
            self.__init__(self.models)
        parts = [words_of(t) for t in texts]
        new = list({w for p in parts for w in p if w not in self.memo})
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
            logs, sizes = self.models.score(new)
            self.table, self.sizes = np.concatenate([self.table, logs]), np.concatenate([self.sizes, sizes])
        logs, chars = np.zeros((len(parts), len(self.models.languages))), np.zeros(len(parts), np.int64)
        for k, words in enumerate(parts):
            if words:
                rows = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
                logs[k], chars[k] = self.table[rows].sum(axis=0), self.sizes[rows].sum()
        return logs, chars


def judge(models: Models, logs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language's place, score, rejected): the score is the calibrated chance that the language is right."""
    entropy = -logs / np.maximum(chars, 1)[:, None]
    best = entropy.argmin(axis=1)
    if entropy.shape[1] > 1:
        two = np.partition(entropy, 1, axis=1)
        margin = (two[:, 1] - two[:, 0]) * np.sqrt(np.minimum(chars, 400))
    else:
        margin = np.full(len(best), 10.0)
    a, b = models.calibration
    score = 1 / (1 + np.exp(-np.clip(a + b * margin, -30, 30)))
    rejected = entropy[np.arange(len(best)), best] > models.worst[best] + 3 / np.sqrt(np.maximum(chars, 1))
    return best, score, rejected | (score < 0.5)


def calibrate(models: Models, texts: dict[str, list[str]]) -> Models:
    """A logistic curve of the margin, fitted to texts kept aside and to short pieces of them; and each language's worst entropy."""
    scorer, models.worst = Scorer(models), np.full(len(models.languages), 25.0)
    x, y = [], []
    for k, language in enumerate(models.languages):
        whole = [t for t in texts.get(language, []) if words_of(t)]
        pieces = whole + [t[i : i + n] for n in (8, 25, 80) for t in whole for i in [len(t) // 3] if words_of(t[i : i + n])]
        if not whole:
            continue
        logs, chars = scorer(pieces)
        own = -logs[: len(whole), k] / chars[: len(whole)]
        models.worst[k] = np.quantile(own, 0.99) + 3 * own.std() + 0.2
        models.calibration = (0.0, 1.0)
        best, score, _ = judge(models, logs, chars)
        x.append(np.log(score) - np.log1p(-np.minimum(score, 1 - 1e-12)))
        y.append(best == k)
    if x:
        x, y, w = np.concatenate(x), np.concatenate(y).astype(float), np.array([0.0, 1.0])
        z = np.stack([np.ones(len(x)), x], 1)
        for _ in range(30):  # drawn towards (0, 1)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2), z.T @ (p - y) + (w - [0.0, 1.0]))
            w = w - np.clip(step, -1, 1)
        models.calibration = (float(w[0]), float(max(w[1], 0.01)))
    return models


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, times) of the n-grams of ORDER characters in the padded words of (lang, t: text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for language, words in held.items():
                found: Counter = Counter()
                for word, times in words.items():
                    padded = PAD * (ORDER - 1) + word + PAD
                    for i in range(len(word) + 1):
                        found[padded[i : i + ORDER]] += times
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "times"])
            held.clear()

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(language, Counter()).update(words_of(text.as_py().decode()))
            if sum(map(len, held.values())) > 300_000:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "lang string, gram string, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def learn(docs: DataFrame, aside: int = ASIDE) -> Models | None:
    """Models of the languages in `lang`: n-grams of all documents that are not held out but some `aside`, which calibrate.

    Those, about `aside` a language and a tenth of it at most, are chosen by a hash, and so is the place of the ASIDE_CHARS
    characters that calibrate.
    """
    rows = docs.where("lang is not null and text is not null").where(F.coalesce(~held_out(), F.lit(True)))
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(1_000_000 * min(0.1, aside / r["count"])))))
    draw = F.xxhash64(F.lit(1), "doc_id", "text")
    kept = F.pmod(draw, F.lit(1_000_000)) < share[F.col("lang")]
    fitted: dict[str, dict[str, int]] = {r["lang"]: {} for r in counts}
    found = count_grams(rows.where(~kept).select("lang", utf8("text").alias("t"))).toArrow()  # a row a distinct n-gram
    for language, gram, times in zip(*(found.column(i).to_pylist() for i in range(3))):
        fitted[language][gram] = times
    start = F.pmod(F.shiftrightunsigned(draw, 20), F.greatest(F.lit(1), F.length("text") - ASIDE_CHARS + 1)).cast("int") + 1
    own: dict[str, list[str]] = {}
    for r in sorted(rows.where(kept).select("lang", F.substr("text", start, F.lit(ASIDE_CHARS)).alias("text")).collect(), key=lambda r: r.text):
        own.setdefault(r.lang, []).append(r.text)
    return calibrate(train({k: dict(sorted(v.items())) for k, v in fitted.items()}), own)


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, entropy) of every document, from its whole text.

    A text that is null or has no letter is `und` with score 0. rejected: the text is unlike its best language, or the
    choice is as likely wrong as right; lang_pred still names that language. Without models all are `und`. Repeated rows
    get equal results; a null doc_id is not held out. Other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a row a distinct n-gram, which alphabets bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        scorer = Scorer(models) if models else None
        for batch in batches:
            count = batch.num_rows
            names, scores, rejected, entropies = [UNKNOWN] * count, np.zeros(count), np.ones(count, bool), np.zeros(count)
            for at in range(0, count if scorer else 0, 512):
                logs, chars = scorer([(t.as_py() or b"").decode() for t in batch.column(2)[at : at + 512]])
                best, score, reject = judge(models, logs, chars)
                for k in np.flatnonzero(chars):
                    names[at + k], scores[at + k], rejected[at + k] = models.languages[best[k]], score[k], reject[k]
                    entropies[at + k] = -logs[k, best[k]] / chars[k]
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected), pa.array(entropies)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected", "entropy"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), utf8("text").alias("t"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, rejected boolean, entropy double")
