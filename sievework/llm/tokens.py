"""Token counts without making tokens (operator 3).

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at a character, and one pass over the positions
carries the number of pieces on the path there, so that a text's count needs no tokens.

Counter is for unigram vocabularies: the pass is Viterbi's, with the best score. Ties are broken as the tokenizer breaks them:
the piece that starts first, which is the longest, stays.

MergeCounter is for vocabularies of merges (byte-pair encoding), whose ranks are no scores that add up: the best path of a sum
isn't what such a tokenizer gives. Its path is the one on which no two neighbours would have been merged otherwise: of the
pieces that end at a position exactly one goes with the last piece of the path to its start, and whether two pieces go
together is decided by the order of merges, once a pair.

Pieces don't cross spaces (but for pieces of spaces alone), so a word's count is worked out once as long as a task's memo lasts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import utf8

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in the order of its ids, without those that no text is made of."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter(dict):
    """Maps a split (with its leading mark) to its number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.scores = dict(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in self.scores for b in range(256))

    def __missing__(self, split: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[split] = self.count(split)
        return found

    def _run(self, split: str, start: int, end: int) -> int:
        """Tokens of a run of unknown characters, which the tokenizer joins: itself if it is a piece, else its bytes."""
        run = split[start:end]
        return 1 if run in self.scores or not self.bytes else len(run.encode())

    def count(self, split: str) -> int:
        size = len(split)
        score, tokens, run = [0.0] * (size + 1), [0] * (size + 1), [-1] * (size + 1)  # run: where a path's open unknown run starts
        ends: list[list] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(split):
            ends[end].append(match)
        for end in range(size):
            best, single = None, False
            for length, own in sorted(ends[end], reverse=True):
                start = end + 1 - length
                single |= length == 1
                total = own + score[start]
                if best is None or total > best:
                    best = total
                    closed = self._run(split, run[start], start) if run[start] >= 0 else 0
                    tokens[end + 1], run[end + 1] = tokens[start] + closed + 1, -1
            if not single:
                total = self.unknown + score[end]
                if best is None or total > best:
                    best = total
                    tokens[end + 1], run[end + 1] = tokens[end], run[end] if run[end] >= 0 else end
            score[end + 1] = best
        return tokens[size] + (self._run(split, run[size], size) if run[size] >= 0 else 0)

    def text(self, text: str) -> int:
        splits = text.replace(SPACE, " ").split(" ")
        if not splits[0]:
            splits = splits[1:]  # the text starts with a space, or is empty
        return sum(map(self.__getitem__, [SPACE + s for s in splits]))


class MergeCounter(dict):
    """Maps a word (without its leading mark) to (its number of tokens, whether the mark stays a token of its own).

    pieces: with their scores, the highest is merged first, ties from the left. Characters in no piece cost their bytes.
    """

    LONG = 1000  # characters; longer words are worked out each time

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.scores = dict(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece in self.scores:
            if SPACE not in piece[1:]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, int] = {}

    def merged(self, text: str) -> list[str]:
        """The tokenizer's own way: the best pair of neighbours is merged until there is none. Only for short texts."""
        parts, score = list(text), self.scores.get
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                own = score(parts[i] + parts[i + 1])
                if own is not None and own > best:
                    best, at = own, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def together(self, first: str, second: str) -> bool:
        """Whether the two pieces, side by side, are what their text is merged to; first may be empty."""
        if (found := self.pairs.get((first, second))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[first, second] = self.merged(first + second) == ([first] if first else []) + [second]
        return found

    def __missing__(self, word: str) -> tuple[int, bool]:
        if len(self) > 400_000:
            self.clear()
        found = self.count(SPACE + word)
        if len(word) <= self.LONG:
            self[word] = found
        return found

    def count(self, text: str) -> tuple[int, bool]:
        size, known = len(text), self.pairs.get
        last, tokens, bare, done = [""] * (size + 1), [0] * (size + 1), [False] * (size + 1), 0

        def alone(done: int, to: int) -> int:
            """Characters that no piece has, which nothing is merged with."""
            for at in range(done, to):
                last[at + 1], tokens[at + 1], bare[at + 1] = "", tokens[at] + len(text[at].encode()), bare[at]
            return to

        for end, piece in self.automaton.iter(text):  # by end, the longest first
            if done < end:
                done = alone(done, end)
            elif done > end:
                continue
            start = end + 1 - len(piece)
            together = known((last[start], piece))
            if self.together(last[start], piece) if together is None else together:
                done = end + 1
                last[done], tokens[done] = piece, tokens[start] + 1
                bare[done] = bare[start] if start else piece == SPACE
        alone(done, size)
        return tokens[size], bare[size]

    def spaces(self, run: int) -> int:
        """Tokens of a run of marks alone: equal scores, so what lies left is merged first."""
        if run < 2:
            return run
        if (found := self.runs.get(run)) is None:
            sizes = {len(p) for p in self.scores if set(p) == {SPACE}}
            parts = [1] * min(run, 4096)
            while True:
                at = next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in sizes), None)
                if at is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            longest = max(sizes, default=1)
            found = len(parts) if run <= 4096 else len(parts) + (run - 4096) // longest + self.spaces((run - 4096) % longest)
            self.runs[run] = found
        return found

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return sum(self[w][0] for w in words)
        total = empty = 0
        for word in words:
            if not word:
                empty += 1
                continue
            tokens, bare = self[word]
            total += tokens - bare + self.spaces(empty + bare)
            empty = 0
        return total + self.spaces(empty)


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]] | None = None, merges: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_bytes) of every document's whole text; merges: whether the vocabulary is one of merges.

    A null or empty text has no tokens. Repeated rows each come back; a null doc_id stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces() if pieces is None else pieces)  # the vocabulary
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = (MergeCounter if merges else Counter)(shared.value)
        for batch in batches:
            counts, sizes = [], []
            for text in batch.column(1):
                raw = text.as_py() or b""
                counts.append(counter.text(raw.decode()))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens", "n_bytes"])

    return docs.select("doc_id", utf8("text").alias("t")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_bytes long")
