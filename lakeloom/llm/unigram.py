"""Token counts of a unigram tokenizer without its ids: a Viterbi pass that carries best score and piece count only.

A text is cut as the tokenizers library's Metaspace step does it: every space becomes the mark U+2581, one mark is put
before the text if it doesn't begin with one, and a new word begins at each mark. Words don't interact, so each distinct
word is counted once for each worker. Within a word an Aho-Corasick automaton over the vocabulary enumerates all pieces
that end at each position; dynamic programming keeps, for each position, the best score, the count of pieces, and
whether the last piece is unknown. Tie rules are those of that library: a later start replaces an earlier one at the
same end only with a strictly higher score (so the longest piece wins a tie); a character that isn't itself a piece can
be an unknown piece at the least score of the vocabulary less ten, tried after the pieces of its start; successive unknown pieces
are one token.

Defined results: a null or empty text has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept in a worker's memory with their counts; beyond it the table starts anew (speed only).
MEMO_WORDS = 400_000
#: Longer words are counted each time they come, so that what is kept is bounded in bytes: in texts without spaces a word is a text.
MEMO_CHARS = 64
_WORD = regex.compile(f"{MARK}[^{MARK}]*|[^{MARK}]+")


class UnigramCounter:
    """pieces: (piece, score), of which the first of equal pieces counts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        self.single = {}
        for piece, score in pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single[piece] = score
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton.make_automaton()
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, best score) of one word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, (size, score) in self.automaton.iter(word):
                ends[end].append((size, score))
        best, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(n):
            found, top = False, 0.0
            last = e + 1
            unknown = word[e] not in self.single
            # in order of start: the longest piece first, then the unknown piece of the last character
            for size, score in sorted(ends[e], reverse=True):
                s = score + best[last - size]
                if not found or s > top:
                    found, top, at, is_unknown = True, s, last - size, False
            if unknown:
                s = self.unknown + best[e]
                if not found or s > top:
                    found, top, at, is_unknown = True, s, e, True
            best[last], open_[last] = top, is_unknown
            count[last] = count[at] + (0 if is_unknown and open_[at] else 1)
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a text."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        tokens, total, memo = 0, 0.0, self.memo
        for w in _WORD.findall(marked):
            got = memo.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= MEMO_CHARS:
                    memo[w] = got
            tokens += got[0]
            total += got[1]
        return tokens, total


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, but for its control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


_LOADED: dict[str, UnigramCounter] = {}


def loaded(path: str) -> UnigramCounter:
    if path not in _LOADED:
        _LOADED[path] = UnigramCounter(sentencepiece_pieces(path))
    return _LOADED[path]


def count(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, score) of each row; rows are independent and nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            tokens, scores = [], []
            for t in batch.column(1):
                if len(counter.memo) > MEMO_WORDS:
                    counter.memo.clear()
                n, s = counter.text(t.as_py())
                tokens.append(n)
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], ["key", "n_tokens", "score"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, score double").withColumnRenamed("key", key)
