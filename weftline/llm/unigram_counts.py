"""Token counts under a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character of a pre-token;
dynamic programming carries, for each character, only the best score and the number of pieces on the
best path, never the path itself.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the mark that stands for a space and begins each pre-token.
SPACE = "▁"
#: Fixed value: an unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Pre-tokens whose count a worker remembers; when full, it starts afresh.
REMEMBERED = 400_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece model file (no unknown, control or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.vocab_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter(dict):
    """Number of pieces of each pre-token, worked out when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.empty = not pieces

    def __missing__(self, word: str) -> int:
        n = self.count(SPACE + word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, word: str) -> int:
        """Pieces on the best path; of equal scores the longest last piece wins, and runs of unknown
        characters are one piece."""
        n = len(word)
        score, count, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        known = 0  # characters settled so far
        unknown = self.unknown

        def settle(end: int, single: bool, best, pieces: int) -> None:
            # best is None or the best score of a path into end by a known piece
            if not single:
                s = score[end - 1] + unknown
                if best is None or s > best:
                    score[end], count[end], fused[end] = s, count[end - 1] + (not fused[end - 1]), True
                    return
            score[end], count[end] = best, pieces

        best, pieces, single = None, 0, False
        for last, (length, own) in () if self.empty else self.automaton.iter(word):
            while known < last:
                known += 1
                settle(known, single, best, pieces)
                best, single = None, False
            start = last + 1 - length
            s = score[start] + own
            if best is None or s > best:
                best, pieces = s, count[start] + 1
            if length == 1:
                single = True
        while known < n:
            known += 1
            settle(known, single, best, pieces)
            best, single = None, False
        return count[n]


_counters: dict[int, Counter] = {}


def count_text(text: str | None, counter: Counter) -> int:
    """Spaces become the mark, a mark is put in front, and each mark begins a pre-token."""
    if not text:
        return 0
    words = text.replace(SPACE, " ").split(" ")
    if not words[0]:
        del words[0]
    return sum(map(counter.__getitem__, words))


def _run(shared):
    def run(batches):
        pieces = shared.value
        counter = _counters.get(hash(tuple(pieces)))
        if counter is None:
            counter = _counters[hash(tuple(pieces))] = Counter(pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts = [count_text(t, counter) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64())})

    return run


def token_counts(documents: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``documents``.

    The vocabulary is broadcast (its size is fixed).  Null and empty texts count 0; texts are counted
    whole, whatever their length; repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(list(pieces))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(shared), "doc_id long, n_tokens long")
