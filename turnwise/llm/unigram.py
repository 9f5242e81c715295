"""Token counts under a unigram vocabulary: Viterbi that carries scores and counts only."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tables import columns, small_batches

BATCH = 4 << 20
REMEMBERED = 400_000
MARK = "▁"  # stands for a blank
UNKNOWN_PENALTY = 10.0  # fixed: an unknown letter scores this much below the least piece


def pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, the unknown piece first.

    The public file is ordered by usefulness but has no probabilities, so scores follow Zipf's law by rank.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return [("<unk>", 0.0)] + [(p, -math.log(rank + 2)) for rank, p in enumerate(found)]


class Counter:
    """Counts pieces of words; knows the words it has met."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.found = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            self.found.add_word(piece, (len(piece), score, i == 0))
        self.found.make_automaton()
        self.letters = {p for p, _ in vocabulary[1:] if len(p) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, int]] = {}

    def count(self, word: str) -> tuple[int, int]:
        """(pieces, unknown pieces) on the best path.

        Position e holds the best score of a path to it and the counts on that path. The automaton lists the pieces
        that end at e longest first, and only a strictly better one replaces the best so far, so of equal paths the
        one whose last piece starts first stays. A letter without a piece of its own is an unknown step, tried last;
        unknown steps in a row are one piece.
        """
        if not word:
            return 0, 0
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        number, strange, open_ = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)

        def step_unknown(e: int) -> None:
            s = e - 1
            if word[s] not in self.letters:
                score = self.unknown + best[s]
                if best[e] is None or score > best[e]:
                    new = 0 if open_[s] else 1
                    best[e], number[e], strange[e], open_[e] = score, number[s] + new, strange[s] + new, True
        done = 0
        for last, (length, value, unknown) in self.found.iter(word):
            e = last + 1
            while done < e - 1:  # positions at which no more pieces end
                done += 1
                step_unknown(done)
            s = e - length
            score = value + best[s]
            if best[e] is None or score > best[e]:
                new = 0 if unknown and open_[s] else 1
                best[e], number[e], strange[e], open_[e] = score, number[s] + new, strange[s] + new * unknown, unknown
        while done < n:
            done += 1
            step_unknown(done)
        return number[n], strange[n]

    def words(self, text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        return re.findall(f"{MARK}[^{MARK}]*", marked if marked.startswith(MARK) else MARK + marked) if text else []

    def text(self, text: str) -> tuple[int, int]:
        total = unknown = 0
        for word in self.words(text):
            both = self.known.get(word)
            if both is None:
                both = self.known[word] = self.count(word)
            total, unknown = total + both[0], unknown + both[1]
        if len(self.known) > REMEMBERED:
            self.known = {}
        return total, unknown


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(pieces(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and n_unknown of every text of `docs` (doc_id, text) under the pieces of the file `path`.

    Blanks become marks, a mark is put in front, and every mark starts a word that is cut by itself. Null and empty
    texts have no tokens. Row by row, without a shuffle; a task holds one batch and a bounded memory of words.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = counter(path)
        for frame in small_batches(frames, "text", BATCH):
            both = [known.text(t) for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "n_tokens": [a for a, _ in both], "n_unknown": [b for _, b in both]})
    rows = columns(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.mapInPandas(run, "doc_id bigint, n_tokens bigint, n_unknown bigint")
