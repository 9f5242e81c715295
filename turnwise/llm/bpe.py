"""Byte-level BPE by a depth-first walk of the trie of distinct words."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tables import columns, small_batches

BATCH = 1 << 20
#: A worker remembers up to twice as many words between batches; those not met for long are forgotten first.
REMEMBERED = 150_000
#: Characters of remembered words: very long ones must not fill the memory of a worker.
REMEMBERED_BYTES = 8 << 20
#: Pairs of tokens whose verdict is remembered.
REMEMBERED_PAIRS = 200_000
ID = next(c for c in "IL" if array(c).itemsize == 4)  # four bytes, as wide as an id
NEVER = 1 << 40  # a rank beyond all merges


def byte_letters() -> dict[str, int]:
    """The letter of a byte in the vocabulary file: printable bytes stand for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for text, i in self.specials.items():
            self.bytes_of[i] = text.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.tails = {b[k:]: -1 for b in self.ids for k in range(1, len(b))} | self.ids
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else lambda t: [t]
        self.made: dict[int, tuple[tuple[int, int], int]] = {}
        for (a, b), rank in self.ranks.items():
            self.made.setdefault(self.ids[self.bytes_of[a] + self.bytes_of[b]], ((a, b), rank))
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.stays: dict[int, bool] = {}
        self.held = 0  # characters of the words in `known`

    def beside(self, last: int, token: int) -> bool:
        """Do the two tokens stay as they are when they stand side by side? `last` is -1 at the start of a word.

        While the merges of both run by rank, the piece at the right edge of one meets the piece at the left edge of
        the other. The two tokens are broken up if such a pair of pieces, there at the same time, has a merge of its
        own that comes before the merges its pieces go into (of equal ranks the left merge comes first).
        """
        pair = last << 32 | token
        if (known := self.stays.get(pair)) is not None:
            return known
        known = token in self.made or len(self.bytes_of[token]) == 1
        if last >= 0:
            ranks = self.ranks
            for x, born, gone in self.edge(last, 1):
                for y, begun, ended in self.edge(token, 0):
                    if born <= ended and begun < gone:
                        rank = ranks.get((x, y), NEVER)
                        if rank < gone and rank <= ended and rank < NEVER:
                            known = False
        self.stays[pair] = known
        return known

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Pieces at the left (0) or right (1) edge of a token while it is put together: (piece, rank of the merge
        that makes it, rank of the merge that takes it up)."""
        found = self.edges[side].get(token)
        if found is None:
            found, piece, taken = [], token, NEVER
            while piece is not None:
                parts, born = self.made.get(piece, (None, -1))
                found.append((piece, born, taken))
                piece, taken = (parts[side] if parts else None), born
            self.edges[side][token] = found
        return found

    def last_token(self, path: bytes, ends: list[int], end: int) -> int:
        """The last token of the encoding of the first `end` bytes of a word, given those of all shorter prefixes;
        `path` holds as many of the bytes before `end` as a token can have.

        Exactly one token that ends here stays beside the last token of what precedes it; cutting that token off
        leaves the encoding of the rest, so the last tokens of the prefixes are all there is to remember.
        """
        n, found, tails, stays, skipped = len(path), [], self.tails.get, self.stays.get, end - len(path)
        for start in range(n - 1, -1, -1):
            token = tails(path[start:])
            if token is None:
                break
            if token >= 0:
                found.append((start, token))
        for start, token in reversed(found):
            last = ends[skipped + start]
            known = stays(last << 32 | token)
            if self.beside(last, token) if known is None else known:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def learn(self, words: Iterable[str]) -> None:
        """Encode `words`: put them into a trie and walk it depth first. Last tokens of a shared prefix are computed
        once; a node hands them to what is below it, and a word reads its encoding back from them.

        The trie is kept as the sorted list of its words: each goes on where it leaves the one before it, so going
        through the list is the walk, and `ends` holds the last tokens of all prefixes of the word it stands at.
        """
        ends, path, longest, length = [-1], b"", self.longest, [len(b) for b in self.bytes_of]
        for data, word in sorted((w.encode(), w) for w in words):
            shared = min(len(path), len(data))
            if not data.startswith(path):
                shared = next(i for i, (a, b) in enumerate(zip(path, data)) if a != b)
            del ends[shared + 1:]
            for end in range(shared + 1, len(data) + 1):
                ends.append(self.last_token(data[max(0, end - longest):end], ends, end))
            ids, at = [], len(data)
            while at:
                ids.append(ends[at])
                at -= length[ends[at]]
            self.known[word] = array(ID, ids[::-1]).tobytes()
            path = data

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, four little-endian bytes each. Special tokens in a text are found first."""
        cut = [[(p, None) if p in self.specials else (p, self.split(p)) for p in self.parts(t)] for t in texts]
        if len(self.stays) > REMEMBERED_PAIRS:
            self.stays = {}
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        fresh: set[str] = set()
        for parts in cut:
            for _, words in parts:
                fresh.update(words or ())
        fresh -= self.known.keys()
        again = fresh & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.learn(fresh - again)
        self.held += sum(map(len, fresh))
        known = self.known.__getitem__
        return [b"".join(np.array([self.specials[p]], "<u4").tobytes() if words is None else b"".join(map(known, words))
                         for p, words in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids. Bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One copy for each worker process."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary, four little-endian bytes each) of every text of `docs` (doc_id, text) under the
    tokenizer file `path`, which lies at the same place on every executor. With `decoded` also the text that the ids
    give back, made in the same pass.

    Null and empty texts have no ids. Row by row, without a shuffle; a task holds one batch of texts and a bounded
    memory of words. Rows come out as often as they go in.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for frame in small_batches(frames, "text", BATCH):
            ids = words.encode(frame.text.tolist())
            back = {"decoded": [words.decode(x) for x in ids]} if decoded else {}
            yield pd.DataFrame({"doc_id": frame.doc_id, "ids": ids} | back)
    rows = columns(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.mapInPandas(run, "doc_id bigint, ids binary" + ", decoded string" * decoded)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids as `encode` makes them; null stays null."""
    @F.pandas_udf("string")
    def run(packed: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return packed.map(lambda x: None if x is None else words.decode(x))
    return run(ids)
