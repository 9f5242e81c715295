"""Secrets in texts: known forms, and runs of high entropy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tables import columns, small_batches

BATCH = 4 << 20
#: The known forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")


class CharClass(NamedTuple):
    """Characters that candidates consist of, the window that slides over them, and the entropy in bits that marks it."""
    kind: str
    run: re.Pattern
    window: int
    bits: float
    needs: tuple[re.Pattern, ...]  # each must be found in a window


DIGIT, LETTER, LOWER, UPPER = (re.compile(p) for p in ("[0-9]", "[A-Za-z]", "[a-z]", "[A-Z]"))
#: Windows of these classes look random: the entropy of random ones is expected at about 3.4, 4.0 and 4.1 bits.
CLASSES = (CharClass("entropy_hex", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![0-9A-Za-z])"), 24, 3.0, (DIGIT, LETTER)),
           CharClass("entropy_alnum", re.compile(r"(?<![0-9A-Za-z])[0-9A-Za-z]{20,}"), 20, 3.6, (DIGIT, LETTER)),
           CharClass("entropy_base64", re.compile(r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{20,}={0,2}"), 20, 3.9, (DIGIT, LOWER, UPPER)))
#: All runs of hexadecimal characters and of the classes lie in such tokens.
TOKEN = re.compile(r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{20,}={0,2}")
#: The allow-list: addresses, UUIDs, digests named as such and data uris; and words that mark a made-up or masked value.
ALLOWED = (re.compile(r"(?:https?|ftp)://\S*"), re.compile(r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"),
           re.compile(r"\b(?:md5|sha-?1|sha-?256|sha-?384|sha-?512|commit|integrity|checksum|digest)[\"']?\x20{0,4}[-:=\x20]\x20{0,4}[\"']?[0-9A-Za-z+/=-]+", re.IGNORECASE | re.ASCII),
           re.compile(r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]*"))
MADE_UP = re.compile(r"example|dummy|placeholder|xxxx|0123456789|abcdefgh", re.IGNORECASE | re.ASCII)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = {k: i for i, k in enumerate(("assign", "access", "hex", *(c.kind for c in CLASSES)))}
Span = tuple[str, int, int]


def windows(text: str, size: int, bits: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of `size` characters whose Shannon entropy is at least `bits`.

    One character comes in and one goes out per step, so only two counts change: with S the sum of c * log2(c) over the
    counts c, the entropy is log2(size) - S / size. S is kept in units of 2 ** -32, so long texts add up no error.
    """
    term = [0] + [round(c * log2(c) * 2 ** 32) for c in range(1, size + 1)]
    most = round((log2(size) - bits) * size * 2 ** 32) + size
    counts: dict[str, int] = {}
    total, found = 0, []
    for i, char in enumerate(text):
        if i >= size:
            gone = text[i - size]
            c = counts[gone]
            counts[gone] = c - 1
            total += term[c - 1] - term[c]
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += term[c + 1] - term[c]
        if i >= size - 1 and total <= most:
            start = i - size + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def known_spans(text: str, tokens: list[re.Match]) -> list[Span]:
    """Spans of the known forms, leftmost and non-overlapping for each kind: assignments of six characters and more, access
    keys of twenty, lower-case hexadecimal runs of twenty-four."""
    spans: list[Span] = []
    low = text.encode().lower()
    if any(k in low for k in KEYWORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return spans + [("hex", *m.span()) for t in tokens for m in HEX.finditer(text, *t.span())]


def random_spans(text: str, tokens: list[re.Match], known: list[Span]) -> list[Span]:
    """Spans of high entropy that are in no known one, nothing allowed, and no other such span."""
    found: list[Span] = []
    for token in tokens:
        if DIGIT.search(text, *token.span()) and LETTER.search(text, *token.span()):
            for c in CLASSES:
                for run in c.run.finditer(text, *token.span()):
                    first = run.start()
                    found += [(c.kind, first + a, first + b) for a, b in windows(run.group(), c.window, c.bits)
                              if all(p.search(text, first + a, first + b) for p in c.needs)]
    if not found:
        return found
    others = sorted([m.span() for p in ALLOWED for m in p.finditer(text)] + [(a, b) for _, a, b in known])
    starts = np.array([0] + [a for a, _ in others])
    ends = np.maximum.accumulate(np.array([0] + [b for _, b in others]))  # how far what starts up to here reaches
    kept, reach = [], 0
    for span in sorted(found, key=lambda s: (s[1], -s[2], KINDS[s[0]])):
        _, start, end = span
        if end > reach and ends[np.searchsorted(starts, start, side="right") - 1] < end and not MADE_UP.search(text, start, end):
            kept.append(span)
            reach = end
    return kept


def spans_of(text: str) -> list[Span]:
    """All spans of a text by start, then kind."""
    tokens = list(TOKEN.finditer(text))
    known = known_spans(text, tokens)
    return sorted(known + random_spans(text, tokens, known), key=lambda s: (s[1], KINDS[s[0]], s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every text of `docs` (doc_id, text): doc_id, spans (array of kind, start, end; code points, end exclusive).

    Known forms always count: see `known_spans`. Besides, windows slide over candidates, runs of characters of one class
    (lower- or upper-case hexadecimal, letters and digits, base64), with their entropy kept by incremental counts;
    windows above the class's bits are joined to spans. Spans without the characters that their class needs, inside a known
    span or inside something allowed (ALLOWED), and those that hold a word of MADE_UP are left out. All are sorted by start, then kind.

    Whole texts are read, in one pass without a shuffle; the work is linear in their length. A null or empty text has no
    spans. Repeated rows and null doc_ids come out as they go in. An empty table gives no rows.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small_batches(frames, "text", BATCH):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in frame.text]
            yield pd.DataFrame({"doc_id": frame.doc_id, "unnamed": frame.unnamed, "spans": found})
    own = columns(docs, doc_id="bigint", text="string").select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce("text", F.lit("")).alias("text"))
    out = own.mapInPandas(run, "doc_id bigint, unnamed boolean, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return out.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "spans")


def digests(found: DataFrame) -> DataFrame:
    """The result of `scan` in counts and lists: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
