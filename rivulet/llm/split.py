"""Splitting texts that are longer than a limit of tokens, at natural boundaries and with an overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.batches import bounded
from rivulet.llm.tokens import NAME, TOKENIZERS, _arrow_type, encode_text, encoder

#: From the coarsest separator to the finest; a cut is made after the match. Below words, cuts are made between characters.
SEPARATORS = (
    re.compile(r"\n(?=#{1,6}\s)|\n\s*\n\s*\n\s*|\n[-=*_]{3,}[ \t]*\n|\f"),  # sections
    re.compile(r"\n[ \t]*\n\s*"),  # paragraphs
    re.compile(r"(?<=[.!?…;])[\"')\]»”]*\s+|\n+|(?<=[。！？])"),  # sentences and lines
    re.compile(r"\s+"),  # words
)
_SENTENCE, _WORD = 2, 3
#: White space beyond ASCII (fixed values).
_WIDE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _seams(text: str) -> np.ndarray:
    """Places between a visible character and a space or line end.

    There the pattern always begins a new pre-token, so what stands on either side is encoded alike alone and within the text.
    """
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    visible = c[:-1] > 32
    if not text.isascii():
        visible &= ~np.isin(c[:-1], _WIDE)
    return np.flatnonzero(visible & ((c[1:] == 32) | (c[1:] == 10))) + 1


class _Measured:
    """A text with the number of tokens up to each of its characters."""

    def __init__(self, text: str, ids: list[int], lengths: np.ndarray):
        self.text, self.n = text, len(ids)
        starts = np.concatenate([[0], np.cumsum(lengths[np.asarray(ids)])])
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            at = np.arange(len(text) + 1)
        else:
            at = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
        #: tokens that begin before the character, and the token that the character begins in
        self.up = np.searchsorted(starts[:-1], at, "left")
        self.down = np.minimum(np.searchsorted(starts, at, "right") - 1, self.n)
        self._cuts: dict[int, np.ndarray] = {}
        self._seams: np.ndarray | None = None

    def count(self, lo: int, hi: int) -> int:
        """Tokens of the whole text that touch [lo, hi)."""
        return int(self.up[hi] - self.down[lo])

    def exact(self, lo: int, hi: int, enc) -> int:
        """The tokens of [lo, hi) encoded by itself: those between its first and last seam, and its ends encoded anew."""
        if self._seams is None:
            self._seams = _seams(self.text)
        c = self._seams
        i, j = np.searchsorted(c, lo, "left"), np.searchsorted(c, hi, "right") - 1
        if i >= j:
            return len(enc.encode_ordinary(self.text[lo:hi]))
        a, b = int(c[i]), int(c[j])
        ends = len(enc.encode_ordinary(self.text[lo:a])) + len(enc.encode_ordinary(self.text[b:hi]))
        return ends + int(self.up[b] - self.up[a])

    def cuts(self, level: int) -> np.ndarray:
        if level not in self._cuts:
            self._cuts[level] = np.fromiter((m.end() for m in SEPARATORS[level].finditer(self.text)), np.int64)
        return self._cuts[level]

    def between(self, level: int, lo: int, hi: int) -> np.ndarray:
        c = self.cuts(level)
        return c[np.searchsorted(c, lo, "right") : np.searchsorted(c, hi, "left")]

    def reach(self, lo: int, most: int) -> int:
        """The farthest character so that [lo, it) has at most that many tokens; beyond lo in any case."""
        return max(lo + 1, min(int(np.searchsorted(self.up, self.down[lo] + most, "right")) - 1, len(self.text)))

    def back(self, end: int, wanted: int, slack: int) -> int:
        """Where the piece after one that ends at end begins: about wanted tokens before, at a sentence, a word or a character."""
        goal = self.up[end] - wanted
        for level, within in ((_SENTENCE, slack), (_WORD, slack // 2)):
            lo = int(np.searchsorted(self.down, goal - within, "left"))
            hi = int(np.searchsorted(self.down, goal + within, "right"))
            c = self.between(level, lo - 1, min(hi, end))
            if len(c):
                return int(c[np.abs(self.down[c] - goal).argmin()])
        return min(int(np.searchsorted(self.down, goal, "left")), end)


def _units(m: _Measured, lo: int, hi: int, level: int, most: int) -> Iterator[tuple[int, int]]:
    if m.count(lo, hi) <= most:
        yield lo, hi
    elif level == len(SEPARATORS):
        while lo < hi:
            end = min(hi, m.reach(lo, most))
            yield lo, end
            lo = end
    else:
        edges = [lo, *m.between(level, lo, hi).tolist(), hi]
        for a, b in zip(edges, edges[1:], strict=False):
            yield from _units(m, a, b, level + 1, most)


def split_text(text: str, enc, lengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]] | None:
    """(start, end, tokens) of each piece of a text of more than limit tokens; None if it has no more than that.

    The text is cut by the coarsest separator, and parts that are still too long by the next; neighbouring parts are then
    packed up to the limit. The tokens of every piece are counted as encoded by itself. The pieces cover the whole text.
    """
    ids = encode_text(enc, text)
    if len(ids) <= limit:
        return None
    m = _Measured(text, ids, lengths)
    slack = overlap // 4
    units = list(_units(m, 0, len(text), 0, limit - overlap - slack))
    units.reverse()  # the next one is at the end
    pieces: list[tuple[int, int, int]] = []
    start = 0
    while units:
        if m.count(start, units[-1][1]) > limit:
            start = units[-1][0]
        taken = [units.pop()]
        while units and m.count(start, units[-1][1]) <= limit:
            taken.append(units.pop())
        while True:
            end = taken[-1][1]
            n = m.exact(start, end, enc)
            if n <= limit:
                break
            # cut off by itself, the edge of the piece can take a few tokens more than within the text
            if len(taken) > 1:
                units.append(taken.pop())
            elif start < taken[0][0]:
                start = taken[0][0]
            else:
                lo, hi = taken[0]
                taken, half = [(lo, (lo + hi) // 2)], ((lo + hi) // 2, hi)
                units.append(half)
        pieces.append((start, end, n))
        if units:
            start = max(m.back(end, overlap, slack), start + 1)
    return pieces


def split(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    overlap: int = 64,
    with_text: bool = True,
    folder: str = TOKENIZERS,
    name: str = NAME,
) -> DataFrame:
    """(id, piece, start, end, n_tokens[, text]): the pieces of every text longer than limit tokens.

    start and end count characters; consecutive pieces share about overlap tokens, from a sentence or else a word on.
    Texts of up to limit tokens, null and empty texts give no rows. Equal rows give equal pieces. A text has no more
    tokens than bytes, so shorter ones never leave the scan.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("overlap must be less than half of limit")
    fields = [("_id", df.schema[id_col].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("n_tokens", T.IntegerType())]
    arrow = [("_id", _arrow_type(df, id_col)), ("piece", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int32())]
    if with_text:
        fields, arrow = [*fields, ("text", T.StringType())], [*arrow, ("text", pa.string())]
    schema = pa.schema(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(folder, name)
        for b in bounded(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (lo, hi, n) in enumerate(split_text(t, enc, lengths, limit, overlap) or ()):
                    rows.append((i, k, lo, hi, n, t[lo:hi])[: len(schema)])
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return (
        df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
        .where(F.octet_length("_text") > limit)
        .mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))
        .withColumnRenamed("_id", id_col)
    )
