"""Encoding and measuring texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.batches import bounded
from rivulet.session import cut

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: The pattern that splits text before the merges of the byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are cut into chunks of so many characters, each read on by the overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 10

_PRE = regex.compile(PATTERN)
_KEPT: dict[str, tuple] = {}


def encoder(folder: str = TOKENIZERS, name: str = NAME):
    """The tiktoken encoding and the byte length of each token, kept for the life of the worker."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _KEPT:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        _KEPT[path] = (tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _KEPT[path]


def decode(ids: list[int], folder: str = TOKENIZERS, name: str = NAME) -> str:
    """The text of ids: the raw bytes of all tokens are joined and read as UTF-8."""
    return encoder(folder, name)[0].decode_bytes(ids).decode("utf-8", errors="replace")


def safe_boundaries(text: str, lo: int, hi: int, whole: bool) -> list[int]:
    """Pre-token boundaries of text in [lo, hi] that follow a visible character.

    After such a boundary the pattern matches as it would from the start of a text, and what stands before it is encoded
    alike with or without what follows. Unless the text is whole its last pre-token may be cut off and gives none.
    """
    ends = [m.end() for m in _PRE.finditer(text)]
    if not whole and ends:
        ends.pop()
    return [e for e in ends if lo <= e <= hi and not text[e - 1].isspace()]


_SEAM = regex.compile(r"(?<=\S)[ \n]")


def stretches(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in stretches of about size characters, each encoded alike by itself and within the text.

    A space or line end behind a visible character always begins a pre-token; cuts are made there.
    """
    at = 0
    while len(text) - at > size:
        seam = _SEAM.search(text, at + size)
        if seam is None:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    return [i for part in stretches(text) for i in enc.encode_ordinary(part)] if len(text) > CHUNK else enc.encode_ordinary(text)


def _table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = TOKENIZERS,
    name: str = NAME,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(id, ids): the token ids of every text, one row for each row of df. Empty and null texts have the empty list.

    Texts of up to chunk characters are encoded where they are read; the chunk size bounds what one task does to a text.
    Longer ones are read in a pass of their own, cut into chunks that overlap, written to the shared folder and spread
    over the cluster: every chunk is split into pre-tokens by itself, neighbours are joined at the first boundary in their
    overlap that both have, and the pieces between these boundaries are encoded and put together in order. Neighbours
    that share no boundary (one run without end) are encoded as one piece. Text that looks like a special token is
    ordinary text. Rows with equal id and text, and rows without an id, each give a row; other columns are ignored.
    """
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and smaller than chunk")
    source = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    id_field, id_arrow = source.schema["_id"], ("_id", _arrow_type(source, "_id"))
    ids_field = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    out_arrow = pa.schema([id_arrow, ("ids", pa.list_(pa.int32()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)[0]
        for b in bounded(batches):
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_arrow[1]), lists], schema=out_arrow)

    is_long = F.coalesce(F.length("_text"), F.lit(0)) > chunk
    short = source.where(~is_long).mapInArrow(whole, T.StructType([id_field, ids_field]))

    row, at = T.StructField("_row", T.LongType()), T.StructField("k", T.IntegerType())
    cut_arrow = pa.schema([id_arrow, ("_row", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = -(-len(t) // chunk)
                for k in range(n):
                    yield _table(cut_arrow, [i], [r], [k], [k == n - 1], [t[k * chunk : (k + 1) * chunk + overlap]])

    cut_type = T.StructType([id_field, row, at, T.StructField("last", T.BooleanType()), T.StructField("part", T.StringType())])
    # the written copy gives every long text its number for good
    chunks = cut(source.where(is_long).select("_id", F.monotonically_increasing_id().alias("_row"), "_text").mapInArrow(slices, cut_type))

    seam_arrow = pa.schema([("_row", pa.int64()), ("k", pa.int32()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64()))])

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, k, last, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ends = safe_boundaries(t, 1, len(t), last)
                rows.append((r, k, [k * chunk + e for e in ends if e <= overlap], [k * chunk + e for e in ends if e >= chunk]))
            yield _table(seam_arrow, *(list(zip(*rows, strict=True)) or [[]] * 4))

    doc = W.partitionBy("_row").orderBy("k")
    seam_type = T.StructType([row, at, *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("heads", "tails")]])
    found = (
        chunks.select("_row", "k", "last", "part").repartition("_row", "k")
        .mapInArrow(seams, seam_type)
        .withColumn("start", F.array_min(F.array_intersect("heads", F.lag("tails").over(doc))))
        .withColumn("start", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("start")).cast("bigint"))
        # chunks without a boundary to the one before them belong to its piece
        .withColumn("piece", F.max(F.when(F.col("start").isNotNull(), F.col("k"))).over(doc))
        .select("_row", "k", "piece", "start")
    )
    first = found.where(F.col("start").isNotNull()).select("_row", "piece", "start", F.lead("start").over(W.partitionBy("_row").orderBy("piece")).alias("stop"))

    piece_arrow = pa.schema([id_arrow, ("_row", pa.int64()), ("piece", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)[0]
        for b in batches:
            rows = []
            for i, r, k, parts, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = "".join([*[p[:chunk] for p in parts[:-1]], parts[-1]])
                rows.append((i, r, k, encode_text(enc, t[start - k * chunk : None if stop is None else stop - k * chunk])))
            yield _table(piece_arrow, *(list(zip(*rows, strict=True)) or [[]] * 4))

    placed = chunks.select("_id", "_row", "k", "part").join(found.select("_row", "k", "piece"), ["_row", "k"]).join(first, ["_row", "piece"])
    together = placed.groupBy("_row", "piece").agg(
        F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"), F.first("start").alias("start"), F.first("stop").alias("stop")
    )
    joined = (
        together.select("_id", "_row", "piece", F.col("p.part").alias("parts"), "start", "stop")
        .mapInArrow(pieces, T.StructType([id_field, row, T.StructField("piece", T.IntegerType()), ids_field]))
        .groupBy("_row")
        .agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
        .select("_id", F.flatten(F.col("p.ids")).alias("ids"))
    )
    return short.unionByName(joined).withColumnRenamed("_id", id_col)


def measure(
    df: DataFrame, id_cols: list[str], text_col: str = "text", folder: str = TOKENIZERS, name: str = NAME
) -> DataFrame:
    """The id columns and n_tokens of every text; null and empty texts have none."""
    fields = [df.schema[c] for c in id_cols]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("n_tokens", T.LongType())])
    arrow = pa.schema([(c, _arrow_type(df, c)) for c in id_cols] + [("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)[0]
        for b in bounded(batches):
            n = [sum(len(enc.encode_ordinary(p)) for p in stretches(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            ids = [c.cast(t.type) for c, t in zip(b.columns[:-1], arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64())], schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{text_col}`").alias("_text")).mapInArrow(count, out)
