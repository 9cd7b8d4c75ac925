"""Packing by power-of-two decomposition.

A document of n tokens becomes ``n // limit`` pieces of the limit and one piece for each bit of the remainder, largest
first. Every piece is a sequence of its own, its length is a power of two, and sequences of one length share a bucket,
so a batch needs no padding and no sequence crosses documents. Texts are tokenized in one pass without a shuffle; the
pieces are written to the shared folder and sorted into their buckets, and a sequence's id is its place in that order, so
it depends on the documents alone and not on how they were dealt.

Tokens come from the given ``tokenizers`` file. Its byte-level pre-tokenizer always cuts before a single space that is
followed by another character, and between a letter or digit and a punctuation mark; so the ids of words are remembered
and joined, and only new words go through the model. Texts that hold one of the file's added tokens are encoded as a whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut

LIMIT, END = 2048, 1
_CUTS = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)")
_SPACES = re.compile(r" \s| \Z")
_MARKS = re.compile(r"(.*[^\W_])([.,;:!?#$%&*|]+)\Z", re.S)


def _letters() -> dict[int, int]:
    """Byte-level names: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


class Encoder(dict):
    """Ids of words, each with a space before it, as little-endian 32-bit bytes; at most ``most`` are remembered."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.most, self.tokenizer = most, Tokenizer.from_file(path)  # the parts below belong to it
        self.cut, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.tokenize, self.letters, self.bare = self.model.tokenize, _letters(), {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        probe = "\u00e9\u03a9\u4e2d\U00010400a"
        self.plain = self.cut.pre_tokenize_str(f" {probe}") == [(self.name(f" {probe}"), (0, len(probe) + 1))]

    def name(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def piece(self, piece: str) -> bytes:
        """Ids of a piece that begins and ends at cuts."""
        if self.plain and (piece.isalpha() or piece[:1] == " " and piece[1:].isalpha()):  # one part
            parts = [self.name(piece)]
        else:
            parts = [part for part, _ in self.cut.pre_tokenize_str(piece)]
        return array("I", [token.id for part in parts for token in self.tokenize(part)]).tobytes()

    def again(self, piece: str) -> bytes:
        """As ``piece``, remembered: for marks and the first words of lines."""
        value = self.bare.get(piece)
        if value is None:
            if len(self.bare) >= self.most // 5:
                self.bare.clear()
            value = self.bare[piece] = self.piece(piece)
        return value

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if self.plain and word.isalpha():  # most new words: one part, whose ASCII letters stand for themselves
            part = "\u0120" + word if word.isascii() else self.name(" " + word)
            value = array("I", [token.id for token in self.tokenize(part)]).tobytes()
        elif not word[-1:].isalnum() and (marks := _MARKS.match(word)):
            value = self[marks[1]] + self.again(marks[2])
        elif "\n" in word and (lines := word.split("\n")) == word.split():  # single line feeds, no other white space
            value = self[lines[0]] + b"".join(self.again("\n") + self.again(x) for x in lines[1:])
        else:
            value = self.piece(" " + word)
        if len(word) <= 64:
            self[word] = value
        return value

    def ids(self, text: str, special: bool = False) -> bytes:
        if not text:
            return b""
        if special and any(map(text.__contains__, self.added)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _SPACES.search(text):  # runs of white space: cut at single spaces only
            return b"".join(self[p[1:]] if p[:1] == " " and p[1:2].strip() else self.piece(p) for p in _CUTS.split(text))
        first, *rest = text.split(" ")
        return b"".join([self.piece(first) if first else b"", *map(self.__getitem__, rest)])


_ENCODERS: dict[str, Encoder] = {}  # one for each tokenizer file, for all tasks of a worker


def pieces(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; ``limit`` is a power of two."""
    out = [(s, limit) for s in range(0, n - limit + 1, limit)]
    start, rest = n - n % limit, n % limit
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    end_id: int = END,
    with_ids: bool = True,
    special: bool = True,
) -> DataFrame:
    """One row for each piece: ``_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids``.

    A document is the ids of its text (a null text is empty) and then ``end_id``; special tokens written out in a text
    have their own ids, as the tokenizer's ``encode`` gives by default, or are ordinary text without ``special``. Each row of
    ``docs`` is packed by itself, also if its id is null or repeated. ``length`` is the bucket; ``sequence_id`` counts from 0
    over the buckets, shortest first, and within a bucket by id (null first), start and content.
    """
    if limit & (limit - 1):
        raise ValueError("the limit must be a power of two")
    fields = [T.StructField("_id", docs.schema[id_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType(fields)
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        for batch in batches:
            rows: list[tuple] = []
            own: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                row, *others = zip(*rows)
                columns = [batch.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in others)]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = encoder.ids(text or "", special) + end
                view, n = memoryview(raw), len(raw) // 4
                for start, length in pieces(n, limit):
                    part = view[4 * start : 4 * (start + length)]
                    rows.append((i, start, length, zlib.crc32(part), n))
                    if with_ids:
                        own.append(np.frombuffer(part, "<i4"))
                if len(rows) >= 20_000:
                    yield flush()
                    rows, own = [], []
            if rows:
                yield flush()

    return numbered(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(packed, schema))


def numbered(made: DataFrame) -> DataFrame:
    """Pieces in their buckets, each a sequence with its place in the order of all as ``sequence_id``.

    The sort deals ranges of pieces to partitions; a partition's first id is the number of pieces in those before it, of
    which there is one row each.
    """
    placed = cut(made).sort("length", "_id", "start", "ids_crc32", "doc_tokens")
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_from"))
    ahead = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row for each partition of the sort
    starts = F.broadcast(sizes.select("_part", (ahead - F.col("_from")).alias("_shift")))
    out = placed.join(starts, "_part").withColumn("sequence_id", F.col("_nth") + F.col("_shift"))
    return out.drop("_part", "_nth", "_shift").withColumn("offset", F.lit(0).cast("long"))
