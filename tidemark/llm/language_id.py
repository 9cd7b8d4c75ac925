"""Language of documents by rank-order profiles of character n-grams.

A language's profile is the order of its most frequent n-grams (one to three letters of a word with a space at each end)
over all documents to learn from; they are counted in the tasks and added up by Spark. A document has such a list of its own, over
its whole text, and is given to the language from whose profile it is least out of place: the sum, over the document's
n-grams, of how far each one's place is from that in the profile, or ``RANKS`` if it is not there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written

#: Places in a profile, places of a document that are compared, languages compared in one pass over the documents.
RANKS, OWN_RANKS, PASS = 400, 400, 1000
UNKNOWN = "und"
#: Characters that are looked at together, distinct n-grams that a task holds before it hands their counts on.
_SLICE, _HELD = 1_000_000, 1_000_000
_SPACE, _BITS = np.int64(32), np.int64(21)


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and whether it belongs to a word (a letter or a mark on one)."""
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    letter = kinds == ord("L")
    return letter, letter | (kinds == ord("M"))


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct n-grams of a text as numbers of their code points, ascending, and their counts; None if it has no letter."""
    letter, inside = _letters()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, counts, any_letter = [], [], False
    for start in range(0, len(points), _SLICE):
        # an n-gram counts at its middle (a pair at its end), so a slice needs one more character on each side
        own = points[max(start - 1, 0) : start + _SLICE + 1]
        any_letter = any_letter or bool(letter[own].any())
        own = np.where(inside[own], own, _SPACE).astype(np.int64)
        last = start + _SLICE >= len(points)
        c = np.concatenate([own[:0] if start else [_SPACE], own, [_SPACE, _SPACE] if last else own[:0]])
        before, at, after = c[:-2], c[1:-1], c[2:]
        word = at != _SPACE
        pair = word | (before != _SPACE)
        pairs = before << _BITS | at
        values, times = np.unique(np.concatenate([at[word], pairs[pair], pairs[word] << _BITS | after[word]]), return_counts=True)
        codes.append(values)
        counts.append(times)
    return _added(codes, counts) if any_letter else None


def _added(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], counts[0]
    values, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return values, total


def held_out(id_col: str = "doc_id"):
    """Whether a row belongs to the quarter that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> DataFrame:
    """``lang, gram, rank`` (from 0) of each language that a row with a letter names; rows without a language are left out.

    Places are by count over all rows, ties by the n-gram's number. A language of fewer n-grams has a shorter profile.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                codes, counts = _added(*zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if (found := grams(text)) is None:
                    continue
                mine = held.setdefault(lang, [])
                mine.append(found)
                size += len(found[0])
                if size > 4 * _HELD:
                    held = {k: [_added(*zip(*v))] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                if size > _HELD and all(len(v) == 1 for v in held.values()):
                    yield from told()
                    held, size = {}, 0
        yield from told()

    rows = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return written(sums.withColumn("rank", rank - 1).where(F.col("rank") < ranks).select("lang", "gram", "rank"))


class _Profiles:
    """Places of n-grams in the profiles of some languages, as one matrix; ``ranks`` where a language lacks one."""

    def __init__(self, rows: list, ranks: int):
        self.langs = sorted({r.lang for r in rows}, key=lambda lang: lang.encode("utf-8", "surrogatepass"))
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.codes, place = np.unique(np.array([r.gram for r in rows], np.int64), return_inverse=True)
        self.places = np.full((len(self.codes) + 1, len(self.langs)), ranks, np.int32)
        self.places[place, [at[r.lang] for r in rows]] = [r.rank for r in rows]
        self.ranks = ranks

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's n-grams, most frequent first, from each language."""
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        places = self.places[at]
        apart = np.abs(places - np.arange(len(own), dtype=np.int32)[:, None])
        return np.where(places == self.ranks, self.ranks, np.minimum(apart, self.ranks)).sum(axis=0)


def detect(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", own_ranks: int = OWN_RANKS, ranks: int = RANKS) -> DataFrame:
    """``_id, lang_pred, score`` of each row: the language of ``known`` (from ``profiles``) that its whole text is nearest to.

    ``score`` is how much of the greatest distance there can be is missing, from 0 (nothing in its place) to 1 (all of it). Ties go to the
    language smaller in UTF-8 bytes. A null text, one without a letter, and any text if no language is known, is ``und`` with a
    score of 0. Ids may be null or repeated. Languages are compared in blocks of about ``PASS``, each in one pass.
    """
    blocks = max(1, -(-known.select("lang").distinct().count() // PASS))
    schema = T.StructType(
        [
            T.StructField("_id", docs.schema[id_col].dataType),
            T.StructField("_text", T.StringType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    out = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score")
    )
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).collect()  # at most about PASS * ranks rows
        if rows:
            out = out.mapInArrow(_matcher(_Profiles(rows, ranks), own_ranks, block == blocks - 1), schema)
    return out.select("_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _matcher(known: _Profiles, own_ranks: int, last: bool):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = grams(text) if text else None
                if found is None:
                    continue
                codes, counts = found
                own = codes[np.argsort(-counts, kind="stable")[:own_ranks]]
                apart = known.distances(own)
                best = int(apart.argmin())
                score = 1 - float(apart[best]) / (len(own) * known.ranks)
                lang = known.langs[best]
                if scores[k] is None or (score, langs[k].encode("utf-8", "surrogatepass")) > (scores[k], lang.encode("utf-8", "surrogatepass")):
                    langs[k], scores[k] = lang, score
            texts = batch.column(1) if not last else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["_id", "_text", "lang_pred", "score"])

    return match
