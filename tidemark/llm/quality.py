"""Quality classifier: histogram gradient-boosted trees over statistics of a document's whole text.

The trees are fitted on the driver from the statistics of at most ``sample_rows`` labelled documents, chosen by a hash
of their id; the bound does not grow with the corpus. Scoring is one pass over the documents without a shuffle: Arrow
batches of texts become a matrix of statistics, and the flattened trees are walked by numpy.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import gbt

#: Documents whose crc32(id as text) leaves this remainder are held out of training.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_LETTERS_UP = np.arange(65, 91)
_LETTERS_LOW = np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_SYMBOLS = np.frombuffer(b"#$%&*|<>{}[]@=_~^\\/+", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; a null text counts as empty, an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    count = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(len(lines), 1)
    share = byte[byte > 0] / n
    low, up = byte[_LETTERS_LOW].sum(), byte[_LETTERS_UP].sum()
    return [
        np.log1p(n),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        len(seen) / count,
        max(seen.values(), default=0) / count,
        sum(map(operator.eq, words, words[1:])) / count,
        np.log1p(len(lines)),
        len(words) / n_lines,
        len(set(lines)) / n_lines,
        up / max(low + up, 1),
        low / n,
        byte[_DIGITS].sum() / n,
        byte[_SYMBOLS].sum() / count,
        byte[ord("|")] / count,
        byte[ord("!")] / count,
        byte[_STOPS].sum() / count,
        byte[128:].sum() / n,
        (lengths == 1).mean(),
        byte[:32].sum() / n,
        float(-(share * np.log(share)).sum()),
    ]


NAMES = (
    "log_bytes log_words word_mean word_std word_max distinct_words top_word adjacent_repeats log_lines words_a_line "
    "distinct_lines upper_share lower_share digit_share symbols pipes exclamations stops non_ascii one_byte_words "
    "control_share entropy"
).split()


def _matrix(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training; a null id has no label and is not held out."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 20_000,
    **settings,
) -> gbt.Trees:
    """Fit on at most ``sample_rows`` distinct labelled rows outside the held-out fold, smallest hash of the id first.

    Rows with a null id or label are not used; of rows of ``docs`` that repeat an id one is used. Without labelled
    documents, or with one class, the score is a constant.
    """
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    sample = (
        named.where(~held_out("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(7)), "_id", "_y").limit(sample_rows)
    )

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array(list(_matrix(b.column(2).to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], names=["_id", "_y", "x"])

    of_id = labels.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", of_id), T.StructField("_y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # at most sample_rows ids are broadcast
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_y", "_text").mapInArrow(stats, schema)
    rows = rows.groupBy("_id", "_y").agg(F.min("x").alias("x")).select("_y", "x").orderBy("_id", "_y").collect()
    return gbt.fit(np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([r._y for r in rows]), **settings)


def score(docs: DataFrame, model: gbt.Trees, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1. Null and empty texts are scored as empty texts."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(texts.to_pylist())), pa.float64())

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))
