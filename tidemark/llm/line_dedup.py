"""Removal of repeated passages by content-defined chunks of lines; DataFrame functions only.

A rolling hash runs over the hashes of each two lines in a row. A document is cut after a line where this hash is
smaller than at the lines beside it, so the same run of lines gets the same cuts wherever it stands, and chunks have two
lines at least. A line of ``long_words`` words or more is a passage by itself (a whole paragraph that a text has in one
line): cuts stand before and after it. Chunks that can be removed have at least two lines or are such a long line. Their
64-bit hashes are counted over the whole corpus; only chunks whose hash occurs again are compared byte by byte, by
grouping on hash and text. The occurrence in the smallest (doc_id, text hash, chunk number) stays.

A passage of a few short lines often has no chunk that its own text fixes. ``passages`` therefore also removes runs of
lines whose every two lines in a row stand before elsewhere, of ``long_words`` words or more: such a run is bounded by
its own ends, whatever the lines beside it. Pairs of lines are compared by 128 bits of hash.

The plan never gathers a group: counts and minima are combined before the shuffle and written out, and marks (ids and
hashes, never texts) meet them in joins of two plain inputs, which adaptive execution can split where a chunk is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, unused

LONG_WORDS = 50


def _let(value, use):
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lines(text):
    """Lines with their hash and their count of space-separated words."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(
            x.alias("line"),
            F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long").alias("hash"),
            (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"),
        ),
    )


def _ends(lines, long_words: int):
    """Indexes (from 0) of the lines that end a chunk."""
    last = F.size(lines) - 1

    def rolled(i):
        before = F.when(i > 0, F.get(lines, i - 1)["hash"]).otherwise(F.lit(0))
        return (before * 31 + F.get(lines, i)["hash"]) % F.lit(1 << 32)

    def ends(i):
        long = (F.get(lines, i)["words"] >= long_words) | (F.get(lines, F.least(i + 1, last))["words"] >= long_words)
        least = (i > 0) & (rolled(i) < rolled(i - 1)) & (rolled(i) <= rolled(i + 1))
        return (i == last) | long | least

    return F.filter(F.sequence(F.lit(0), last), ends)


def _chunks(lines, ends, long_words: int):
    def chunk(end, k):
        start = F.when(k > 0, F.get(ends, k - 1) + 1).otherwise(F.lit(0))
        own = F.slice(lines, start + 1, end - start + 1)
        text = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
        return F.struct(
            text.alias("text"),
            F.size(own).alias("lines"),
            ((F.size(own) >= 2) | (F.get(own, F.lit(0))["words"] >= long_words)).alias("able"),
        )

    return F.transform(ends, chunk)


def chunks_of(text, long_words: int = LONG_WORDS):
    """Array of chunks (text, lines, able) of a text column. A null text has null, an empty one has one chunk."""

    def of_lines(lines):
        return _let(_ends(lines, long_words), lambda ends: _chunks(lines, ends, long_words))

    return _let(_lines(text), of_lines)


def _pairs_again(texts: DataFrame) -> DataFrame:
    """For each text with pairs of lines that occur again: numbers of those that stand before (``_later``) and of the others (``_early``)."""

    def pairs(lines):
        def pair(i):
            a, b = F.get(lines, i), F.get(lines, i + 1)
            return F.struct(i.alias("k"), F.xxhash64(a, b).alias("p"), F.xxhash64(b, F.lit(1), a).alias("q"))

        return F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(0), F.size(lines) - 2), pair))

    key = F.struct(F.col("_id"), F.col("_h"), F.col("_k"))
    marks = texts.select("_id", "_h", F.explode(_let(F.split("_text", "\n", -1), pairs)).alias("_c"))
    marks = cut(marks.select("_id", "_h", F.col("_c.k").alias("_k"), F.col("_c.p").alias("_p"), F.col("_c.q").alias("_q")))
    first = cut(marks.groupBy("_p", "_q").agg(F.min(key).alias("_first"), F.max(key).alias("_last")).where("_first != _last"))
    later = key != F.col("_first")
    found = marks.join(first.select("_p", "_q", "_first"), ["_p", "_q"]).groupBy("_id", "_h")
    found = found.agg(F.collect_set(F.when(later, F.col("_k"))).alias("_later"), F.collect_set(F.when(~later, F.col("_k"))).alias("_early"))
    return found.where(F.size("_later") > 0).withColumn("_later", F.array_sort("_later"))


def _kept_between(lines, later, early, long_words: int):
    """``lines`` without the runs of pairs ``later`` (sorted) of enough words; lines of a pair in ``early`` without a blank line stay."""
    none = F.array().cast("array<int>")

    def words(a, b):
        of = F.transform(F.slice(lines, a + 1, b - a + 1), lambda x: F.when(F.trim(x["line"]) == "", 0).otherwise(x["words"]))
        return F.aggregate(of, F.lit(0), lambda n, x: n + x)

    starts = F.filter(later, lambda x, j: (j == 0) | (F.get(later, j - 1) != x - 1))
    ends = F.filter(later, lambda x, j: (j == F.size(later) - 1) | (F.coalesce(F.get(later, j + 1), F.lit(-1)) != x + 1))

    def stays(k):
        both = [F.coalesce(F.trim(F.get(lines, i)["line"]) != "", F.lit(False)) for i in (k, k + 1)]
        return (F.array_contains(early, k) & both[0] & both[1]).cast("int")

    def run(a, b):  # of lines; the words are those of the whole run
        return F.struct(
            (a + stays(a - 1)).alias("a"),
            (b + 1 - stays(b + 1)).alias("b"),
            words(a, b + 1).alias("words"),
        )

    runs = F.filter(F.zip_with(starts, ends, run), lambda r: (r["words"] >= long_words) & (r["a"] <= r["b"]))

    def between(runs):
        def piece(j):
            start = F.when(j > 0, F.get(runs, j - 1)["b"] + 1).otherwise(F.lit(0))
            end = F.when(j < F.size(runs), F.get(runs, j)["a"]).otherwise(F.size(lines))
            return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), piece))

    return F.when(F.size(F.coalesce(later, none)) > 0, _let(runs, between)).otherwise(lines)


#: Names that the columns of a document have on the way; columns of these names are renamed for as long.
_OWN = ("_h", "_gone", "_later", "_early", "_out")
#: Columns that the result has beside those of the documents.
MADE = ("n_chunks", "n_removed", "removed_lines", "removed_chars")


def _later_than_first(marks: DataFrame, held: DataFrame, key) -> DataFrame:
    """``_id, _h, _k`` of the chunks whose text stands in a chunk with a smaller key."""
    ends = [F.min(key).alias("_first"), F.max(key).alias("_last")]
    groups = cut(held.groupBy("_ch", "_t").agg(*ends).drop("_t"))
    clash = groups.groupBy("_ch").count().where("count > 1").select("_ch")
    first = groups.where("_first != _last").select("_ch", "_first")
    if not clash.isEmpty():  # texts that differ and yet share a hash are told apart by the text
        clash = cut(clash)
        first = first.join(clash, "_ch", "left_anti")
        own = cut(held.join(clash, "_ch"))
        both = own.join(own.groupBy("_t").agg(*ends).where("_first != _last").select("_t", "_first"), "_t")
        return marks.join(first, "_ch").where(key != F.col("_first")).select("_id", "_h", "_k").unionByName(both.where(key != F.col("_first")).select("_id", "_h", "_k"))
    return marks.join(first, "_ch").where(key != F.col("_first"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    long_words: int = LONG_WORDS,
    passages: bool = False,
) -> DataFrame:
    """``docs`` with the text without repeated chunks, and ``n_chunks``, ``n_removed``, ``removed_lines``, ``removed_chars``.

    Chunks repeated within one document count too. Rows that repeat both id and text are one document: each of them
    gets that document's result. A null id sorts before all others. Null texts stay null; a text of which nothing is
    left becomes empty. Other columns are kept as they are; the four result columns replace columns of these names.

    With ``passages``, repeated runs of lines go too, also where chunks miss them. The first occurrence of a pair of
    lines (without a blank one) that occurs again stays whole, and every line that goes stands before. ``n_removed`` counts the chunks that
    went whole as such; ``removed_lines`` and ``removed_chars`` count all that went.
    """
    clash = {c: unused(f"{c}_given", docs) for c in docs.columns if c.lower() in _OWN}
    if clash:
        out = dedup_lines(docs.withColumnsRenamed(clash), clash.get(id_col, id_col), clash.get(text_col, text_col), long_words, passages)
        return out.withColumnsRenamed({new: old for old, new in clash.items()})
    key = F.struct(F.col("_id"), F.col("_h"), F.col("_k"))
    base = docs.withColumn("_h", F.xxhash64(F.col(text_col)))
    texts = base.select(F.col(id_col).alias("_id"), "_h", F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())

    chunks = chunks_of(F.col("_text"), long_words)
    able = texts.select("_id", "_h", F.posexplode_outer(chunks).alias("_k", "_c")).where("_c.able")
    marks = cut(able.select("_id", "_h", "_k", F.xxhash64("_c.text").alias("_ch")))
    again = cut(marks.groupBy("_ch").count().where("count > 1").select("_ch"))
    suspects = marks.join(again, "_ch").groupBy("_id", "_h").agg(F.collect_set("_k").alias("_ks"))

    same = [F.col("a._id").eqNullSafe(F.col("b._id")), F.col("a._h") == F.col("b._h")]
    held = texts.alias("a").join(suspects.alias("b"), same).select("a._id", "a._h", "_text", "_ks")

    def of_suspects(chunks):
        return F.transform(F.array_sort("_ks"), lambda k: F.struct(k.alias("k"), F.get(chunks, k)["text"].alias("t")))

    held = held.select("_id", "_h", F.explode_outer(_let(chunks, of_suspects)).alias("_c"))
    held = held.select("_id", "_h", F.col("_c.k").alias("_k"), F.col("_c.t").alias("_t"), F.xxhash64("_c.t").alias("_ch"))
    gone = _later_than_first(marks, held, key)
    gone = gone.groupBy("_id", "_h").agg(F.collect_set("_k").alias("_gone"))
    if passages:
        gone = gone.withColumns({"_later": F.array().cast("array<int>"), "_early": F.array().cast("array<int>")})
        runs = _pairs_again(texts).withColumn("_gone", F.array().cast("array<int>"))
        every = gone.unionByName(runs).groupBy("_id", "_h")  # a row of each at most
        gone = every.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("_gone", "_later", "_early")))

    same = [F.col(f"a.{id_col}").eqNullSafe(F.col("b._id")), F.col("a._h") == F.col("b._h")]
    plain = base.drop(*(c for c in MADE if c != text_col and c != id_col))
    out = plain.alias("a").join(gone.alias("b"), same, "left").select("a.*", *(f"b.{c}" for c in gone.columns[2:]))
    out = out.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))

    def rebuilt(chunks):
        left = F.filter(chunks, lambda c, k: ~F.array_contains(F.col("_gone"), k))
        lines = F.aggregate("_gone", F.lit(0).cast("long"), lambda n, k: n + F.get(chunks, k)["lines"])
        return F.struct(
            F.array_join(F.transform(left, lambda c: c["text"]), "\n").alias("text"),
            F.size(chunks).cast("long").alias("n"),
            lines.alias("lines"),
        )

    def of_lines(chunks):
        """As ``rebuilt``, with the runs of lines taken out too."""

        def of_chunk(c, k):
            gone = F.array_contains(F.col("_gone"), k)
            return F.transform(
                F.split(c["text"], "\n", -1),
                lambda x: F.struct(x.alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"), gone.alias("gone")),
            )

        def taken(lines):
            left = F.filter(_kept_between(lines, F.col("_later"), F.col("_early"), long_words), lambda x: ~x["gone"])

            def counted(left):
                return F.struct(
                    F.array_join(F.transform(left, lambda x: x["line"]), "\n").alias("text"),
                    F.size(chunks).cast("long").alias("n"),
                    (F.size(lines) - F.size(left)).cast("long").alias("lines"),
                )

            return _let(left, counted)

        return _let(F.flatten(F.transform(chunks, of_chunk)), taken)

    out = out.withColumn("_out", _let(chunks_of(F.col(text_col), long_words), of_lines if passages else rebuilt))
    removed = {
        "n_chunks": F.coalesce("_out.n", F.lit(0)),
        "n_removed": F.size("_gone").cast("long"),
        "removed_lines": F.coalesce("_out.lines", F.lit(0)),
        "removed_chars": F.coalesce(F.length(text_col) - F.length("_out.text"), F.lit(0)).cast("long"),
        text_col: F.when(F.col(text_col).isNotNull(), F.col("_out.text")),
    }
    return out.withColumns(removed).drop(*_OWN)


ORACLE = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS hash, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM l),
g AS (SELECT *, (coalesce(lag(hash) OVER (PARTITION BY r ORDER BY i), 0) * 31 + hash) % 4294967296 AS rolled FROM h),
e AS (SELECT *, CASE WHEN lead(i) OVER w IS NULL OR words >= {long} OR coalesce(lead(words) OVER w, 0) >= {long}
        OR coalesce(rolled < lag(rolled) OVER w AND rolled <= lead(rolled) OVER w, false) THEN 1 ELSE 0 END AS ends
      FROM g WINDOW w AS (PARTITION BY r ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, r, k, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n, (count(*) >= 2 OR max(words) >= {long}) AS able FROM k GROUP BY 1, 2, 3),
m AS (SELECT *, row_number() OVER (PARTITION BY t, able ORDER BY doc_id, k) > 1 AND able AS gone FROM c)
SELECT d.doc_id, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text, count(*)::BIGINT AS n_chunks,
       count(*) FILTER (gone)::BIGINT AS n_removed, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS removed_lines,
       (max(length(d.text)) - length(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT gone), '')))::BIGINT AS removed_chars
FROM d JOIN m USING (r) GROUP BY d.r, d.doc_id
UNION ALL SELECT doc_id, NULL, 0, 0, 0, 0 FROM documents WHERE text IS NULL
""".format(long=LONG_WORDS)
