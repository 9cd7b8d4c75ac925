"""Personal data by candidate gradient boosting; DataFrame functions only.

Strict rules find e-mail addresses, IP addresses, card and phone numbers. Beside them high-recall generators propose
overlapping spans (also written-out addresses, national phone numbers, secrets). Each proposal becomes a row of format
and context features; boosted trees score it, and a threshold calibrated for its kind decides. What the rules found
always stays, and a proposal counts only where it overlaps nothing that the rules found or that scored better. A secret
longer than ``HEAD`` is judged by its head; where its tail holds other spans, it is listed in pieces around them.

The trees are fitted on the driver from two bounded samples: ``SAMPLE`` made-up spans, and what the generators propose in
at most ``SAMPLE_DOCS`` documents of the corpus, where a proposal that is what a rule found is personal data, and one that a
rule's pattern matched and its check refused is not. A part of both is kept for the thresholds. The trees run as nested
``CASE`` expressions. Scoring is one pass over the texts: positions come from the lengths of the matches and of the gaps
between them, nothing is exploded or shuffled; overlaps are looked up by binary search, so a text with many spans (a log, a
table of numbers) costs little more than in proportion to them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import gbt

KINDS = ("email", "ip", "card", "phone")
#: The rules. A run of characters is entered only at its start (or where the last match ended), and possessive
#: quantifiers keep long runs linear; both leave the matches of the plain patterns as they are.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of proposals by kind; they may overlap each other and the rules.
GENERATORS = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}+\x20?+(?:@|[\[(]at[\])]|\x20at\x20)\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])]|\x20dot\x20)\x20?[a-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{2,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:00|\()?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}(?![0-9])",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\x20?[:=]\x20?[^\s,;]{4,}+",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[a-z0-9_-]*+[A-Z])[A-Za-z0-9_-]{16,}+",
}
#: The kind of what a generator proposes, where it is not its name.
KIND_OF = {"key": "secret"}
SAMPLE, SAMPLE_DOCS, PRECISION = 6000, 2000, 0.99
#: Most labelled spans of those documents that the trees are fitted on, by the smallest hashes of what is known of a span.
SAMPLE_SPANS = 20_000
#: Beginnings of issued keys in formats that their issuers publish. Fixed values.
ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|rk_live_|sk_test_|AIza|glpat-|npm_)"
#: Of a longer secret, the trees and the choice between proposals see so many characters; its span has them all.
HEAD = 141

#: Made-up spans: generator, whether it is personal, text before, span. # is a digit, ? a letter, ^ a letter or digit, * a capital or digit.
_TEMPLATES = [
    ("email", 1, "write to ", "????.??? [at] ??????? [dot] com"),
    ("email", 1, "contact: ", "?????(at)????(dot)org"),
    ("email", 1, "mail ", "???.??@???????.example.net"),
    ("email", 1, "e-mail me: ", "?????## at ?????? dot com"),
    ("email", 0, "we met ", "???? at ?????.???????"),
    ("email", 0, "the price is ", "# at #.##"),
    ("email", 0, "they arrived ", "?????? at ???. ????"),
    ("email", 0, "look ", "?? at ????? dot ??? dot ????"),
    ("ip", 1, "from host ", "10.##.1#.2##"),
    ("ip", 1, "address ", "1##.1#.#.1#"),
    ("ip", 0, "version ", "9##.8##.7##.#"),
    ("ip", 0, "section ", "###.###.9##.###"),
    ("card", 1, "card number ", "4111 1111 1111 1111"),
    ("card", 1, "visa: ", "4012888888881881"),
    ("card", 1, "paid with ", "5500-0000-0000-0004"),
    ("card", 1, "card ", "6011.1111.1111.1117"),
    ("card", 0, "order ", "9### #### ####"),
    ("card", 0, "serial ", "4###############"),
    ("card", 0, "number ", "7### #### #### ####"),
    ("card", 0, "id ", "2###-####-##"),
    ("phone", 1, "call me at ", "(###) ###-####"),
    ("phone", 1, "phone: ", "###-###-####"),
    ("phone", 1, "tel. ", "0## ### ## ##"),
    ("phone", 1, "my mobile is ", "0044 ### ### ####"),
    ("phone", 1, "fax ", "(0##) #### ####"),
    ("phone", 0, "on ", "20##-1#-2#"),
    ("phone", 0, "in the years ", "19## - 20## - 20##"),
    ("phone", 0, "scores of ", "### ### ####"),
    ("phone", 0, "dated ", "2#.1#.20##"),
    ("phone", 0, "host ", "1##.2#.1##.1#"),
    ("phone", 0, "a total of ", "## ### ###"),
    ("phone", 0, "ratio ", "##/##/##"),
    ("secret", 1, "the ", "password=^^^^#^^^^#^^"),
    ("secret", 1, "use ", "api_key: ^^^#^^^^^^#^^^^^^"),
    ("secret", 1, "set ", "token=^^#^^^^#^^^^"),
    ("secret", 0, "your ", "password: required"),
    ("secret", 0, "every ", "token: ?????"),
    ("secret", 0, "the ", "secret: ??????"),
    ("secret", 1, "so ", 'token = "^^#^^^^#^^^^^^#^^^^^#^^^^"'),
    ("key", 1, "with ", "AKIA*******#********"),
    ("key", 1, "the ", "ASIA*#**************"),
    ("key", 1, "use ", "ghp_^*^#*^^#^*^^#^*^#*^^#*^^"),
    ("key", 1, "key ", "sk_live_^*^#^^*#^^*#^*^#"),
    ("key", 1, "is ", "AIza*^#^*^^#*^#^*^^#^*^^#*^^^#*"),
    ("key", 1, "and ", "**#**#***#**#****#**#***"),
    ("key", 1, "by ", "*****#********#*******#*"),
    ("key", 0, "file ", "IMG_20##0#1#_1#4#2#_HDR"),
    ("key", 0, "model ", "SERIES-2###-EDITION-1"),
    ("key", 0, "the ", "Professional??????Edition20##"),
    ("key", 0, "see ", "Chapter1#-Section#-Page1##"),
    ("key", 0, "class ", "Abstract????????Factory2"),
    ("key", 0, "code ", "COVID-19-???????????"),
    ("key", 0, "item ", "ISBN-978-###-####-##-X"),
]
_CONTEXT = {
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|paid)\b",
    "mail": r"(?i)\b(?:mail|e-mail|email|contact|write|reach)\b",
    "net": r"(?i)\b(?:ip|host|address|server|from)\b",
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _running(values: Column, block: int = 256) -> Column:
    """Running sums of an array, by blocks so that the cost stays near linear."""

    def add(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def by_blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: add(F.slice(v, b * block + 1, F.lit(block))))

        def of_sums(s: Column) -> Column:
            before = F.transform(s, lambda _, b: add(F.slice(s, F.lit(1), b)))
            return _let(
                before,
                lambda p: F.transform(
                    v,
                    lambda _, k: F.get(p, F.floor(k / block).cast("int"))
                    + add(F.slice(v, F.floor(k / block).cast("int") * block + 1, k % block + 1)),
                ),
            )

        return F.when(F.size(v) > 0, _let(sums, of_sums)).otherwise(F.array().cast("array<int>"))

    return _let(values, by_blocks)


def _looked_at(text: Column) -> Column:
    """The text with what it must hold for a pattern to match at all; most texts are done with that."""
    return F.struct(
        text.alias("text"),
        text.contains("@").alias("at"),
        text.contains("+").alias("plus"),
        text.rlike("[0-9]").alias("digits"),
        text.rlike(r"(?i)@|[\[(]at[\])]|\x20at\x20").alias("spelled"),
        text.rlike("[:=]").alias("set"),
    )


#: What a text must hold for a rule or a generator to match.
RULE_NEEDS = {"email": "at", "ip": "digits", "card": "digits", "phone": "plus"}
GENERATOR_NEEDS = {"email": "spelled", "ip": "digits", "card": "digits", "phone": "digits", "secret": "set", "key": "digits"}


def find(t: Column, pattern: str, kind: str, needs: str, context: bool = False) -> Column:
    """All matches in a looked-at text as an array of (kind, start, end, text), in code points, end exclusive.

    With ``context`` they also have ``before``, the last 24 characters ahead of the match (not beyond the match before), and
    ``after``, the character behind it. Both come from the gaps between the matches, so no place is looked up in the text.
    """
    text = t["text"]
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def placed(s: Column) -> Column:
        steps = F.transform(
            s["m"],
            lambda _, k: F.length(F.get(s["g"], k)) + F.when(k > 0, F.length(F.get(s["m"], k - 1))).otherwise(F.lit(0)),
        )

        def spans(starts: Column) -> Column:
            return F.transform(
                s["m"],
                lambda m, k: F.struct(
                    F.lit(kind).alias("kind"),
                    F.get(starts, k).alias("start"),
                    (F.get(starts, k) + F.length(m)).alias("end"),
                    m.alias("text"),
                    *([ahead(k).alias("before"), behind(k).alias("after")] if context else []),
                ),
            )

        def ahead(k: Column) -> Column:
            return F.right(F.concat(F.when(k > 0, F.get(s["m"], k - 1)).otherwise(F.lit("")), F.get(s["g"], k)), F.lit(24))

        def behind(k: Column) -> Column:
            return F.substring(F.concat(F.get(s["g"], k + 1), F.coalesce(F.get(s["m"], k + 1), F.lit(""))), 1, 1)

        return _let(_running(steps), spans)

    none = F.array().cast(f"array<struct<kind:string,start:int,end:int,text:string{',before:string,after:string' if context else ''}>>")
    return F.when(t[needs], _let(both, placed)).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def place(d: Column, k: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(k % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d.cast("int"))

    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), place)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(text: Column) -> Column:
    part = F.split(text, r"\.")
    return (F.size(part) == 4) & F.forall(part, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        part, lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(t: Column) -> Column:
    """What the rules find, by kind and then by place."""
    valid = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: _octets(s["text"]),
        "card": lambda s: F.length(_digits(s["text"])).between(13, 19) & _luhn(_digits(s["text"])),
        "phone": lambda s: F.length(_digits(s["text"])).between(9, 15),
    }
    return F.concat(*(F.filter(find(t, RULES[k], k, RULE_NEEDS[k]), valid[k]) for k in KINDS))


def features(kind: Column, span: Column, before: Column, after: Column) -> Column:
    """Format of a span and its context, as an array of doubles."""
    digits = _digits(span)
    n, nd = F.length(span), F.length(digits)
    letters = F.length(F.regexp_replace(span, "[^A-Za-z]", ""))

    def flag(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)

    code = F.array_position(F.array(*(F.lit(k) for k in GENERATORS)), kind)
    values = [
        code,
        n,
        nd,
        letters,
        n - nd - letters,
        F.size(F.split(F.trim(F.regexp_replace(span, "[^0-9]+", " ")), " ")),
        flag(span.startswith("(") | span.startswith("00")),
        flag(span.contains("@") | span.rlike(r"(?i)[\[(](?:at|dot)[\])]")),
        flag(span.rlike(r"(?i)\x20dot\x20(?:com|org|net|edu|gov|io|de|fr|es|uk)$")),
        flag(nd.between(13, 19) & _luhn(F.when(nd.between(13, 19), digits).otherwise(F.lit("1")))),
        flag(_octets(span)),
        flag(span.rlike(r"^(?:19|20)?[0-9]{2}\x20?[./-]\x20?[0-9]{1,4}\x20?[./-]\x20?(?:[0-9]{4}|[0-9]{1,2})$")),
        F.size(F.array_distinct(F.split(span, ""))) / F.greatest(n, F.lit(1)),
        flag(F.regexp_extract(span, r"[:=]\x20?(.*)$", 1).rlike("(?:[0-9].*){2}")),
        flag(span.rlike(ISSUED)),
        F.length(F.regexp_replace(F.regexp_replace(span, "[^0-9]+", "a"), "[0-9]+", "1")),
        n - F.length(F.regexp_replace(span, "[A-Z]", "")),
        n - F.length(F.regexp_replace(span, "[_-]", "")),
        *(flag(before.rlike(p)) for p in _CONTEXT.values()),
        flag(before.rlike(r"[A-Za-z0-9]$")),
        flag(after.rlike(r"^[A-Za-z0-9]")),
    ]
    return F.array(*(v.cast("double") for v in values))


def _expression(model: gbt.Trees, f: Column) -> Column:
    """The score of a feature array as nested conditions, one for each tree."""

    def walk(node: int) -> Column:
        if model.left[node] == node:
            return F.lit(float(model.value[node]))
        down = F.get(f, F.lit(int(model.feature[node]))) <= float(model.threshold[node])
        return F.when(down, walk(int(model.left[node]))).otherwise(walk(int(model.right[node])))

    margin = F.lit(model.base)
    for root in model.roots:
        margin = margin + walk(int(root))
    return 1 / (1 + F.exp(-margin))


def made_up(spark: SparkSession, sample: int) -> DataFrame:
    """``family, kind, y, x``: ``sample`` spans from the templates, with the template as family. The same every time."""
    names = ["kind", "label", "before", "span"]
    of = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, t))) for t in _TEMPLATES))
    family = (F.col("id") % len(_TEMPLATES)).cast("int")
    made = spark.range(sample).withColumn("t", F.get(of, family))
    noise = F.sha2(F.col("id").cast("string").cast("binary"), 256)

    def filled(c: Column, k: Column) -> Column:
        own = F.substring(noise, k % 60 + 1, F.lit(1))
        return (
            F.when(c == "#", F.translate(own, "abcdef", "123456"))
            .when(c == "?", F.translate(own, "0123456789", "ghijklmnop"))
            .when(c == "*", F.translate(own, "0123456789abcdef", "2574KQRVXMZWJTGB"))
            .when(c == "^", own)
            .otherwise(c)
        )

    span = F.array_join(F.transform(F.split("t.span", "(?!^)(?!$)"), filled), "")
    made = made.select("id", family.alias("family"), "t.kind", "t.label", F.col("t.before").alias("before"), span.alias("span"))
    luhn = F.length(_digits(F.col("span"))).between(13, 19) & _luhn(_digits(F.col("span")))
    label = F.when(F.col("kind") == "card", luhn.cast("int")).otherwise(F.col("label"))
    x = features(F.col("kind"), F.col("span"), F.col("before"), F.lit(" "))
    return made.select(F.concat(F.lit("t"), "family").alias("family"), "id", "kind", label.alias("y"), x.alias("x"))


def from_corpus(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """As ``made_up``, from what the generators propose in ``most`` documents (those whose text has the smallest hashes).

    A proposal that is exactly what a rule found is labelled 1; one that lies on a match which the rule's check refused,
    and on nothing that a rule found, is labelled 0; others have no label and are left out. The family is the document's.
    """
    text = F.col(text_col).cast("string")
    h = F.xxhash64(text).alias("_h")
    few = docs.select(h, text.alias("_t")).where("_t is not null").orderBy("_h").limit(most)  # for labels only

    def spans(t: Column) -> Column:
        good = base_spans(t)
        tried = F.concat(*(find(t, RULES[k], k, RULE_NEEDS[k]) for k in ("ip", "card", "phone")))

        def labelled(both: Column) -> Column:
            def one(s: Column) -> Column:
                same = F.exists(both["good"], lambda b: (b["kind"] == s["kind"]) & (b["start"] == s["start"]) & (b["end"] == s["end"]))
                clear = ~F.exists(both["good"], lambda b: _over(s, b)) & F.exists(both["tried"], lambda b: (b["kind"] == s["kind"]) & _over(s, b))
                x = features(s["kind"], s["text"], s["before"], s["after"])
                return F.struct(s["kind"].alias("kind"), F.when(same, 1).when(clear, 0).alias("y"), x.alias("x"))

            found = F.concat(*(find(t, GENERATORS[k], k, GENERATOR_NEEDS[k], context=True) for k in ("email", "ip", "card", "phone")))
            return F.transform(found, one)

        return _let(F.struct(good.alias("good"), tried.alias("tried")), labelled)

    each = few.select("_h", F.explode(_let(_looked_at(F.col("_t")), spans)).alias("s")).where("s.y is not null")
    each = each.select(F.col("_h").cast("string").alias("family"), F.col("_h").alias("id"), "s.kind", "s.y", "s.x")
    return each.orderBy(F.xxhash64("id", "kind", "x"), "id", "kind", "y", "x").limit(SAMPLE_SPANS)


def fit(spark: SparkSession, docs: DataFrame | None = None, text_col: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> tuple[gbt.Trees, dict[str, float]]:
    """Trees and a threshold for each generator, from both samples (from the templates alone without ``docs``).

    Of the templates every second row, of the corpus every second document is kept for the thresholds: the smallest
    score from which on ``precision`` of the kept rows are personal data, 0.5 at least. The same for the same documents.
    """
    rows = made_up(spark, sample)
    if docs is not None:
        rows = rows.unionByName(from_corpus(docs, text_col))
    rows = rows.orderBy("family", "id", "kind", "y").collect()  # at most sample and SAMPLE_SPANS rows
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    odd = np.array([(r.id // len(_TEMPLATES) if r.family[0] == "t" else r.id) % 2 == 1 for r in rows])
    model = gbt.fit(x[~odd], y[~odd], trees=20, depth=3, rate=0.4, bins=32)
    score, kinds = model.score(x), np.array([r.kind for r in rows])
    limits = {}
    for kind in GENERATORS:
        own = odd & (kinds == kind)
        order = np.argsort(-score[own])
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        limits[kind] = float(max(score[own][order][good[-1]], 0.5)) if len(good) else 1.1
    return model, limits


def held_out_families(spark: SparkSession, sample: int = SAMPLE, folds: int = 5) -> dict[str, tuple[float, float]]:
    """Precision and recall for each generator on templates that the trees were not fitted on, over ``folds`` folds."""
    rows = made_up(spark, sample).orderBy("id").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    kinds, fold = np.array([r.kind for r in rows]), np.array([int(r.family[1:]) % folds for r in rows])
    said = np.zeros(len(rows), bool)
    for k in range(folds):
        said[fold == k] = gbt.fit(x[fold != k], y[fold != k], trees=20, depth=3, rate=0.4, bins=32).score(x[fold == k]) >= 0.5
    out = {}
    for kind in GENERATORS:
        own = kinds == kind
        hits = (said & (y == 1) & own).sum()
        out[kind] = float(hits / max((said & own).sum(), 1)), float(hits / max(((y == 1) & own).sum(), 1))
    return out


def _made_by(name: str):
    return lambda s: s["by"] == name


def _over(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _count_below(spans: Column, field: str, value: Column, also: bool) -> Column:
    """How many of the sorted ``spans`` have ``field`` below ``value`` (or at it, if ``also``), by binary search."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.get(spans, mid)[field]
        low = (acc["lo"] < acc["hi"]) & ((at <= value) if also else (at < value))
        return F.struct(F.when(low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(low | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    first = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.when(F.size(spans) > 0, F.aggregate(steps, first, step, lambda acc: acc["lo"])).otherwise(F.lit(0))


def _touched(spans: Column, s: Column) -> Column:
    """Those of the ``spans``, sorted and apart from each other, that overlap ``s``."""
    from_ = _count_below(spans, "end", s["start"], also=True)
    return _let(from_, lambda i: F.slice(spans, i + 1, F.greatest(_count_below(spans, "start", s["end"], also=False) - i, F.lit(0))))


def proposals(t: Column, model: gbt.Trees, limits: dict[str, float]) -> Column:
    """Spans of all generators (``by``) that reach their threshold, with their score, and ``whole``: the end of what was cut to its head."""

    kinds = F.create_map(*(F.lit(v) for k in GENERATORS for v in (k, KIND_OF.get(k, k))))

    def scored(s: Column) -> Column:
        end = F.when(s["kind"].isin("secret", "key"), F.least(s["end"], s["start"] + HEAD)).otherwise(s["end"])
        head = F.substring(s["text"], F.lit(1), end - s["start"])
        after = F.when(end < s["end"], F.substring(s["text"], end - s["start"] + 1, F.lit(1))).otherwise(s["after"])
        value = _let(features(s["kind"], head, s["before"], after), lambda f: _expression(model, f))
        return F.struct(
            s["kind"].alias("by"), F.element_at(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), end.alias("end"), head.alias("text"), s["end"].alias("whole"), value.alias("score")
        )

    limit = F.create_map(*(F.lit(v) for pair in limits.items() for v in pair))
    found = F.concat(*(find(t, p, k, GENERATOR_NEEDS[k], context=True) for k, p in GENERATORS.items()))
    return F.filter(F.transform(found, scored), lambda s: s["score"] >= F.element_at(limit, s["by"]))


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end, text) of the rules, and of rules and trees.

    Both are sorted by kind, as listed with ``secret`` last, and by start. A null text counts as empty and has none. Rows
    are judged each by itself; columns named ``base`` or ``spans`` are replaced. Very long texts are read whole.
    """
    model, limits = fit(docs.sparkSession, docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def plain(s: Column) -> Column:
        return F.struct(*(s[n].alias(n) for n in ("kind", "start", "end", "text")))

    no_pieces = F.array().cast("array<struct<start:int,end:int>>")

    def with_base(t: Column, base: Column) -> Column:
        def chosen(more: Column) -> Column:
            def free(rules: Column) -> Column:
                return F.filter(more, lambda s: ~reduce(or_, (F.size(_touched(rules[k], s)) > 0 for k in KINDS)))

            def better(o: Column, s: Column) -> Column:
                """By score, then by place; but an assignment holds the bare key in it, whatever their scores."""
                later = (o["score"] == s["score"]) & (F.struct(o["start"], o["end"], o["kind"]) < F.struct(s["start"], s["end"], s["kind"]))
                holds, held = (o["by"] == "secret") & (s["by"] == "key"), (o["by"] == "key") & (s["by"] == "secret")
                return holds | ~held & ((o["score"] > s["score"]) | later)

            def best(f: Column) -> Column:
                def of(by: Column) -> Column:
                    return F.filter(f, lambda s: ~reduce(or_, (F.exists(_touched(by[k], s), lambda o: better(o, s)) for k in GENERATORS)))

                return _let(F.struct(*(F.filter(f, _made_by(k)).alias(k) for k in GENERATORS)), of)

            def whole(s: Column, every: Column) -> Column:
                """A chosen span with its tail, in pieces around what else was found there."""
                there = F.filter(every, lambda o: (o["start"] > s["start"]) & (o["start"] < s["whole"]) & (o["end"] > s["end"]))

                def step(acc: Column, o: Column) -> Column:
                    piece = F.when(o["start"] > acc["at"], F.array(F.struct(acc["at"].alias("start"), o["start"].alias("end"))))
                    pieces = F.concat(acc["pieces"], F.coalesce(piece, no_pieces))
                    return F.struct(F.greatest(acc["at"], o["end"]).alias("at"), pieces.alias("pieces"))

                rest = F.array(F.struct(s["whole"].alias("start"), s["whole"].alias("end")))  # closes the last piece
                ordered = F.concat(F.array_sort(there, lambda p, q: p["start"] - q["start"]), rest)
                first = F.struct(s["start"].alias("at"), no_pieces.alias("pieces"))
                cuts = F.aggregate(ordered, first, step, lambda acc: acc["pieces"])
                return F.transform(
                    cuts,
                    lambda c: F.struct(
                        s["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.substring(t["text"], c["start"] + 1, c["end"] - c["start"]).alias("text")
                    ),
                )

            def with_tails(b: Column) -> Column:
                ends = [F.transform(base, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))), F.transform(b, lambda o: F.struct(o["start"].alias("start"), o["whole"].alias("end")))]
                every = F.concat(*ends)
                return F.flatten(F.transform(b, lambda s: F.when(s["whole"] > s["end"], whole(s, every)).otherwise(F.array(plain(s)))))

            left = _let(F.struct(*(of_kind(base, k).alias(k) for k in KINDS)), free)
            return _let(_let(left, best), with_tails)

        added = _let(proposals(t, model, limits), chosen)

        def both(a: Column) -> Column:
            every = [of_kind(F.concat(base, a), k) for k in (*KINDS, "secret")]
            return F.struct(base.alias("base"), F.concat(*(F.array_sort(e, lambda p, q: p["start"] - q["start"]) for e in every)).alias("spans"))

        return _let(added, both)

    def looked_at(t: Column) -> Column:
        return _let(base_spans(t), lambda base: with_base(t, base))

    found = docs.withColumn("_found", _let(_looked_at(text), looked_at))
    return found.withColumns({"base": F.col("_found.base"), "spans": F.col("_found.spans")}).drop("_found")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    ordered = F.array_sort(spans, lambda p, q: p["start"] - q["start"])

    def join(s: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            skip = F.greatest(acc["at"], x["start"])
            kept = F.substring(text, acc["at"] + 1, F.greatest(skip - acc["at"], F.lit(0)))
            return F.struct(
                F.concat(acc["out"], kept, F.when(x["end"] > acc["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))).alias("out"),
                F.greatest(acc["at"], x["end"]).alias("at"),
            )

        end = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(s, end, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    return _let(ordered, join)
