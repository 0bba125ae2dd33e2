"""Personal data by candidate gradient boosting, with DataFrame functions and Spark ML alone.

Generators of high recall propose spans. Those of the base formats (email, ip, card, phone) that
pass their checks are kept as they are. Looser generators (phones without a country code, written-out
addresses, assigned secrets, spaced numbers) propose further spans, which may overlap: boosted trees
score them by features of format and context, and thresholds calibrated on held-out rows select. Of
overlapping additions the one with the higher score stays, and none may touch a base span.

The trees are trained, once a session, on a labelled table that templates below span: TRAINING_ROWS
rows, three quarters to fit and the others to calibrate.

Defined results: a null text is empty and has no spans; repeated rows are searched each on its own;
an empty table gives an empty table; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keylink.sources.workspace import Workspace

TRAINING_ROWS = 2400
MIN_PRECISION = 0.97
CONTEXT = 24  # code points before a candidate that features look at

# The base formats. Possessive quantifiers and the anchors in front keep the time
# linear; neither changes a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The looser generators: kind and pattern.
LOOSE = {
    "local": ("phone", r"(?<![0-9+.-])\(?[0-9]{3,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])"),
    "written": (
        "email",
        r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{2,40}"
        r" ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,10}(?![A-Za-z0-9])",
    ),
    "secret": (
        "secret",
        r"(?i)(?<![a-z0-9])(?:token|secret|password|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_/+-]{8,200}\"?",
    ),
}
KINDS = ("email", "ip", "card", "phone", "secret")
_HINTS = r"(?i)(?:tel|phone|call|mobile|fax|contact|mail|write|reach|credential|login)"

# Templates of the labelled table: generator, text before, candidate (letters A-J become digits), label.
_TEMPLATES = [
    ("local", "call me at ", "(ABC) DEF-GHIJ", 1), ("local", "phone: ", "ABC-DEF-GHIJ", 1),
    ("local", "tel. ", "ABC.DEF.GHIJ", 1), ("local", "mobile ", "ABC DEF GHIJ", 1),
    ("local", "reach us on ", "ABC-DEF-GHIJ", 1), ("local", "fax ", "(ABC)DEF-GHIJ", 1),
    ("local", "pages ", "ABC-DEF GHIJ", 0), ("local", "order no. ", "ABC DEF GHIJ", 0),
    ("local", "the sum of ", "ABC DEF GHIJ", 0), ("local", "in the years ", "ABC-DEF-GHIJ", 0),
    ("local", "version ", "ABC.DEF.GHIJ", 0), ("local", "see ", "ABC DEF GHIJ", 0),
    ("written", "write to ", "userAB [at] mailC [dot] com", 1),
    ("written", "contact ", "nameAB (at) siteC (dot) org", 1),
    ("written", "mail ", "userAB at mailC dot net", 1),
    ("written", "look ", "there at home dot com", 0), ("written", "stay ", "calm at every dot on", 0),
    ("secret", "", "token = \"aAbBcCdDeEfFgGhHiIjJaAbB\"", 1),
    ("secret", "login ", "password: xA9BqC8DzE7F", 1), ("secret", "", "api_key=kABCDEFGHIJabcdef", 1),
    ("secret", "the ", "token: something", 0), ("secret", "a ", "secret: everything", 0),
    ("secret", "your ", "password = forgotten", 0), ("secret", "one ", "token=placeholder", 0),
]
_FEATURES = ["g0", "g1", "g2", "size", "digits", "letters", "marks", "spaces", "mixed", "hint", "bracket"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """For up to 19 digits."""
    number = F.transform(
        F.sequence(F.length(digits), F.lit(1)), lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    )

    def value(d: Column, i: Column) -> Column:
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(number, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, found: Column) -> Column:
    digits = _digits(found)
    n = F.length(digits)
    parts = F.transform(
        F.split(found, "[.]"), lambda p: F.coalesce(p.try_cast("long"), F.lit(999)) <= 255
    )
    card = (n >= 14) & (n <= 19)
    return (
        F.when(kind == "ip", F.forall(parts, lambda ok: ok))
        .when(kind == "card", card & F.when(card, _luhn(digits)).otherwise(False))
        .when(kind == "phone", (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def _matches(texts: DataFrame, label: str, pattern: str, needs: str) -> DataFrame:
    """_row, generator, begin, end, found, before of every match, for texts that have ``needs``."""
    some = texts.filter(F.col("_text").rlike(needs))
    matched = some.select(
        "_row",
        F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("m"),
        F.split("_text", pattern, -1).alias("p"),
    ).filter(F.size("m") > 0)
    # what lies between matches: its length, and the end of it as context
    between = F.transform("p", lambda x: F.struct(F.length(x).alias("n"), F.right(x, F.lit(CONTEXT)).alias("b")))
    rows = matched.select("_row", F.posexplode(F.arrays_zip("m", between.alias("b"))).alias("i", "x")).filter("x.m is not null")
    w = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("x.m")
    end = F.sum(F.col("x.b.n") + length).over(w)
    return rows.select(
        "_row", F.lit(label).alias("generator"), (end - length).alias("begin"), end.alias("end"),
        F.col("x.m").alias("found"), F.col("x.b.b").alias("before"),
    )


def _features(rows: DataFrame) -> DataFrame:
    found = F.col("found")
    count = lambda pattern: F.length(F.regexp_replace(found, pattern, "")).cast("double")
    assigned = F.regexp_extract(found, r"[=:]\s*\"?([^\"]*)", 1)
    values = [
        *[(F.col("generator") == g).cast("double") for g in LOOSE],
        F.length(found).cast("double"), count("[^0-9]"), count("[^A-Za-z]"), count("[A-Za-z0-9 ]"),
        count("[^ ]"),
        (assigned.rlike("[0-9]") & assigned.rlike("[A-Za-z]")).cast("double"),
        F.col("before").rlike(_HINTS).cast("double"), found.rlike(r"[\[(]").cast("double"),
    ]
    return rows.select("*", *[v.alias(n) for n, v in zip(_FEATURES, values, strict=True)])


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: each template with digits from a hash, in TRAINING_ROWS rows."""
    each = TRAINING_ROWS // len(_TEMPLATES)
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("generator"), F.lit(b).alias("before"), F.lit(t).alias("t"),
                F.lit(y).cast("double").alias("label"),
            )
            for g, b, t, y in _TEMPLATES
        ]
    )
    digits = F.substring(F.regexp_replace(F.sha2(F.concat_ws("|", "id", "x.t"), 256), "[^0-9]", ""), 1, 10)
    hinted = F.when(F.col("id") % 5 == 0, F.lit("and the ")).otherwise(F.col("x.before"))
    return spark.range(0, each, 1, 1).select("id", F.explode(rows).alias("x")).select(
        "id", "x.generator", hinted.alias("before"),
        F.call_function("translate", F.col("x.t"), F.lit("ABCDEFGHIJ"), digits).alias("found"),
        "x.label",
    )


_MODELS: dict[str, tuple] = {}


def model(spark: SparkSession):
    """The fitted trees and their threshold for each generator."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    session = spark.sparkContext.applicationId
    if session not in _MODELS:
        gather = VectorAssembler(inputCols=_FEATURES, outputCol="features")
        rows = gather.transform(_features(labelled(spark))).select("id", "generator", "label", "features")
        fitted = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=1).fit(rows.filter("id % 4 <> 0"))
        score = vector_to_array("probability")[1]
        held = fitted.transform(rows.filter("id % 4 = 0")).select("generator", "label", score.alias("p"))
        w = Window.partitionBy("generator").orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, 0)
        precise = held.withColumn("precision", F.avg("label").over(w)).filter(F.col("precision") >= MIN_PRECISION)
        limits = {r["generator"]: r["p"] for r in precise.groupBy("generator").agg(F.min("p").alias("p")).collect()}
        _MODELS[session] = (gather, fitted, limits)
    return _MODELS[session]


def _overlapping(spans: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of spans that share a place with a row of base in the same text. Base spans of one kind
    are disjoint, so each is looked up by the running maximum of ends on either side."""
    both = spans.select("*", F.lit(False).alias("is_base")).unionByName(
        base.select("*", F.lit(True).alias("is_base")), allowMissingColumns=True
    )
    up = Window.partitionBy("_row").orderBy("begin", F.col("is_base").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_row").orderBy("begin", F.col("is_base").desc()).rowsBetween(0, Window.unboundedFollowing)
    ends = F.max(F.when(F.col("is_base"), F.col("end"))).over(up)
    begins = F.min(F.when(F.col("is_base"), F.col("begin"))).over(down)
    return both.select("*", (F.coalesce(ends > F.col("begin"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))).alias("touches")).filter("not is_base")


def personal_spans(texts: DataFrame, space: Workspace) -> DataFrame:
    """_row, kind, begin, end, base for a table of _row and _text."""
    spark = texts.sparkSession
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{12}", "phone": r"\+[0-9]"}
    base = reduce(DataFrame.union, [_matches(texts, k, p, needs[k]) for k, p in BASE.items()])
    base = base.filter(_valid(F.col("generator"), F.col("found")))
    loose_needs = {"local": "[0-9]{3}", "written": r"(?i)dot", "secret": r"[=:]"}
    loose = reduce(DataFrame.union, [_matches(texts, g, p, loose_needs[g]) for g, (_, p) in LOOSE.items()])
    base = space.save(base.select("_row", F.col("generator").alias("kind"), "begin", "end"), "base")
    gather, fitted, limits = model(spark)
    from pyspark.ml.functions import vector_to_array

    scored = fitted.transform(gather.transform(_features(loose))).select(
        "_row", "generator", "begin", "end", vector_to_array("probability")[1].alias("p")
    )
    limit, kind = F.lit(2.0), F.lit(None).cast("string")
    for g, (k, _) in LOOSE.items():
        limit = F.when(F.col("generator") == g, float(limits.get(g, 2.0))).otherwise(limit)
        kind = F.when(F.col("generator") == g, k).otherwise(kind)
    chosen = scored.filter(F.col("p") >= limit).select("_row", kind.alias("kind"), "begin", "end", "p")
    free = _overlapping(chosen, base).filter("not touches").select("_row", "kind", "begin", "end", "p")
    # of additions that overlap, the first with the highest score of its run
    w = Window.partitionBy("_row").orderBy("begin", "end")
    run = F.when(F.col("begin") < F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    free = free.withColumn("new", run).withColumn("run", F.sum("new").over(w))
    best = Window.partitionBy("_row", "run").orderBy(F.col("p").desc(), "begin", "end", "kind")
    added = free.withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    return base.select("*", F.lit(True).alias("base")).union(
        added.select("_row", "kind", "begin", "end", F.lit(False).alias("base"))
    )


def _numbered(docs: DataFrame, text: str, own: list[str]) -> DataFrame:
    return docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )


def find_personal(
    docs: DataFrame, text: str = "text", with_text: bool = True, space: Workspace | None = None
) -> DataFrame:
    """Every row with n_email, n_ip, n_card, n_phone, ``spans`` (array of kind, begin, end, base by
    begin) and, with_text, ``redacted``: the text with [KIND] in place of each span."""
    space = space or Workspace(docs.sparkSession)
    out = ["n_email", "n_ip", "n_card", "n_phone", "spans"] + ["redacted"] * with_text
    own = [c for c in docs.columns if c not in out and (with_text or c != text)]
    rows = space.save(_numbered(docs, text, own), "rows")
    spans = space.save(personal_spans(rows.select("_row", "_text"), space), "spans")
    order = reduce(lambda a, k: F.when(F.col("kind") == k[1], k[0]).otherwise(a), enumerate(KINDS), F.lit(9))
    item = F.struct("begin", order.alias("o"), "kind", "end", "base")
    listed = spans.groupBy("_row").agg(
        *[F.count(F.when((F.col("kind") == k) & F.col("base"), 1)).alias(f"n_{k}") for k in KINDS[:4]],
        F.sort_array(F.collect_list(item)).alias("spans"),
    )
    shown = rows if with_text else rows.drop("_text")
    done = shown.join(listed.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left")
    none = F.array().cast(listed.schema["spans"].dataType)
    done = done.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in out[:4]} | {"spans": F.coalesce("spans", none)}
    )
    if with_text:
        done = done.withColumn("redacted", _redact(F.col("_text"), F.col("spans")))
    shape = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"), s["base"].alias("base")))
    done = done.withColumn("spans", shape)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *out)


def _redact(text: Column, spans: Column) -> Column:
    """Spans that overlap become one, named after the first."""
    def step(state: Column, s: Column) -> Column:
        apart = s["begin"] >= state["to"]
        piece = F.concat(
            F.substring(text, (state["to"] + 1).cast("int"), (s["begin"] - state["to"]).cast("int")),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        )
        return F.struct(
            F.greatest(state["to"], s["end"]).alias("to"),
            F.when(apart, F.array_append(state["parts"], piece)).otherwise(state["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<string>").alias("parts"))
    end = F.aggregate(spans, start, step)
    rest = F.substring(text, (end["to"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(end["parts"], ""), rest))


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
