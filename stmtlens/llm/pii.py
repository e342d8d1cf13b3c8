"""Personal data by weak supervision, with DataFrame operations only.

Patterns propose spans.  Those that pass the base rules (Luhn, digit counts, ranges) are always
kept; the others (numbers without a plus, short cards, spelled-out addresses, names after a title) are
kept if the classifier says so.  Three labelers vote on every span: a strict format, a gazetteer
(endings, number prefixes, reserved networks, first names) and the words around it; each says yes,
no or nothing.  Expectation-maximisation over the counts of vote patterns estimates, for each
kind, how reliable each labeler is, and gives every pattern a probability.  These are the labels on
which a naive Bayes classifier of the span's own features is trained over all spans.

Texts are read where they lie; only short rows of spans are shuffled.  The tables of patterns and
of feature weights are bounded by the code (kinds x votes, kinds x features x values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtlens.llm.common import table, written
from stmtlens.llm.quality import with_length

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone", "name")
#: Rounds of expectation-maximisation and the weight of its uniform prior.
ROUNDS, PRIOR = 8, 1.0
#: Characters of context on each side of a span.
AROUND = 40

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: (kind, base, pattern).  Possessive forms and look-behinds make the base patterns linear; they
#: match what the plain patterns of the same kinds match, leftmost and without overlap.
PATTERNS = (
    ("email", True, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", True, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{1,64}}+ ?[\[(]at[\])] ?{_LABEL}{{1,63}}+(?: ?(?:\.|[\[(]dot[\])]) ?{_LABEL}{{1,63}}+){{1,4}}+"),
    ("card", False, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])"),
    ("phone", False, r"(?<![0-9+./-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("name", False, r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Madame|Monsieur)\.? [A-ZÀ-Þ][a-zà-ÿ]{1,20}(?: [A-ZÀ-Þ][a-zà-ÿ]{1,20})?"),
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What a well-formed span of each kind looks like.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}+\.)++[A-Za-z]{2,10}$",
    "ip": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
    "name": r"^[A-Za-zñ]+\.? \S+ \S+$",
}
#: Endings of addresses, prefixes of card and telephone numbers, first names: known to be real.
GAZETTEER = {
    "email": r"(?i)\b(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|mx|ar|example)$",
    "ip": r"^(?:[1-9]|1[0-9]|[2-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))",
    "phone": r"^(?:\+(?:1|2[07]|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
    "name": r"(?i) (?:anna?|maria|marie|john|james|mary|peter|paul|thomas|michael|david|sarah|laura|julia|jean|pierre|claire|luc|hans|klaus|ute|jürgen|josé|juan|carlos|carmen|lucía|ana)\b",
}
#: What the gazetteer knows to be no personal data.
UNREAL = {
    "email": r"(?i)(?:^|@)(?:noreply|no-reply|postmaster|webmaster)\b",
    "ip": r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\.",
    "card": r"^0",
    "phone": r"^\+0",
    "name": r"(?i) (?:president|doctor|who)\b",
}
#: Words near a span that speak for it, and those that speak against it.
WORDS_FOR = {
    "email": r"(?i)e-?mail|contact|write|reach|correo|courriel|kontakt|@",
    "ip": r"(?i)\bip\b|address|host|server|login|client|from",
    "card": r"(?i)card|visa|master|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono|contact",
    "name": r"(?i)dear|regards|contact|sincerely|patient|signed",
}
WORDS_AGAINST = {
    "email": r"(?i)example of|placeholder",
    "ip": r"(?i)version|release|\bv\.?\s*$|section|chapter",
    "card": r"(?i)isbn|order|hash|token|\bid\b|serial|tracking",
    "phone": r"(?i)isbn|order|version|serial|invoice",
    "name": r"(?i)novel|film|character|chapter",
}
LABELERS = ("strict", "listed", "near")
FEATURES = ("length", "digits", "separators", "before", "after")


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _by_kind(tests: dict[str, str], value: Column) -> Column:
    out = F.lit(False)
    for kind, pattern in tests.items():
        out = F.when(F.col("kind") == kind, value.rlike(pattern)).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    turned = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        F.lit(0),
        lambda sum_, i: sum_ + F.when(i % 2 == 1, _digit(turned, i)).otherwise(
            _digit(turned, i) * 2 - F.when(_digit(turned, i) > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _digit(digits: Column, at: Column) -> Column:
    return F.coalesce(F.substring(digits, at, F.lit(1)).cast("int"), F.lit(0))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, d, kind, base, start, end, m, left, right): every span that a pattern proposes.

    ``base`` says that it passes the base rules.  Offsets count code points; the end is exclusive.
    Rows alike in key and text give their spans once.
    """
    rows = docs.select(F.col(key).alias("k"), _digest(F.col(text)).alias("d"), F.col(text).alias("t"))
    found = rows.select(
        "k", "d", "t", *(F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"m{i}") for i, (_, _, p) in enumerate(PATTERNS))
    )
    listed = []
    for i, (kind, base, pattern) in enumerate(PATTERNS):
        # What lies between the matches gives their places; only texts with a match are split.
        gaps = F.split("t", pattern, -1)
        spans = F.zip_with(
            F.zip_with(f"m{i}", F.slice(gaps, 2, F.size(gaps)), lambda m, after: F.struct(m.alias("m"), F.substring(after, 1, AROUND).alias("right"))),
            gaps,
            lambda span, before: F.struct(
                F.lit(i).alias("source"), F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                F.length(before).alias("gap"), span["m"].alias("m"), F.right(before, F.lit(AROUND)).alias("left"),
                span["right"].alias("right"),
            ),
        )
        spans = F.transform(
            F.filter(spans, lambda s: s["m"].isNotNull()),
            lambda s, n: F.struct(n.alias("n"), *(s[c].alias(c) for c in ("source", "kind", "base", "gap", "m", "left", "right"))),
        )
        listed.append(F.when(F.size(f"m{i}") > 0, spans))
    for i in range(len(listed)):
        listed[i] = F.coalesce(listed[i], F.array().cast(_SPANS))
    spans = found.select("k", "d", F.explode(F.concat(*listed)).alias("s")).select("k", "d", "s.*")
    spans = spans.dropDuplicates(["k", "d", "source", "n"])
    so_far = Window.partitionBy("k", "d", "source").orderBy("n")
    end = F.sum(F.col("gap") + F.length("m")).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    digits = F.regexp_replace("m", "[^0-9]", "")
    passes = (
        F.when(F.col("kind") == "ip", F.col("m").rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"))
        .when(F.col("kind") == "card", _luhn(digits))
        .when(F.col("kind") == "phone", F.length(digits).between(8, 15))
        .otherwise(F.lit(True))
    )
    spans = spans.filter(passes)
    # A span beside the base ones counts only where no base span lies.
    before = Window.partitionBy("k", "d").orderBy("start", "end", "source")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(before.rowsBetween(1, Window.unboundedFollowing))
    clear = F.col("base") | (
        (F.coalesce(base_end, F.lit(-1)) <= F.col("start"))
        & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    )
    return spans.withColumn("_clear", clear).filter("_clear").select(
        "k", "d", "kind", "base", "start", "end", "m", "left", "right"
    )


_SPANS = "array<struct<n:int,source:int,kind:string,base:boolean,gap:int,m:string,left:string,right:string>>"


def labelled(spans: DataFrame) -> DataFrame:
    """The spans with the votes of the labelers (1, 0, -1) and the features of the classifier."""
    size = F.length("m")
    digits = F.length(F.regexp_replace("m", "[^0-9]", ""))
    return spans.withColumns(
        {
            "strict": F.when(_by_kind(STRICT, F.col("m")), 1).otherwise(-1),
            "listed": F.when(_by_kind(UNREAL, F.col("m")), -1).when(_by_kind(GAZETTEER, F.col("m")), 1).otherwise(0),
            "near": F.when(_by_kind(WORDS_AGAINST, F.col("left")), -1)
            .when(_by_kind(WORDS_FOR, F.concat_ws(" ", "left", "right")), 1).otherwise(0),
            "length": F.least(size / 4, F.lit(12)).cast("int"),
            "digits": (digits * 4 / size).cast("int"),
            "separators": F.least(F.length(F.regexp_replace("m", r"[\w]", "")), F.lit(6)).cast("int"),
            "before": F.when(F.col("left") == "", 0).when(F.col("left").rlike(r"\s$"), 1)
            .when(F.col("left").rlike(r"[(\[<\"':=]$"), 2).otherwise(3),
            "after": F.when(F.col("right") == "", 0).when(F.col("right").rlike(r"^\s"), 1)
            .when(F.col("right").rlike(r"^[)\]>\"',;.!?]"), 2).otherwise(3),
        }
    )


def reliabilities(spans: DataFrame) -> DataFrame:
    """(kind, votes..., p): the probability of each vote pattern after expectation-maximisation.

    The table has a row for each kind and pattern (at most 5 x 27), so its windows run in one task.
    """
    counts = written(spans.groupBy("kind", *LABELERS).agg(F.count("*").cast("double").alias("n")), "votes")
    table_ = counts.coalesce(1).withColumn("p", 1 / (1 + F.exp(-1.5 * sum(F.col(v) for v in LABELERS))))
    kind = Window.partitionBy("kind")
    for _ in range(ROUNDS):
        table_ = table_.withColumns({"yes": F.col("n") * F.col("p"), "no": F.col("n") * (1 - F.col("p"))})
        table_ = table_.withColumns({"all_yes": F.sum("yes").over(kind), "all_no": F.sum("no").over(kind)})
        odds = F.log((F.col("all_yes") + PRIOR) / (F.col("all_no") + PRIOR))
        for vote in LABELERS:
            own = Window.partitionBy("kind", vote)
            table_ = table_.withColumns({f"{vote}_yes": F.sum("yes").over(own), f"{vote}_no": F.sum("no").over(own)})
            odds += F.log((F.col(f"{vote}_yes") + PRIOR) / (F.col("all_yes") + 3 * PRIOR))
            odds -= F.log((F.col(f"{vote}_no") + PRIOR) / (F.col("all_no") + 3 * PRIOR))
        table_ = table_.select("kind", *LABELERS, "n", (1 / (1 + F.exp(-odds))).alias("p"))
    return written(table_, "reliabilities")


def classified(spans: DataFrame) -> DataFrame:
    """The spans with ``logit``, the classifier's log odds, trained on the labelers' probabilities."""
    spans = written(labelled(spans), "spans")
    judged = spans.join(F.broadcast(reliabilities(spans).drop("n")), ["kind", *LABELERS])
    values = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES))
    sums = judged.select("kind", "p", F.explode(values).alias("f")).groupBy("kind", "f.feature", "f.value").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")
    )
    weights = written(sums, "weights").coalesce(1)
    whole = Window.partitionBy("kind", "feature")
    weights = written(
        weights.withColumns({"all_yes": F.sum("yes").over(whole), "all_no": F.sum("no").over(whole), "values": F.count("*").over(whole)})
        .select(
            "kind", "feature", "value",
            (
                F.log((F.col("yes") + PRIOR) / (F.col("all_yes") + F.col("values") * PRIOR))
                - F.log((F.col("no") + PRIOR) / (F.col("all_no") + F.col("values") * PRIOR))
            ).alias("weight"),
            F.log((F.col("all_yes") + PRIOR) / (F.col("all_no") + PRIOR)).alias("odds"),
        ),
        "weights",
    )
    logit = F.lit(0.0)
    for feature in FEATURES:
        own = weights.filter(F.col("feature") == feature).select(
            F.col("kind"), F.col("value").alias(feature), F.col("weight").alias(f"w_{feature}"), F.col("odds").alias(f"o_{feature}")
        )
        spans = spans.join(F.broadcast(own), ["kind", feature], "left")
        logit = logit + F.coalesce(f"w_{feature}", F.lit(0.0))
    return spans.withColumn("logit", logit + F.coalesce(f"o_{FEATURES[0]}", F.lit(0.0)))


def _count(spans: str, kind: str) -> Column:
    """How many spans are of a kind; null where the list is."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + (s["kind"] == kind).cast("int"))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, d, kind, base, start, end, logit): all spans kept, in any order.

    ``k`` and ``d`` are the key and the digest of the text; rows alike in both share their spans.
    """
    spans = classified(candidates(docs, key, text))
    return spans.filter(F.col("base") | (F.col("logit") > 0)).select(
        "k", "d", "kind", "base", "start", "end", "logit"
    )


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, the digest of the base spans, and all spans.

    A null or empty text has no spans; null keys and repeated rows keep a row each; other columns
    are not read; an empty table gives an empty result.  A document's spans are bounded by its text.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    found = find_pii(docs, key, text).groupBy("k", "d").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(F.collect_list(span)).alias("all"),
    )
    found = written(found, "found")
    rows = docs.select(F.col(key).alias("_k"), _digest(F.col(text)).alias("_d"))
    joined = rows.join(found, F.col("_k").eqNullSafe(F.col("k")) & (F.col("_d") == F.col("d")), "left")
    counts = [F.coalesce(_count("base", kind), F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in KINDS[:4]]
    return joined.select(
        F.col("_k").alias(key), *counts,
        F.sha2(F.coalesce(_joined("base"), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_joined("all"), F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans by the first's.

    All columns and rows stay; a null text stays null.
    """
    found = find_pii(docs, key, text).groupBy(F.col("k").alias("_llm_k"), F.col("d").alias("_llm_d")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_llm_spans")
    )
    found = written(found, "found")
    # A merge at every size: what could be broadcast grows with the documents.
    joined = docs.withColumn("_llm_digest", _digest(F.col(text))).join(
        found.hint("merge"), docs[key].eqNullSafe(F.col("_llm_k")) & (F.col("_llm_digest") == F.col("_llm_d")), "left"
    )
    whole = F.col(text)
    begun = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done, span):
        clear = span["start"] >= done["at"]
        kept = F.substring(whole, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        out = F.when(clear, F.concat(done["out"], kept, F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), out.alias("out"))

    rebuilt = F.aggregate(
        "_llm_spans", begun, step,
        lambda done: F.concat(done["out"], F.substring(whole, (done["at"] + 1).cast("int"), F.length(whole))),
    )
    fresh = F.when(F.col("_llm_spans").isNull(), whole).otherwise(rebuilt)
    return with_length(
        joined.select(*(fresh.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns)), text
    )


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_spans(table(spark, folder, "documents"))
