"""Personal data and the terms that give it away, in DataFrame functions only.

Base spans (email, ip, card, phone) come from patterns. A term discloses a protected value e if
their pointwise mutual information over the corpus nears the information of e itself:
PMI(t; e) >= DISCLOSURE * IC(e), which is ln(n(t,e) / n(t)) >= -(1 - DISCLOSURE) * ln(N / n(e)).
All four are numbers of documents: N of all, n(e) and n(t) of those that have e or t, n(t,e) of those
that have both, wherever they stand in them. Terms are runs of letters outside of e-mail addresses. Those
that co-occur in at least SUPPORT distinct texts (copies alone are no evidence) and reach this are spans
of kind 'term' wherever they stand.

All of it is expressions over the row, but for the counts, which are pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, cut

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the kinds, with possessive quantifiers where nothing that follows could match less.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{4,}+"
#: Distinct texts a term needs, the share of the information that counts as disclosure.
SUPPORT, DISCLOSURE = 3, 0.9
#: Disclosed terms that are compared as a literal list; more are joined. Hash buckets of the join's first pass.
LIST, BUCKETS = 2_000, 65_536
_BLOCK, _CHUNK = 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column) -> Column:
    """Sums of an array of integers up to each element, in blocks so that long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def blocks(a: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(a, b * _BLOCK + 1, _BLOCK)))
        return let(each, lambda e: let(F.transform(e, lambda _, i: total(F.slice(e, F.lit(1), i))), lambda base: F.transform(a, lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int")) + total(F.slice(a, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1)))))

    return F.when(F.size(lengths) > 0, let(lengths, blocks)).otherwise(F.array().cast("array<bigint>"))


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def spans(text: Column, kind: str, pattern: str, holds: Callable[[Column], Column], guard: Column) -> Column:
    """Matches of ``pattern`` that ``holds`` accepts, with code points from start to end."""

    def of(found: Column) -> Column:
        def located(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
            return let(running(steps), lambda at: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("value"))))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: F.filter(located(gaps), lambda s: holds(s["value"])))).otherwise(F.array().cast(_SPAN))

    return F.when(guard, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Base spans of a text, by kind as listed and then by start."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    holds = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda v: F.length(digits(v)).between(13, 19) & F.call_function("luhn_check", digits(v)),
        "phone": lambda v: F.length(digits(v)).between(9, 15),
    }
    guards = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    return F.concat(*(spans(text, k, PATTERNS[k], holds[k], guards[k]) for k in KINDS))


def written(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def words(text: Column) -> Column:
    """Distinct terms of a text outside of e-mail addresses, the only base spans that hold letters."""
    return lowered(F.regexp_replace(text, PATTERNS["email"], " "))


def lowered(text: Column) -> Column:
    """Distinct terms of a text: found in it as it stands, and then lowered one by one."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosed_terms(found: DataFrame) -> DataFrame:
    """Terms (term) that disclose a value, from rows of text and base spans."""
    texts = found.where(F.size("base") > 0).withColumn("h", F.sha2("text", 256))
    own = F.array_distinct(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"))))
    values = cut(texts.select("h", F.explode(own).alias("s")).groupBy("h", "s.kind", "s.value").agg(F.count("*").alias("m")), "values")[0]
    each = values.groupBy("kind", "value").agg(F.sum("m").alias("n_e"), F.count("*").alias("texts")).where(f"texts >= {SUPPORT}").drop("texts")
    held = cut(values.join(each, ["kind", "value"]), "held")[0]
    if held.isEmpty():
        return held.select(F.col("value").alias("term"))
    # one row of each text that has such a value
    few = held.select("h").distinct()
    theirs = texts.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, "h", "left_semi").select("h", words(F.col("text")).alias("terms")).dropDuplicates(["h"])
    both = theirs.join(held, "h").select("kind", "value", "n_e", "m", F.explode("terms").alias("term")).groupBy("kind", "value", "term").agg(F.first("n_e").alias("n_e"), F.sum("m").alias("n_te"), F.count("*").alias("texts")).where(f"texts >= {SUPPORT}")
    both = cut(both, "pairs")[0]
    if both.isEmpty():
        return both.select("term")
    size = found.count()
    often = found.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    told = both.join(often, "term").where(F.log(F.col("n_te") / F.greatest("n_t", "n_te")) >= -(1 - DISCLOSURE) * F.log(F.lit(size) / F.col("n_e")))
    return told.select("term").distinct()


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Spans of the whole text of each row of ``docs`` (doc_id, text).

    Gives the columns named in ``keep`` (doc_id where none are named) and the text, ``base`` and
    ``terms`` (arrays of spans). A null or empty text has none. Rows are independent, so null
    ids and repeated rows stay; an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(*(F.col(c) for c in keep if c != "text"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    terms = cut(disclosed_terms(found), "terms")[0]
    none = F.array().cast(_SPAN)
    number = terms.count()
    if not number:
        return found.withColumn("terms", none)
    own = F.filter(spans(F.col("text"), "term", TERM, lambda v: F.lit(True), F.lit(True)), lambda s: F.array_contains(F.col("own"), F.lower(s["value"])))
    mine = lowered(F.col("text"))
    if number <= LIST:
        told = F.array(*(F.lit(r.term) for r in terms.collect()))
        found = found.withColumn("own", F.array_intersect(mine, told))
    else:
        # first by a hash bucket, of which there are BUCKETS at most, then exactly; equal texts are one row here
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
        some = F.broadcast(terms.select(bucket("term").alias("b")).distinct())
        rows = found.select(F.sha2("text", 256).alias("h"), F.explode(mine).alias("term")).withColumn("b", bucket("term")).join(some, "b", "left_semi").join(terms, "term", "left_semi")
        own_terms = rows.groupBy("h").agg(F.collect_set("term").alias("own"))
        found = found.withColumn("h", F.sha2("text", 256)).join(own_terms, "h", "left").drop("h").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    return found.withColumn("terms", F.when(F.size("own") > 0, own).otherwise(none)).drop("own")


def redacted(text: Column, of: Column) -> Column:
    """``text`` with its spans replaced by their kinds; spans that overlap become one."""
    merged = F.aggregate(
        F.array_sort(F.transform(of, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k")))),
        F.array().cast("array<struct<a:bigint,b:bigint,k:string>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["a"] < F.element_at(acc, -1)["b"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"), F.element_at(acc, -1)["k"].alias("k"))))).otherwise(F.concat(acc, F.array(s))),
    )

    def part(chunk: Column, i: Column, all_: Column) -> Column:
        at = i * _CHUNK
        here = F.filter(all_, lambda s: (s["a"] < at + F.length(chunk)) & (s["b"] > at))
        cut_ = lambda a, b: F.substring(chunk, F.greatest(a - at, F.lit(0)) + 1, F.greatest(b - F.greatest(a, at), F.lit(0)))
        done = F.aggregate(here, F.struct(at.cast("long").alias("to"), F.lit("").alias("out")), lambda acc, s: F.struct(s["b"].alias("to"), F.concat(acc["out"], cut_(acc["to"], s["a"]), F.when(s["a"] >= at, F.concat(F.lit("["), F.upper(s["k"]), F.lit("]"))).otherwise("")).alias("out")))
        return let(done, lambda d: F.concat(d["out"], cut_(d["to"], at + F.length(chunk))))

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return F.when(F.size(of) > 0, let(merged, lambda all_: F.array_join(F.transform(chunks, lambda c, i: part(c, i, all_)), ""))).otherwise(text)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced, and n_chars counted anew; a null text stays null."""
    cols = docs.columns
    found = personal_data(docs.withColumn("_null", F.col("text").isNull()), [c for c in cols if c != "text"] + ["_null"])
    clean = F.when(F.col("_null"), F.lit(None)).otherwise(redacted(F.col("text"), F.concat("base", "terms")))
    out = found.withColumn("text", clean)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in cols))
