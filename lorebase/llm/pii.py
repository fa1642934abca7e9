"""Personal data: patterns, and terms that give a protected entity away.

Base spans
    Email addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, each the leftmost
    matches that do not overlap, over the whole text. The expressions below match exactly what
    their plain forms in ``PLAIN`` match, but never go back over a run of characters, so a text
    of any shape takes time in proportion to its length.

Disclosure
    An entity is the normalised value of a base span. With n(c) documents that hold entity c,
    n(t) that hold term t, n(c,t) that hold t within ``REACH`` characters of c, and N documents,
    c's information is IC(c) = log2(N / n(c)) and t tells PMI(c,t) = log2(N n(c,t) / (n(c) n(t)))
    of it. A term discloses c if PMI(c,t) >= IC(c) / alpha: it is *generalised* where that holds
    for ``alpha_generalise`` and *removed* where it holds for ``alpha_remove`` (near 1: the term
    names the entity). Only evidence from ``support`` different surroundings counts, so the words
    around an address in copies of one text prove nothing. A term is marked wherever it occurs,
    with the entity in sight or not, but never inside a base span.

Counts cover all documents. Everything is DataFrame expressions; words are joined with the
disclosing terms, which are broadcast only if measured to be small.

Defined results: a null or empty text has no spans. Repeated rows get equal spans and count as
documents. Columns other than the id and the text are not read. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.frames import settled
from lorebase.session import broadcast_if_small, materialize

KINDS = ["email", "ip", "card", "phone"]
# The base expressions.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
STEADY = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"[^\x20\x09-\x0D]+"
EDGE = r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$"
REACH = 80
SUPPORT = 3
ALPHA_GENERALISE = 1.5
ALPHA_REMOVE = 1.05
_BLOCK = 128
_CHUNK = 256


def located(df: DataFrame, **found: str) -> DataFrame:
    """``df`` (with text) where each given column of matches becomes array<struct<value, start>>.

    ``found`` maps a column, all matches of a pattern in text, to that pattern. Splitting the text
    finds the same matches, and the lengths of pieces and matches add up to the places. Sums of
    blocks keep the running sums cheap for long arrays.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def each(make):
        return {f"{make.__name__}_{name}": make(name) for name in found}

    def gaps(name):
        return F.when(F.size(name) > 0, F.split("text", found[name], -1)).otherwise(F.array(F.lit("")))

    def steps(name):
        pieces = F.slice(f"gaps_{name}", F.lit(1), F.size(name))
        behind = F.concat(F.array(F.lit("")), F.slice(name, F.lit(1), F.greatest(F.size(name) - 1, F.lit(0))))
        return F.zip_with(pieces, F.slice(behind, F.lit(1), F.size(name)), lambda x, y: F.char_length(x) + F.char_length(y))

    def blocks(name):
        first = F.sequence(F.lit(0), F.floor(F.size(f"steps_{name}") / _BLOCK).cast("int"))
        return F.transform(first, lambda b: total(F.slice(f"steps_{name}", b * _BLOCK + 1, F.lit(_BLOCK))))

    def before(name):
        return F.transform(f"blocks_{name}", lambda _, b: total(F.slice(f"blocks_{name}", F.lit(1), b)))

    def starts(name):
        def here(_, i):
            block = F.floor(i / _BLOCK).cast("int")
            return F.get(f"before_{name}", block) + total(F.slice(f"steps_{name}", block * _BLOCK + 1, i - block * _BLOCK + 1))

        return F.transform(f"steps_{name}", here)

    def places(name):
        return F.transform(name, lambda m, i: F.struct(m.alias("value"), F.get(f"starts_{name}", i).alias("start")))

    out = df
    for make in (gaps, steps, blocks, before, starts, places):
        out = settled(out, **each(make))
    return out.select(*[c for c in df.columns if c not in found], *[F.col(f"places_{name}").alias(name) for name in found])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every other digit counts double."""
    each = F.split(F.reverse(number), "")

    def weigh(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.filter(each, lambda d: d != ""), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    size = F.char_length(digits(value))
    if kind == "card":
        return F.when(size.between(14, 19), luhn(digits(value))).otherwise(False)
    return size.between(10, 15) if kind == "phone" else F.lit(True)


def entity(kind: str, value: Column) -> Column:
    return digits(value) if kind in ("card", "phone") else F.lower(value)


def between(chunks: str, start: Column, end: Column) -> Column:
    """Characters [start, end) of the text whose pieces of ``_CHUNK`` characters are given; end - start is at most ``_CHUNK``."""
    k = F.floor(start / _CHUNK).cast("int")
    return F.substring(F.concat_ws("", F.get(chunks, k), F.get(chunks, k + 1)), start - k * _CHUNK + 1, end - start)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) plus spans: array<struct<start, order, end, kind, entity, before, after>>, sorted."""

    def keep(kind):
        return lambda m: passes(kind, m["value"])

    def as_span(kind, order):
        return lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"), (m["start"] + F.char_length(m["value"])).alias("end"), F.lit(kind).alias("kind"),
            entity(kind, m["value"]).alias("entity"),
        )

    def with_context(s):
        first = F.greatest(s["start"] - REACH - 1, F.lit(0))
        return F.struct(*[s[c].alias(c) for c in ("start", "order", "end", "kind", "entity")],
            between("chunks", first, s["start"]).alias("before"), between("chunks", s["end"], s["end"] + REACH + 1).alias("after"))

    out = settled(docs, **{f"_{k}": F.regexp_extract_all("text", F.lit(STEADY[k]), F.lit(0)) for k in KINDS})
    out = located(out, **{f"_{k}": STEADY[k] for k in KINDS})
    spans = [F.transform(F.filter(f"_{k}", keep(k)), as_span(k, n)) for n, k in enumerate(KINDS)]
    out = settled(out, bare=F.array_sort(F.concat(*spans))).drop(*[f"_{k}" for k in KINDS])
    chunks = F.when(F.size("bare") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{_CHUNK}}}+"), F.lit(0)))
    return settled(settled(out, chunks=chunks), spans=F.transform("bare", with_context)).drop("bare", "chunks")


def core(word: Column) -> Column:
    return F.regexp_replace(word, EDGE, "")


def terms(words: Column) -> Column:
    """The words that can be terms: all with a letter or number, lower case."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.lower(core(w))), lambda t: t != ""))


def context_terms(before: Column, after: Column) -> Column:
    """Whole words within ``REACH`` characters of a span, given one character more on either side; a word cut there does not count."""
    before = F.when(F.char_length(before) <= REACH, before).otherwise(F.regexp_replace(before, rf"^{WORD}", ""))
    after = F.when(F.char_length(after) <= REACH, after).otherwise(F.regexp_replace(after, rf"{WORD}$", ""))
    return terms(F.regexp_extract_all(F.concat_ws(" ", before, after), F.lit(WORD), F.lit(0)))


def disclosing_terms(
    found: DataFrame, support: int = SUPPORT, alpha_generalise: float = ALPHA_GENERALISE, alpha_remove: float = ALPHA_REMOVE
) -> tuple[DataFrame, DataFrame]:
    """(term, action, kind) of the terms that disclose an entity, and (mark, term) of the texts that hold them.

    Only terms that disclose, rare by nature, are looked up in the texts; the frequent words of the
    surroundings are told apart by counts of all words. ``found`` is a written table (doc_id, text, mark, spans) with spans from ``base_spans``.
    """
    rows = found.groupBy("mark").agg(F.count("*").alias("rows"))  # documents with one and the same text
    near = found.select("mark", F.explode("spans").alias("s")).select("mark", "s.kind", "s.entity", "s.before", "s.after")
    near = materialize(near.withColumn("surroundings", F.xxhash64("before", "after")), "pii-near")
    known = near.groupBy("kind", "entity").agg(F.count_distinct("surroundings").alias("seen")).filter(F.col("seen") >= support)
    with_entity = near.select("mark", "kind", "entity").distinct().join(rows, "mark").groupBy("kind", "entity").agg(F.sum("rows").alias("with_entity"))
    near = near.join(known.drop("seen"), ["kind", "entity"]).withColumn("term", F.explode(context_terms(F.col("before"), F.col("after"))))
    near = materialize(near.select("mark", "kind", "entity", "term", "surroundings").distinct(), "pii-contexts")
    pairs = near.groupBy("kind", "entity", "term").agg(F.count_distinct("surroundings").alias("seen")).filter(F.col("seen") >= support)
    both = near.select("mark", "kind", "entity", "term").distinct().join(rows, "mark").groupBy("kind", "entity", "term").agg(F.sum("rows").alias("both"))

    words = found.select("mark", F.explode(terms(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("term"))
    with_term = words.groupBy("term").agg(F.count("*").alias("with_term"))
    told = pairs.join(both, ["kind", "entity", "term"]).join(with_entity, ["kind", "entity"]).join(with_term, "term")
    share = F.col("both") / F.col("with_term")  # PMI = IC + log2 of this share
    information = F.log2(F.lit(float(max(found.count(), 1))) / F.col("with_entity"))
    told = told.withColumn("information", information).withColumn("pmi", information + F.log2(share)).filter("information > 0")
    action = F.when(F.col("pmi") * alpha_remove >= F.col("information"), 2).when(F.col("pmi") * alpha_generalise >= F.col("information"), 1)
    told = told.withColumn("action", action).filter("action IS NOT NULL")
    best = told.groupBy("term").agg(F.max(F.struct("action", "pmi", "kind")).alias("best"))
    best = best.select("term", F.when(F.col("best.action") == 2, "remove").otherwise("generalise").alias("action"), "best.kind")
    best = materialize(best, "pii-terms")
    return best, words.join(broadcast_if_small(best.select("term")), "term").distinct()


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, text, spans) for every row; spans: array<struct<start, end, kind, action>>, by start, then kind.

    The kind of a term's span is ``term``.
    """
    docs = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    found = materialize(base_spans(docs).withColumn("mark", F.xxhash64("text")), "pii-spans")
    told, held = disclosing_terms(found, **how)
    marked = held.join(told, "term").groupBy("mark").agg(F.collect_set(F.struct("term", "action")).alias("terms"))
    marked = materialize(marked, "pii-marked")
    joined = found.join(broadcast_if_small(marked), "mark", "left")

    words = F.when(F.col("terms").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    joined = located(settled(joined, words=words), words=WORD)
    skip = lambda w: F.char_length(F.regexp_extract(w, r"^[^\p{L}\p{N}]*+", 0))
    each = F.transform(
        "words",
        lambda w: F.struct(
            (w["start"] + skip(w["value"])).alias("start"), (w["start"] + skip(w["value"]) + F.char_length(core(w["value"]))).alias("end"),
            F.get(F.filter("terms", lambda t: t["term"] == F.lower(core(w["value"]))), F.lit(0))["action"].alias("action"),
        ),
    )
    joined = settled(joined, told=F.when(F.size("words") > 0, F.filter(each, lambda w: w["action"].isNotNull())))
    outside = F.filter("told", lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))

    def span(s, order, kind, action):
        return F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), kind.alias("kind"), action.alias("action"))

    every = F.concat(
        F.transform("spans", lambda s: span(s, s["order"], s["kind"], F.lit("remove"))),
        F.coalesce(F.transform(outside, lambda w: span(w, F.lit(len(KINDS)), F.lit("term"), w["action"])), F.array().cast("array<struct<start:int,order:int,end:int,kind:string,action:string>>")),
    )
    clean = F.transform(F.array_sort(every), lambda s: F.struct(s["start"], s["end"], s["kind"], s["action"]))
    return joined.select("doc_id", "text", clean.alias("spans"))


def sanitise(found: DataFrame) -> DataFrame:
    """(doc_id, text) with removed spans as ``[kind]`` and generalised terms as ``[word]`` or ``[number]``.

    Where spans overlap the first one counts, and the rest of the other one goes with it.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def add(done, s):
        value = F.substring("text", s["start"] + 1, s["end"] - s["start"])
        said = F.when(s["action"] == "generalise", F.when(value.rlike(r"\p{N}"), "[number]").otherwise("[word]"))
        said = F.coalesce(said, F.concat(F.lit("["), s["kind"], F.lit("]")))
        between = F.substring("text", done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        text = F.concat(done["text"], between, F.when(s["start"] >= done["at"], said).otherwise(""))
        return F.struct(text.alias("text"), F.greatest(done["at"], s["end"]).alias("at"))

    done = F.aggregate("spans", start, add, lambda d: F.concat(d["text"], F.substring("text", d["at"] + 1, F.char_length("text"))))
    return found.select("doc_id", done.alias("text"))


def span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
