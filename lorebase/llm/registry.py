"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- line deduplication --------------------------------------------------------------------


@query
def op9_line_dedup(spark, sf_dir):
    from lorebase.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, i, line, keeper IS NOT NULL AND doc_id < keeper AS gone
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


# -- toxicity ------------------------------------------------------------------------------


@query
def op2_toxicity(spark, sf_dir):
    from lorebase.llm import toxicity as tox

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~tox.held_out(F.col("doc_id")))
    scored = docs.withColumn("score", tox.score_column(tox.fit(docs, labels), F.col("text")))
    predicted = (F.col("score") >= tox.THRESHOLD).cast("int")
    return scored.select("doc_id", tox.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


# -- n-gram Jaccard join -------------------------------------------------------------------


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    from lorebase.llm.ngram_join import linked_components

    return linked_components(table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_jaccard_join"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                             WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g
  FROM words),
sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 90 * (p.n + q.n - i)),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""


# -- byte-level BPE ------------------------------------------------------------------------


@query
def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from lorebase.llm import bpe

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, *how, and_decode=True).select("doc_id", *bpe.digests())


# -- benchmark decontamination -------------------------------------------------------------


@query
def op10_benchmark_decontamination(spark, sf_dir):
    from lorebase.llm.decontaminate import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_covered", F.size("tiles").cast("long").alias("n_tiles"))


# -- repeated substrings -------------------------------------------------------------------


@query
def op6_suffix_array_dedup(spark, sf_dir):
    from lorebase.llm.substring_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_suffix_array_dedup"] = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
size AS (SELECT doc_id, b, octet_length(b) AS n FROM raw),
starts AS (
  SELECT doc_id, p, md5(b[p:p + 399]) AS h
  FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS p FROM size WHERE n >= 400)),
twice AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, p FROM starts SEMI JOIN twice USING (h)),
edges AS (SELECT *, p > lag(p) OVER w + 400 OR lag(p) OVER w IS NULL AS fresh FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, z, lag(z, 1, 1) OVER w AS before, lead(a) OVER w AS after FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
cut AS (
  SELECT g.doc_id, sum(z - a) AS removed, count(*) AS spans,
         string_agg(hex(b[before:a - 1]) || CASE WHEN after IS NULL THEN hex(b[z:n]) ELSE '' END, '' ORDER BY a) AS kept
  FROM gaps g JOIN size USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM size LEFT JOIN cut USING (doc_id)
"""


# -- quality rules -------------------------------------------------------------------------


@query
def op4_quality_rules(spark, sf_dir):
    from lorebase.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


# -- personal data -------------------------------------------------------------------------


@query
def op1_pii(spark, sf_dir):
    from lorebase.llm import pii

    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


# -- licences ------------------------------------------------------------------------------


@query
def op3_license_scan(spark, sf_dir):
    from lorebase.llm import licences

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.notices(docs, licences.fit(docs))


# -- token counts --------------------------------------------------------------------------


@query
def op7_token_counts(spark, sf_dir):
    """Counts before and after three edits of every document: its source put in front, 20 characters
    of its middle replaced by its language, and its last 10 characters deleted."""
    import public_tokenizers

    from lorebase.llm import token_counts
    from lorebase.session import materialize

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = F.char_length(F.coalesce("text", F.lit("")))

    def step(seq, start, end, said):
        return F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), said.alias("replacement"))

    steps = F.array(
        step(1, F.lit(0), F.lit(0), F.concat("source", F.lit(": "))), step(2, size / 2, size / 2 + 20, F.col("lang")),
        step(3, size - 10, size, F.lit("")),
    )
    edits = docs.select("doc_id", F.explode(steps).alias("s")).select("doc_id", "s.*")
    state = materialize(token_counts.count_tokens(docs, *how), "token-state")
    return token_counts.recount(docs, state, edits, *how).select("doc_id", "n_before", "n_tokens", "n_read")


# -- fill in the middle --------------------------------------------------------------------


@query
def op12_fill_in_middle(spark, sf_dir):
    from lorebase.llm import fill_middle

    done = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op12_fill_in_middle"] = """
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w
  FROM documents),
picks AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM tokens),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM picks),
parts AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s
  FROM cuts)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


# -- exact top-k search --------------------------------------------------------------------


@query
def op13_exact_top_k(spark, sf_dir):
    from lorebase.llm import impact_search

    vectors = table(spark, sf_dir, "embeddings")
    return impact_search.top_k(impact_search.build_index(vectors), vectors.filter("vec_id % 100 = 0"))


ORACLES["op13_exact_top_k"] = """
WITH whole AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


# -- phrases -------------------------------------------------------------------------------


@query
def op11_phrase_collocations(spark, sf_dir):
    from lorebase.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = """
WITH lower AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lower),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, w, unnest(range(1, k)) AS cut FROM often WHERE k >= 2),
parts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, p.f AS l, r.f AS r, n,
         ((1000::HUGEINT * c.a * n) // (p.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN often p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT DISTINCT o.lang, o.f AS longer, array_to_string(o.w[i:i + size - 1], ' ') AS phrase
  FROM often o, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(2, 5)) AS size)
  WHERE size < o.k AND i + size - 1 <= o.k),
inside AS (SELECT lang, phrase, max(longer) AS longer FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * l.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
