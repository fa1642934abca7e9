"""The registered queries in SQL over the same tables."""

from __future__ import annotations

KB = """
kb AS (
  SELECT 'doc://' || source || '/' || d.doc_id AS url,
         'Document ' || d.doc_id AS title,
         '' AS description,
         text AS content,
         sha256(text) AS checksum,
         CASE WHEN d.doc_id > 0 AND d.doc_id % 17 = 0 THEN e.embedding[1:32]
              WHEN d.doc_id > 0 AND d.doc_id % 23 = 0 THEN list_transform(e.embedding, lambda v: 0::FLOAT)
              ELSE e.embedding END AS embeddings,
         CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE lang END AS context,
         CASE WHEN d.doc_id % 2 = 0 THEN 'web_scrape' ELSE 'file_read' END AS source_type
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

def dot(a: str, b: str) -> str:
    products = f"list_transform(list_zip({a}, {b}), lambda p: (p[1] * p[2])::DOUBLE)"
    return f"list_reduce(list_prepend(0.0::DOUBLE, {products}), lambda s, v: s + v)"


def cosine(a: str, b: str) -> str:
    na, nb = f"sqrt({dot(a, a)})", f"sqrt({dot(b, b)})"
    return f"CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE {dot(a, b)} / ({na} * {nb}) END"


VECTOR = f"""coalesce(len(embeddings), 0) AS embeddings, embeddings[1]::DOUBLE AS vector_first,
          embeddings[len(embeddings)]::DOUBLE AS vector_last, CASE WHEN len(embeddings) > 0 THEN {dot("embeddings", "embeddings")} END AS vector_square"""
NO_VECTOR = "0 AS embeddings, NULL AS vector_first, NULL AS vector_last, NULL AS vector_square"
FLAT = f"url, title, description, content, checksum, {VECTOR}, context, source_type"

SCORED = f"""
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
scored AS (SELECT kb.*, {cosine("q", "embeddings")} AS score FROM kb, q WHERE len(embeddings) = len(q)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, url) AS rank FROM scored)"""

PAIRS = f"""
docs AS (SELECT url, embeddings AS d, sqrt({dot("embeddings", "embeddings")}) AS nd FROM kb WHERE len(embeddings) > 0),
asked AS (SELECT vec_id AS query_id, embedding AS q, sqrt({dot("embedding", "embedding")}) AS nq FROM embeddings),
scored AS (SELECT query_id, url,
                  CASE WHEN nq = 0 OR nd = 0 THEN 0.0 ELSE {dot("q", "d")} / (nq * nd) END AS score
           FROM asked, docs WHERE len(q) = len(d)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM scored"""

BATCH = f"""
again AS (SELECT d.*, seq FROM documents d JOIN labels l USING (doc_id), (VALUES (1), (2)) v(seq)),
batch AS (
  SELECT 'doc://' || source || '/' || doc_id AS url, 'Version ' || seq AS title, text || ' v' || seq AS content,
         'moved' AS context, seq FROM again
  UNION ALL
  SELECT 'conv://' || conv_id || '/' || turn, role, text, 'talk', 1 FROM conversations),
latest AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
merged AS (
  SELECT {FLAT} FROM kb WHERE url NOT IN (SELECT url FROM latest)
  UNION ALL
  SELECT url, title, '', content, sha256(content), {NO_VECTOR}, context, '' FROM latest)"""

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def like(prefix: str) -> str:
    return f"translate(url, {FOLD}) LIKE translate('{prefix}', {FOLD}) || '%'"


def plain(text: str) -> str:
    """Decode the references that occur in the pages."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        text = f"replace({text}, '{name}', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"


def escape(text: str) -> str:
    special = f"regexp_replace({squeeze(plain(text))}, '([\\\\`*_\\[\\]<])', '\\\\\\1', 'g')"
    return f"regexp_replace({special}, '&(#?[0-9A-Za-z_]+;)', '\\\\&\\1', 'g')"


def line(text: str) -> str:
    marked = f"regexp_replace({escape(text)}, '^([#>+~=-])', '\\\\\\1')"
    return f"regexp_replace({marked}, '^([0-9]+)([.)])', '\\1\\\\\\2')"


def bold(text: str) -> str:
    return f"CASE WHEN {escape(text)} = '' THEN '' ELSE '**' || {escape(text)} || '**' END"


def untag(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]*>', '', 'g')"


def bullets(region: str, mark: str) -> str:
    item = "'<li><a href=\"([^\"]*)\">([^<]*)</a>'"
    pairs = f"list_zip(regexp_extract_all({region}, {item}, 1), regexp_extract_all({region}, {item}, 2))"
    shown = f"'- [{mark}' || {escape('p[2]')} || '{mark}](' || {plain('p[1]')} || ')'"
    return f"array_to_string(list_transform({pairs}, lambda p: {shown}), chr(10))"


def parsed(source: str) -> str:
    """Outputs of page parsing over a table with url and html, for the grammar of these pages."""
    return f"""
parts AS (
  SELECT *, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS t,
         regexp_extract(html, '<article>(.*)</article>', 1, 's') AS art,
         regexp_extract(html, '<nav>.*?</nav>', 0, 's') AS nav,
         regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad,
         regexp_extract(html, '<footer>(.*?)</footer>', 1, 's') AS foot,
         regexp_extract(html, '</footer>.*', 0, 's') AS tail
  FROM {source}),
pieces AS (
  SELECT *, regexp_extract(art, '<h1>(.*?)</h1>', 1, 's') AS h1, string_split(art, '<p>')[2:] AS ps FROM parts),
parsed AS (
  SELECT * EXCLUDE (t), {plain("t")} AS title, '' AS description,
         {squeeze(plain("regexp_replace(art, '<[^>]*>', ' ', 'g')"))} AS main_text,
         array_to_string(list_filter(list_concat(
           [{bullets("nav", "")}, {line("ad")}, CASE WHEN h1 = '' THEN '' ELSE '# ' || {escape("h1")} END],
           list_transform(ps, lambda p, i: CASE
             WHEN len(list_filter(ps[1:i], lambda y: contains(y, '<b>'))) > 0 THEN {bold(untag("p"))}
             ELSE {line(untag("p"))} END),
           [{bold("foot")}, {bullets("tail", "**")}]), lambda s: s <> ''), chr(10) || chr(10)) AS markdown,
         regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs
  FROM pieces)"""


PAGES = parsed("pages")

RANKED = """
numbered AS (
  SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
         row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) ORDER BY page_id) - 1 AS rank
  FROM pages),
-- cap: the page whose capture answers a request for this url, which has no fragment
ranked AS (
  SELECT *, arg_max(rank, url) OVER (PARTITION BY host, split_part(url, '#', 1)) AS cap FROM numbered),
links AS (
  SELECT a.page_id, a.host, a.rank AS src, b.rank AS dst, n, b.url AS dst_url
  FROM ranked a, LATERAL (VALUES (0, 2*a.rank+1), (1, 2*a.rank+2), (2, 0), (3, 3*a.rank+2)) v(n, dst)
  JOIN ranked b ON b.host = a.host AND b.rank = v.dst),
linked AS (
  SELECT r.page_id, r.url, r.host, r.rank, html || '<ul>' || coalesce(items, '')
         || '<li><a href="https://elsewhere.invalid/">away</a></li></ul>' AS html
  FROM ranked r LEFT JOIN (
    SELECT page_id, string_agg('<li><a href="' || replace(dst_url, '&', '&amp;') || '">page ' || dst || '</a></li>',
                               '' ORDER BY n) AS items
    FROM links GROUP BY page_id) USING (page_id))"""


def walk(max_depth: int) -> str:
    return f"""
{RANKED},
steps(host, rank, depth) AS (
  SELECT host, rank, 0 FROM ranked WHERE rank = 0
  UNION
  SELECT s.host, l.dst, s.depth + 1 FROM steps s JOIN ranked r ON r.host = s.host AND r.rank = s.rank
  JOIN links l ON l.host = s.host AND l.src = r.cap
  WHERE s.depth < {max_depth}),
reached AS (
  SELECT base.url AS base_url, r.url, r.host, r.cap, base.cap AS base_cap, min(depth)::INTEGER AS depth,
         coalesce(nullif(regexp_extract(r.url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path
  FROM steps s JOIN ranked r USING (host, rank) JOIN ranked base ON base.host = s.host AND base.rank = 0
  GROUP BY ALL),
last AS (
  SELECT * FROM reached
  QUALIFY row_number() OVER (PARTITION BY base_url, path ORDER BY depth DESC, url DESC) = 1)"""


FETCH = """
SELECT host, arrival, id,
       i * 3600000000 + max(arrival - i * 3600000000) OVER (PARTITION BY host ORDER BY arrival, id
                                                             ROWS UNBOUNDED PRECEDING) AS start
FROM (SELECT user_id AS host, epoch_us(ts) AS arrival, event_id AS id,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""


def hashed(source: str) -> str:
    """Components of the hashing embedder for every text of source(id, text), as vecs(id, pos, value)."""
    return f"""
chars AS (SELECT id, list_transform(string_split(' ' || text || ' ', ''), lambda c: unicode(c)::BIGINT) AS c
          FROM {source} WHERE text <> ''),
hits AS (SELECT id, unnest(list_transform(range(1, len(c) - 1),
                lambda i: (c[i] * 7 + c[i + 1] * 31 + c[i + 2] * 131) % 128)) AS h FROM chars),
sums AS (SELECT id, (h % 64)::INTEGER AS pos, sum(CASE WHEN h < 64 THEN 1 ELSE -1 END)::DOUBLE AS v
         FROM hits GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(v * v)) AS n FROM sums GROUP BY id),
vecs AS (SELECT id, pos, coalesce(v / n, 0)::FLOAT AS value
         FROM norms CROSS JOIN (SELECT unnest(range(64))::INTEGER AS pos) LEFT JOIN sums USING (id, pos))"""


def embedded(source: str) -> str:
    """The same vectors as lists, as vectors(id, embeddings)."""
    return f"{hashed(source)}, vectors AS (SELECT id, list(value ORDER BY pos) AS embeddings FROM vecs GROUP BY id)"


TURN_URL = "'conv://' || conv_id || '/' || turn"
FILES = f"""WITH src AS (SELECT 'key=' || doc_id % 300 AS id, string_agg(text || chr(10), '' ORDER BY doc_id) AS text
                     FROM documents GROUP BY 1), {embedded("src")}
            SELECT id AS place, text AS content, sha256(text) AS checksum, {VECTOR}, 'files' AS context, 'file_read' AS source_type
            FROM src JOIN vectors USING (id)"""
# Every document as a file of its own.
SINGLE_FILES = f"""WITH src AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce('key=' || doc_id % 300, '') AS place,
                                         coalesce(text, '') || chr(10) AS text FROM documents), {embedded("src")}
            SELECT place, text AS content, sha256(text) AS checksum, {VECTOR}, 'files' AS context, 'file_read' AS source_type
            FROM src JOIN vectors USING (id)"""
# What becomes of the vector texts of the exchange table, by document.
EXCHANGED = f"""{KB},
numbered AS (SELECT * EXCLUDE (embeddings), embeddings AS e, title[10:]::BIGINT AS id FROM kb),
read AS (
  SELECT * EXCLUDE (e), CASE WHEN id % 13 = 0 THEN NULL WHEN id % 31 = 0 AND id % 19 <> 0 AND id % 29 <> 0 THEN [] ELSE e END AS embeddings,
         id % 13 <> 0 AND (id % 19 = 0 OR id % 29 = 0 OR (id % 37 = 0 AND id % 31 <> 0)) AS broken FROM numbered)"""

ORACLES: dict[str, str] = {
    "kb_scan": f"WITH {KB} SELECT {FLAT} FROM kb",
    "kb_context_filter": f"WITH {KB} SELECT {FLAT} FROM kb WHERE context = 'en'",
    "kb_list_limit": f"WITH {KB} SELECT {FLAT} FROM kb WHERE context = 'fr' ORDER BY url LIMIT 25",
    "kb_page": f"WITH {KB} SELECT {FLAT} FROM kb ORDER BY url LIMIT 20 OFFSET 30",
    "kb_page_total": f"WITH {KB} SELECT count(*) AS total FROM kb WHERE context = 'en'",
    "kb_get_document": f"WITH {KB} SELECT {FLAT} FROM kb WHERE url = 'doc://src3/3'",
    "kb_contexts": f"WITH {KB} SELECT DISTINCT context FROM kb WHERE context <> ''",
    "list_report": f"""WITH {KB} SELECT url, source_type, checksum, strlen(content) AS content_length,
        coalesce(len(embeddings), 0) AS embeddings_length FROM kb""",
    "document_output": f"WITH {KB} SELECT url, title, description, content, checksum FROM kb",
    "json_rows": f"""WITH {KB} SELECT to_json(struct_pack(url := url, title := title, description := description,
        content := content, checksum := checksum))::VARCHAR AS json FROM kb""",
    "json_documents": f"WITH {KB} SELECT {FLAT} FROM kb",
    "json_page": f"""WITH {KB} SELECT {FLAT}, (SELECT count(*) FROM kb WHERE context = 'en') AS total
        FROM kb WHERE context = 'en' ORDER BY url LIMIT 20 OFFSET 30""",
    "json_hits": f"WITH {KB}, {SCORED} SELECT url, title, description, content, checksum, score FROM ranked WHERE rank <= 10",
    "search_topn": f"WITH {KB}, {SCORED} SELECT url, score, rank FROM ranked WHERE rank <= 10",
    "search_context": f"""WITH {KB}, {SCORED} SELECT url, score, row_number() OVER (ORDER BY rank) AS rank
        FROM ranked WHERE context = 'de' ORDER BY rank LIMIT 5""",
    "search_skips": f"""WITH {KB}, {SCORED} SELECT CASE WHEN coalesce(len(embeddings), 0) = 0 THEN 'empty'
        WHEN len(embeddings) <> len(q) THEN 'length' ELSE 'scored' END AS reason, count(*) AS n_docs
        FROM kb, q GROUP BY reason""",
    "search_output": f"""WITH {KB}, {SCORED} SELECT url, title, description, content, checksum, score, rank
        FROM ranked WHERE rank <= 3""",
    "search_report": f"""WITH {KB}, {SCORED} SELECT rank, url, printf('%.4f', score) AS score, title, description
        FROM ranked WHERE rank <= 3""",
    "search_batch_topk": f"WITH {KB}, {PAIRS}) SELECT query_id, url, score, rank FROM ranked WHERE rank <= 5",
    "search_batch_threshold": f"""WITH {KB}, {PAIRS} WHERE score >= 0.25)
        SELECT query_id, url, score, rank FROM ranked WHERE rank <= 8""",
    "search_batch_grid": f"WITH {KB}, {PAIRS}) SELECT query_id, url, score, rank FROM ranked WHERE rank <= 5",
    "search_batch_wide": f"""WITH {KB}, {PAIRS} WHERE query_id % 10 = 0)
        SELECT query_id, url, score, rank FROM ranked WHERE rank <= 1500""",
    "cosine_pairs": f"""SELECT a.vec_id, {cosine("a.embedding", "b.embedding")} AS score
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "embedding_json_roundtrip": f"""
        WITH said AS (SELECT vec_id, vec_id % 7 <> 0 AND (vec_id % 11 = 0 OR vec_id % 13 = 0 OR vec_id % 17 = 0) AS broken,
                             CASE WHEN vec_id % 7 <> 0 THEN embedding END AS e FROM embeddings)
        SELECT vec_id, CASE WHEN NOT broken THEN coalesce(len(e), 0) END AS length, CASE WHEN NOT broken AND e IS NOT NULL THEN {dot("e", "e")} END AS square,
               CASE WHEN NOT broken THEN e IS NOT NULL END AS same, NOT broken AS readable FROM said""",
    "import_table": f"""WITH {EXCHANGED} SELECT {FLAT}, NULL::VARCHAR AS error FROM read WHERE NOT broken
        UNION ALL SELECT url, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'failed to read vector' FROM read WHERE broken""",
    "export_table": f"WITH {KB} SELECT {FLAT} FROM kb",
    "upsert_lastwins": f"WITH {KB}, {BATCH} SELECT * FROM merged",
    "upsert_moves_context": f"WITH {KB}, {BATCH} SELECT context, count(*) AS n_docs FROM merged GROUP BY context",
    "delete_prefix": f"WITH {KB} SELECT {FLAT} FROM kb WHERE NOT {like('DOC://src1')}",
    "delete_prefix_context": f"WITH {KB} SELECT {FLAT} FROM kb WHERE NOT ({like('doc://src1')} AND context = 'en')",
    "delete_wildcard": f"WITH {KB} SELECT {FLAT} FROM kb WHERE NOT {like('doc://src1_/')}",
    "clean": f"""WITH {KB} SELECT 'before' AS stage, url, checksum FROM kb
        UNION ALL SELECT 'after', url, checksum FROM kb WHERE context = 'en'""",
    "checksums": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "kb_store": f"""WITH {KB}, {BATCH} SELECT {FLAT} FROM kb
        WHERE NOT starts_with(url, 'doc://src1/') AND url NOT IN (SELECT url FROM latest)
        UNION ALL SELECT url, title, '', content, sha256(content), {NO_VECTOR}, context, '' FROM latest""",
    "make_documents_from_pages": """SELECT 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' || page_id
        AS url, '' AS title, 'd' AS description, html AS content, sha256(html) AS checksum, 'web' AS context,
        'web_scrape' AS source_type FROM pages""",
    "documents_from_conversations": f"""SELECT {TURN_URL} AS url, role AS title, '' AS description, text AS content,
        sha256(text) AS checksum, '' AS context, '' AS source_type, NULL::VARCHAR AS error FROM conversations""",
    "valid_pages": """SELECT page_id, url, html, 200 AS status,
        CASE WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8' ELSE 'text/html' END AS content_type
        FROM pages WHERE page_id % 7 <> 0 AND page_id % 3 <> 2""",
    "page_title": f"WITH {PAGES} SELECT page_id, title FROM parsed",
    "page_description": "SELECT page_id, 'About & around ' || page_id AS description, NULL::VARCHAR AS error FROM pages",
    "main_text": f"WITH {PAGES} SELECT page_id, main_text FROM parsed",
    "markdown": f"WITH {PAGES} SELECT page_id, markdown FROM parsed",
    "parse_pages": f"""WITH {PAGES} SELECT page_id, title, description, main_text, markdown, len(hrefs) AS n_links,
        NULL::VARCHAR AS error FROM parsed""",
    "page_links": f"""WITH {PAGES} SELECT page_id, (i - 1)::INTEGER AS ord, {plain("hrefs[i]")} AS href
        FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM parsed)""",
    "resolve_links": f"""WITH {PAGES} SELECT url AS src_url, (i - 1)::INTEGER AS ord,
        regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {plain("hrefs[i]")} AS path
        FROM (SELECT url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM parsed)""",
    "resolve_references": """
        WITH parts AS (
          SELECT url, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)(\\?[^#]*)?(#.*)?$', ['s', 'h', 'p', 'q', 'f']) AS u FROM pages),
        named AS (SELECT url, u.s || '://' || u.h AS front, u.h AS host, u.p AS p, u.q AS q, u.f AS f, regexp_extract(u.p, '^(.*/)?') AS folder FROM parts),
        placed AS (SELECT *, CASE WHEN folder = '' THEN '/' ELSE folder END AS dir,
                          regexp_replace(CASE WHEN folder = '' THEN '/' ELSE folder END, '[^/]+/$', '') AS up FROM named),
        targets AS (
          SELECT url, host, unnest([
            {'ord': 0, 'path': dir || 'x/y', 'rest': '', 'f': ''}, {'ord': 1, 'path': up || 'x', 'rest': '', 'f': ''},
            {'ord': 2, 'path': dir || 'z', 'rest': '?q=1', 'f': ''}, {'ord': 3, 'path': p, 'rest': '?q', 'f': ''},
            {'ord': 4, 'path': p, 'rest': q, 'f': '#f'}, {'ord': 5, 'path': '/up', 'rest': '', 'f': ''}, {'ord': 6, 'path': p, 'rest': q, 'f': f},
            {'ord': 10, 'path': dir || 'a b', 'rest': '', 'f': ''}, {'ord': 12, 'path': dir || 'café', 'rest': '', 'f': ''},
            {'ord': 13, 'path': up, 'rest': '', 'f': ''}, {'ord': 14, 'path': '/~user/', 'rest': '', 'f': ''}]) AS t, front FROM placed)
        SELECT url AS src_url, t.ord AS ord, front || e || t.rest || t.f AS url, host, CASE WHEN t.path = '' THEN '/' ELSE t.path END AS path,
               front || CASE WHEN e = '' THEN '/' ELSE e END || t.rest AS key
        FROM (SELECT *, CASE t.ord WHEN 14 THEN '/%7Euser/' ELSE replace(replace(t.path, ' ', '%20'), 'é', '%C3%A9') END AS e FROM targets)""",
    "site_metadata": f"""WITH {RANKED}, {parsed("ranked")}
        SELECT r.page_id, b.url AS base_url, b.title, b.description FROM ranked r
        JOIN parsed b ON b.host = r.host AND b.rank = 0""",
    "crawl_depth": f"WITH RECURSIVE {walk(5)} SELECT base_url, url, depth FROM reached",
    "crawl_depth_two": f"WITH RECURSIVE {walk(2)} SELECT base_url, url, depth FROM reached",
    "crawl_paths": f"WITH RECURSIVE {walk(5)} SELECT DISTINCT base_url, path FROM reached",
    "crawl_last_page": f"WITH RECURSIVE {walk(5)} SELECT base_url, path, url, depth FROM last",
    "crawl_report": f"""WITH RECURSIVE {walk(5)} SELECT base_url, path, strlen(html) AS html_length
        FROM last JOIN linked ON linked.host = last.host AND linked.rank = last.cap""",
    "page_maps": f"""WITH RECURSIVE {walk(5)}, {parsed("linked")} SELECT base_url, path, p.html, p.markdown
        FROM last JOIN parsed p ON p.host = last.host AND p.rank = last.cap""",
    "crawl_summary": f"""WITH RECURSIVE {walk(5)} SELECT base_url, count(DISTINCT path) AS n_paths
        FROM reached GROUP BY base_url""",
    "fetch_plan": FETCH,
    "fetch_plan_hot_hosts": FETCH,
    "embed_docs": f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {hashed("src")}
        SELECT id AS doc_id, pos, value::DOUBLE AS value FROM vecs""",
    "search_text": f"""WITH src AS (SELECT 'd' || doc_id AS id, text FROM documents
                                  UNION ALL SELECT 'q' || item_id, text FROM benchmark),
        {hashed("src")},
        v AS (SELECT id, list(value ORDER BY pos) AS e FROM vecs GROUP BY id),
        n AS (SELECT id, e, sqrt({dot("e", "e")}) AS m FROM v),
        s AS (SELECT q.id[2:]::BIGINT AS query_id, d.id[2:] AS url, {dot("q.e", "d.e")} / (q.m * d.m) AS score
              FROM n q, n d WHERE q.id[1] = 'q' AND d.id[1] = 'd')
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM s
        WHERE score >= 0 QUALIFY rank <= 3""",
    "rejects": """SELECT doc_id::VARCHAR AS url, CASE WHEN quality = 0 THEN 'the embedder gave no vector'
        ELSE 'url and content are required' END AS error
        FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1""",
    "ingest_rows": f"""WITH src AS (SELECT {TURN_URL} AS id, text FROM conversations), {embedded("src")}
        SELECT id AS url, '' AS title, '' AS description, text AS content, sha256(text) AS checksum, {VECTOR}, 'talk' AS context,
               '' AS source_type FROM src JOIN vectors USING (id)""",
    "ingest_site": f"""WITH RECURSIVE {walk(5)}, {parsed("linked")},
        site AS (
          SELECT base_url || path AS url, b.title, b.description, p.markdown AS content
          FROM last JOIN parsed p ON p.host = last.host AND p.rank = last.cap JOIN parsed b ON b.host = last.host AND b.rank = last.base_cap),
        src AS (SELECT url AS id, content AS text FROM site), {embedded("src")}
        SELECT url, title, description, content, sha256(content) AS checksum, {VECTOR}, 'web' AS context, 'web_scrape' AS source_type
        FROM site JOIN vectors ON vectors.id = url""",
    "ingest_files": FILES,
    "stream_ingest": SINGLE_FILES,
    "stream_rejects": """
        WITH files AS (SELECT doc_id % 300 AS k, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)
        SELECT 'key=' || k AS place, CASE WHEN k % 3 <> 0 THEN sha256(content) END AS checksum,
               CASE WHEN k % 3 = 0 THEN 'content is not UTF-8' END AS error FROM files""",
}
