"""SQL (DuckDB) for the queries of this folder that SQL can express on whole tables."""

from __future__ import annotations

import string

_WORD = r"[^\x20\x09-\x0D]+"

#: Windows of 13 words with the smallest document that has them; words that an earlier document's window covers go.
SUBSTRING_DEDUP = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM doc)),
origin AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM win JOIN origin USING (g) WHERE first_doc < doc_id),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)"""

_REACH = """reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
class AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""

#: Sets of 4-word shingles, links of Jaccard 0.8 or more, and the classes they connect.
MINHASH = f"""
WITH RECURSIVE doc AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS w FROM documents),
node AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS s FROM doc),
one AS (SELECT id, len(s) AS n, unnest(s) AS g FROM node),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS both_have, any_value(x.n + y.n) AS n FROM one x JOIN one y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared WHERE 100 * both_have >= 80 * (n - both_have)),
{_REACH}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM node JOIN class USING (id)"""

#: Links of cosine 0.93 or more between valid vectors of one label, and the classes they connect.
EMBEDDINGS = f"""
WITH RECURSIVE node AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM node WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93),
{_REACH}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM class LEFT JOIN (SELECT a AS id, count(*) AS n FROM link GROUP BY 1) USING (id)"""

#: The article of each page without its adverts. It holds for pages that mark their article and have no other furniture in it,
#: as all pages of the test tables do; of the trees that the query decides by it knows nothing.
HTML_EXTRACTION = r"""
WITH article AS (SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS h FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->|<div class="ad">.*?</div>', '', 'g'), '<br\s*/?>', ' ', 'g') AS h FROM article),
parts AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:h[1-6]|p|div|ul|ol|li|blockquote|pre|table|tr|td)(?:\s[^>]*)?>'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS b FROM bare),
blocks AS (SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM parts),
whole AS (SELECT page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM whole"""

#: Phrases of 2 and 3 words with 10 places or more, scored by their weakest cut, without those that a longer one mostly covers.
PHRASES = f"""
WITH part AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM part),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY 1),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
gram AS MATERIALIZED (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS g, count(*) AS f FROM (SELECT *, unnest([1, 2, 3]) AS size FROM place) WHERE i + size - 1 <= len(w) GROUP BY ALL),
candidate AS MATERIALIZED (SELECT lang, size, g, f AS a, string_split(g, ' ') AS w FROM gram WHERE size >= 2 AND f >= 10),
known AS MATERIALIZED (SELECT lang || chr(10) || g AS g, f FROM gram WHERE f >= 10),
halved AS MATERIALIZED (SELECT lang, g, size, a, k, lang || chr(10) || array_to_string(w[:k], ' ') AS x, lang || chr(10) || array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate)),
cut AS (SELECT h.*, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score FROM halved h JOIN known x ON x.g = h.x JOIN known y ON y.g = h.y),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS g, max(a) AS most FROM (SELECT *, unnest([1, 2]) AS i FROM candidate WHERE size = 3) GROUP BY 1, 2),
left_ AS (SELECT w.* FROM weakest w LEFT JOIN longer USING (lang, g) WHERE most IS NULL OR size = 3 OR 100 * most < 50 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, score::BIGINT AS score FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

#: Products of whole numbers of every hundredth vector with all others, the ten best of each.
TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS y FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.y, c.y)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.y) = len(c.y) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10"""


def _merkle(levels: int = 7, above: int = 3) -> str:
    """Levels of the trees one by one; 8**levels documents of a language and 8**above languages have room."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform({steps}, lambda x: x::BIGINT)), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    out = [
        f"leaf AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS v, coalesce('x' || lang, '') AS tree FROM documents)",
        "d0 AS (SELECT doc_id, tree, leaf, v, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos FROM leaf)",
        "n0 AS (SELECT tree, pos, leaf AS h FROM d0)",
    ]
    for i in range(levels + above):
        if i == levels:  # from here on subroots are leaves of one tree
            out.append(f"place AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n{i})")
            out.append("top AS (SELECT '' AS tree, pos, h FROM place)")
            out.append(f"d AS (SELECT doc_id, '' AS tree, leaf, v, proof, place.pos, place.h AS subroot FROM d{i} JOIN place USING (tree))")
        nodes, docs = ("top", "d") if i == levels else (f"n{i}", f"d{i}")
        kept = ", subroot" if i >= levels else ""
        out.append(f"r{i} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}) GROUP BY 1, pos // 8)")
        out.append(f"n{i + 1} AS (SELECT tree, pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{i})")
        out.append(
            f"d{i + 1} AS MATERIALIZED (SELECT doc_id, tree, leaf, CASE WHEN n = 1 THEN v ELSE sha256(array_to_string(list_concat(hs[:own], [v], hs[own + 2:]), '')) END AS v, "
            f"CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(list_concat(hs[:own], hs[own + 2:]), '') END AS proof, run AS pos{kept} FROM (SELECT *, pos // 8 AS run, pos % 8 AS own FROM {docs}) x JOIN (SELECT tree, pos AS run, hs, n FROM r{i}) USING (tree, run))"
        )
    last = levels + above
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = h AS verified FROM d{last} JOIN n{last} USING (tree)"


#: Trees of hashes over the documents of each language and over these, with each document's proof, some tampered with.
MERKLE = _merkle()

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": EMBEDDINGS,
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op7_minhash_near_dedup": MINHASH,
    "op8_html_extraction": HTML_EXTRACTION,
    "op11_phrase_collocations": PHRASES,
    "op12_exact_topk": TOPK,
    "op13_merkle_manifest": MERKLE,
}
