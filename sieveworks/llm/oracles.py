"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .url_filter import SPAM_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}')"


def _shingles(name: str, table: str, key: str) -> str:
    """CTEs: a row (id, s) for each distinct shingle of five words of a table's texts."""
    return f"""{name}_w AS (SELECT {key} AS id, list_filter(string_split_regex({_low("text")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {table} WHERE text IS NOT NULL),
    {name} AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM {name}_w WHERE len(w) > 0))"""


def _components(nodes: str, links: str) -> str:
    """CTEs: walk(id, root), the pairs reachable over links(a, b), which holds both directions."""
    return f"walk AS (SELECT id, id AS root FROM {nodes} UNION SELECT l.b, w.root FROM walk w JOIN {links} l ON l.a = w.id WHERE w.root < l.b)"


def _lloyd(rounds: int) -> str:
    """CTEs: a row (vec_id, label, p, x) for each part of each vector, and after so many rounds the entries
    c(p, k, x) and the assigned parts a(vec_id, label, p, x, k, d)."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = lambda n: f"a{n} AS MATERIALIZED (SELECT r, vec_id, label, p, x, best.k AS k, best.d AS d FROM (SELECT v.r, v.vec_id, v.label, v.p, v.x, min({{'d': {distance}, 'k': c.k}}) AS best FROM v JOIN c{n} c ON c.p = v.p GROUP BY ALL))"
    mean = lambda n: f"c{n + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT p, k, list(f ORDER BY j) AS x FROM (SELECT p, k, j, floor(sum(y)::DOUBLE / count(*))::BIGINT AS f FROM (SELECT p, k, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{n}) GROUP BY ALL) GROUP BY ALL) m ON m.p = c.p AND m.k = c.k)"
    steps = [x for n in range(rounds) for x in (assign(n), mean(n))]
    return f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT r, vec_id, label, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS x FROM e, range(4) t(p)), c0 AS (SELECT p, r AS k, x FROM v WHERE r < 256),
    {", ".join([*steps, assign(rounds)])}"""


_RULES = "(VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))"
_WORDS = ", ".join(f"'{w}'" for w in SPAM_WORDS)

ORACLES = {
    "op1_url_filters": f"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, {_low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
    fit AS (SELECT page_id, host, path, max_by({{'t': r.h || r.p, 'v': r.v}}, length(r.h || r.p)) AS best FROM parts LEFT JOIN {_RULES} r(h, p, v)
      ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY ALL),
    spam AS (SELECT *, list_reverse_sort(list_transform(list_filter(list_intersect([{_WORDS}], string_split_regex(host, '[^a-z0-9]+')), lambda w: true), lambda w: {{'n': length(w), 't': '*' || w || '*'}}))[1].t AS word FROM fit)
    SELECT page_id, host, path, best.t AS rule, coalesce(best.v, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN best.t IS NULL THEN word END AS pattern FROM spam""",
    "op2_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    link AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    {_components("v", "link")}
    SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, coalesce(m.root, e.vec_id) AS component_id, e.vec_id = coalesce(m.root, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN (SELECT id, min(root) AS root FROM walk GROUP BY id) m ON m.id = e.vec_id""",
    "op3_benchmark_decontamination": f"""WITH {_shingles("d", "documents", "doc_id")}, {_shingles("q", "benchmark", "item_id")},
    n AS (SELECT id, count(*) AS n FROM q GROUP BY id), hit AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared FROM q JOIN d USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n AS containment FROM hit JOIN n ON n.id = item_id WHERE 100 * n_shared >= 80 * n""",
    "op7_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM f""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE {_shingles("d", "documents", "doc_id")}, n AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
    pair AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
    link AS MATERIALIZED (SELECT a, b FROM pair JOIN n i ON i.id = a JOIN n j ON j.id = b WHERE 100 * k >= 85 * (i.n + j.n - k)),
    {_components("n", "link")}
    SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, t.doc_id) AS component_id, t.doc_id = coalesce(m.root, t.doc_id) AS kept
    FROM documents t LEFT JOIN n ON n.id = t.doc_id LEFT JOIN (SELECT id, min(root) AS root FROM walk GROUP BY id) m ON m.id = t.doc_id""",
    "op11_vector_codes": f"""WITH {_lloyd(4)}, s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS sha FROM c4),
    o AS (SELECT r, vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM o, s""",
    "op12_source_divergence": f"""WITH t AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_low("coalesce(text, '')")}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w, row_number() OVER () AS r FROM documents),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT lang, source, r, unnest(w) AS term FROM t) GROUP BY ALL),
    k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10), l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM t), s AS (SELECT c.lang, c.source, sum(c.n)::HUGEINT AS ng FROM c JOIN k USING (lang, term) GROUP BY ALL),
    p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.ng, 0) + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (l.nl + 2 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
    d AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(d.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN d ON d.lang = x.lang AND d.source = x.source AND d.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10""",
}
