"""SQL for DuckDB with the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

from dunlin.llm import urls

_COMPONENTS = """
reach(id, r) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
)"""


def op2(cosine: float = 0.98) -> str:
    """All pairs of equal label by cosine, and the components of the linked ones."""
    return f"""
WITH RECURSIVE v AS (
    SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
u AS (SELECT id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.label = q.label AND p.id <> q.id AND len(p.e) = len(q.e) WHERE list_dot_product(p.e, q.e) >= {cosine} * p.n * q.n),
nodes AS (SELECT DISTINCT a AS id FROM links),{_COMPONENTS},
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(l.c, vec_id) AS component_id, coalesce(l.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degree d ON d.id = vec_id LEFT JOIN least l ON l.id = vec_id"""


def op7(rules=urls.RULES, damping: float = urls.DAMPING, rounds: int = urls.ROUNDS, threshold: float = urls.THRESHOLD) -> str:
    """Rules as a CASE, longest first, and the rounds of both propagations written out."""
    ordered = sorted(rules, key=lambda r: (-len(r.text()), r.text()))
    fit = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    case = lambda what: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{what(r)}'" for r in ordered) + " END"

    def chain(name: str, edges: str, seeds: str) -> str:
        parts = [f"{name}0 AS (SELECT host, {1 - damping} * seed AS score FROM {seeds})"]
        for k in range(1, rounds + 1):
            parts.append(
                f"{name}{k} AS (SELECT host, sum(score) AS score FROM (SELECT e.dst AS host, {damping} * sum(e.share * s.score) AS score FROM {edges} e JOIN {name}{k - 1} s ON e.src = s.host GROUP BY e.dst "
                f"UNION ALL SELECT host, {1 - damping} * seed FROM {seeds}) GROUP BY host)"
            )
        return ",\n".join(parts)

    return f"""
WITH p AS (
    SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
),
own AS (SELECT page_id, host, path, {case(lambda r: r.text())} AS rule, {case(lambda r: r.verdict)} AS ruled FROM p),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{urls.LINK.replace("'", "''")}', 1)), '{urls.UPPER}', '{urls.LOWER}') AS dst FROM p),
pairs AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY 1, 2),
fore AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM pairs),
back AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM pairs),
hosts AS (SELECT host, avg(CASE ruled WHEN 'allow' THEN 1.0 ELSE 0.0 END) AS trusted, avg(CASE ruled WHEN 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM own WHERE host <> '' GROUP BY host),
good AS (SELECT host, trusted AS seed FROM hosts WHERE trusted > 0),
bad AS (SELECT host, blocked AS seed FROM hosts WHERE blocked > 0),
{chain("t", "fore", "good")},
{chain("d", "back", "bad")}
SELECT page_id, own.host, path, rule,
    coalesce(ruled, CASE WHEN round(coalesce(d.score, 0), 6) > 0 AND round(coalesce(d.score, 0), 6) >= {threshold} * (round(coalesce(t.score, 0), 6) + round(coalesce(d.score, 0), 6)) THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN own.host = '' THEN 0.0 ELSE round(coalesce(t.score, 0), 6) END AS trust, CASE WHEN own.host = '' THEN 0.0 ELSE round(coalesce(d.score, 0), 6) END AS distrust
FROM own LEFT JOIN t{rounds} t ON t.host = own.host LEFT JOIN d{rounds} d ON d.host = own.host"""


def op10(size: int = 4, percent: int = 80) -> str:
    """Shingle sets written out, intersections counted by joining on shingles."""
    join = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size} + 2), lambda i: {join}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= {percent} * (p.n + q.n - count(*))
),
nodes AS (SELECT DISTINCT a AS id FROM links),{_COMPONENTS},
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id"""


def op5(width: int = 50) -> str:
    """Every string of the width as hexadecimal digits with its smallest id; covered bytes are gathered into runs."""
    return f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - {width - 1})) AS i, h FROM d WHERE len(h) >= {2 * width}),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * width}) AS t FROM w),
f AS (SELECT t, min(doc_id) AS least FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
c AS (SELECT g.doc_id, g.i FROM g JOIN f ON f.t = g.t WHERE f.least < g.doc_id),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + {width} AS b FROM r GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
e AS (SELECT q.doc_id, count(*) AS spans, sum(b - a) AS gone, max(b) AS last, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(e.gone, 0)::BIGINT AS n_removed, coalesce(e.spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN e.doc_id IS NULL THEN d.h ELSE e.head || substr(d.h, 2 * e.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN e ON e.doc_id = d.doc_id"""
