"""Building blocks of the SQL that states the same for DuckDB."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "base": (
        (),
        """SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS source_id, substring(text, 1, 80) AS title, substring(text, 81) AS summary,
  'https://example.com/' || doc_id AS url, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 37 % 2016 AS INT)) AS published_at,
  TIMESTAMP '2024-04-01' AS collected_at, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 37 % 2016 AS INT)), '%G-W%V') AS published_week FROM documents""",
    ),
    "texts": (("base",), "SELECT id, source, published_week, trim(coalesce(title, '') || ' ' || coalesce(summary, '')) AS text FROM base"),
    "vocabulary": ((), "SELECT * FROM (VALUES ('ai', 'this'), ('ai', 'than'), ('ai', 'erth'), ('bigdata', 'from'), ('bigdata', 'thing'), ('bigdata', 'attion'), ('smallbiz', 'with'), ('smallbiz', 'eron'), ('smallbiz', 'thre')) v(axis, keyword)"),
    "matches": (("texts", "vocabulary"), "SELECT t.id AS item_id, v.axis, v.keyword FROM texts t JOIN vocabulary v ON regexp_matches(t.text, '(?i)(^|[^A-Za-z0-9])' || v.keyword || '([^A-Za-z0-9]|$)')"),
    "item_axes": (("matches",), "SELECT DISTINCT item_id, axis FROM matches"),
    "axis_n": (("base", "item_axes"), "SELECT b.id, count(a.axis) AS n_axes FROM base b LEFT JOIN item_axes a ON a.item_id = b.id GROUP BY b.id"),
    "axes_of": (("item_axes",), "SELECT item_id, string_agg(axis, '+' ORDER BY axis) AS axes, count(*) AS n FROM item_axes GROUP BY item_id"),
    "scored": (
        ("base", "item_axes"),
        """SELECT b.id, count(a.axis) AS n_axes, CASE WHEN count(a.axis) < 1 THEN 0.0::DOUBLE ELSE round(CASE count(a.axis) WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 3.0::DOUBLE ELSE 8.0::DOUBLE END
  * coalesce(sum(CASE a.axis WHEN 'ai' THEN 1.0::DOUBLE ELSE 1.2::DOUBLE END ORDER BY a.axis), 0.0::DOUBLE), 4) END AS cross_score FROM base b LEFT JOIN item_axes a ON a.item_id = b.id GROUP BY b.id""",
    ),
    "items": (
        ("base", "scored"),
        """SELECT b.*, s.cross_score, s.n_axes > 0 AS kept, CASE WHEN b.id % 7 = 0 THEN '▸ 확인 필요: ' || b.source || ' — ' || b.source_id || chr(10) || 'note' WHEN b.id % 5 = 0 THEN 'note' END AS insight,
  CASE WHEN b.id % 35 = 0 THEN 'manual' WHEN b.id % 7 = 0 OR b.id % 5 = 0 THEN 'm1' END AS insight_model FROM base b JOIN scored s ON s.id = b.id""",
    ),
    "tokens": (("texts",), "SELECT DISTINCT id AS item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS keyword FROM texts"),
    "keywords": (("tokens", "base"), "SELECT t.item_id, t.keyword, b.published_week AS week FROM tokens t JOIN base b ON b.id = t.item_id"),
    "kw_week": (("keywords", "items"), "SELECT k.keyword, k.week, count(*) AS n FROM keywords k JOIN items i ON i.id = k.item_id WHERE i.kept AND k.week IS NOT NULL GROUP BY k.keyword, k.week"),
    "kw_df": (("keywords",), "SELECT keyword, count(DISTINCT item_id) AS df, (SELECT count(DISTINCT item_id) FROM keywords) AS n_docs FROM keywords GROUP BY keyword"),
    "weeks": ((), "SELECT * FROM (VALUES ('2024-W12', 0), ('2024-W11', 1), ('2024-W10', 2), ('2024-W09', 3), ('2024-W08', 4)) w(week, age)"),
    "rising_counts": (
        ("kw_week", "weeks"),
        "SELECT keyword, CAST(sum(CASE WHEN age = 0 THEN n ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN age > 0 THEN n ELSE 0 END) AS BIGINT) AS before FROM kw_week JOIN weeks USING (week) GROUP BY keyword HAVING sum(CASE WHEN age = 0 THEN n ELSE 0 END) >= 5",
    ),
    "rising": (
        ("rising_counts", "items", "weeks"),
        """SELECT c.keyword, c.n, c.n / t.kept_now AS share, c.before / t.kept_before AS prev_share, (c.n / t.kept_now) / (c.before / t.kept_before + 1 / t.kept_now) AS score, c.before = 0 AS is_new
FROM rising_counts c, (SELECT greatest(count(*) FILTER (age = 0), 1) AS kept_now, greatest(count(*) FILTER (age > 0), 1) AS kept_before FROM items JOIN weeks ON week = published_week WHERE kept) t
WHERE NOT EXISTS (SELECT 1 FROM rising_counts o WHERE o.keyword <> c.keyword AND contains(o.keyword, c.keyword) AND o.n >= 0.9::DOUBLE * c.n)""",
    ),
    "cooc": (("keywords", "kw_df"), "SELECT x.keyword AS a, y.keyword AS b, count(*) AS n FROM keywords x JOIN keywords y ON x.item_id = y.item_id AND x.keyword < y.keyword JOIN kw_df dx ON dx.keyword = x.keyword AND dx.df >= 10 JOIN kw_df dy ON dy.keyword = y.keyword AND dy.df >= 10 GROUP BY 1, 2"),
    "strength": (
        ("cooc", "kw_df"),
        """SELECT c.a, c.b, c.n, x.df AS df_a, y.df AS df_b, CASE WHEN c.n < x.n_docs THEN ln((c.n / x.n_docs) / ((x.df / x.n_docs) * (y.df / x.n_docs))) / -ln(c.n / x.n_docs) ELSE 0.0::DOUBLE END AS npmi
FROM cooc c JOIN kw_df x ON x.keyword = c.a JOIN kw_df y ON y.keyword = c.b WHERE c.n >= 2""",
    ),
    "kw_neighbor": (
        ("strength",),
        """SELECT keyword, neighbor, npmi, cooc, df FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY npmi DESC, neighbor DESC, cooc DESC) AS place FROM (
  SELECT a AS keyword, b AS neighbor, npmi, n AS cooc, df_b AS df FROM strength WHERE npmi >= 0.15 AND NOT contains(a, b) AND NOT contains(b, a)
  UNION ALL SELECT b, a, npmi, n, df_a FROM strength WHERE npmi >= 0.15 AND NOT contains(a, b) AND NOT contains(b, a))) WHERE place <= 20""",
    ),
    "kw_meta": (
        ("kw_df", "keywords", "item_axes"),
        """SELECT d.keyword, d.df, m.axis FROM kw_df d LEFT JOIN (SELECT keyword, axis, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, axis) AS r FROM (
  SELECT k.keyword, a.axis, count(*) AS n FROM keywords k JOIN item_axes a ON a.item_id = k.item_id GROUP BY 1, 2)) m ON m.keyword = d.keyword AND m.r = 1 WHERE d.df >= 10""",
    ),
    "kw_item": (
        ("keywords", "kw_df"),
        """SELECT keyword, item_id FROM (SELECT k.keyword, k.item_id, length(k.keyword) >= 5 AND (k.keyword LIKE '%tion' OR k.keyword LIKE '%ment') AS org, d.df,
  row_number() OVER (PARTITION BY k.keyword ORDER BY k.item_id DESC) AS place FROM keywords k JOIN kw_df d ON d.keyword = k.keyword) WHERE org OR (df >= 5 AND place <= 60)""",
    ),
    "sources": ((), "SELECT DISTINCT source, source = 'src0' AS regulatory, CAST(substring(source, 4) AS INT) % 2 = 0 AS live, CASE WHEN CAST(substring(source, 4) AS INT) % 2 = 0 THEN 14 ELSE 7 END AS days FROM documents WHERE source IS NOT NULL"),
    "seed_dims": ((), "SELECT label, i AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) WHERE label IN (0, 1) GROUP BY label, i"),
    "centroids": (("seed_dims",), "SELECT label, list(x / n ORDER BY dim) AS c FROM (SELECT label, dim, x, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM seed_dims) GROUP BY label"),
    "relevance": (
        ("centroids",),
        """SELECT vec_id AS id, (list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT c FROM centroids WHERE label = 0)) - list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT c FROM centroids WHERE label = 1)))
  / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS relevance FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)""",
    ),
    "labelled": (("items",), "SELECT l.doc_id AS id, l.quality AS label, i.kept FROM labels l JOIN items i ON i.id = l.doc_id"),
    "digests": (("items",), "SELECT published_week AS week, 'lead ' || published_week AS lead FROM items WHERE kept AND CAST(substring(published_week, 7, 2) AS INT) % 2 = 0 GROUP BY published_week"),
}


def sql(body: str, *parts: str) -> str:
    """The body after the parts that it names, each once and after those that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    head = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)
    return f"WITH RECURSIVE {head}\n{body}" if head else body
