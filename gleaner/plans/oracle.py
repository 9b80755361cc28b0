"""The queries as SQL for an independent engine, written by hand from the operators' definitions."""

from __future__ import annotations

import unicodedata

from gleaner.functions.stopwords import DOMAIN, PORTUGUESE, TOPIC_EXTRA


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^0-9a-zà-öø-ÿ]+'), lambda w: w <> '')"


def lexical(toks: str) -> str:
    """CTEs up to `idf` from one that gives (item_id, t)."""
    return f"""{toks},
words AS (SELECT item_id, len(t) AS len, unnest(t) AS token FROM toks),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM toks),
tf AS (SELECT item_id, len, token, count(*) AS tf FROM words GROUP BY item_id, len, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
idf AS (SELECT token, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, stats)"""


def bm25(before: str, asked: str) -> str:
    """CTEs up to `lexical`; asked gives (query_id, token)."""
    return f"""{before},
asked AS (SELECT DISTINCT query_id, token FROM ({asked})),
score AS (
  SELECT a.query_id, tf.item_id, round(sum(idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.len / stats.avgdl))), 6) AS score
  FROM asked a JOIN tf ON tf.token = a.token JOIN idf ON idf.token = a.token, stats GROUP BY a.query_id, tf.item_id
),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM score) WHERE rank <= 100)"""


LEXICAL = lexical(f"toks AS (SELECT doc_id AS item_id, {tokens('text')} AS t FROM documents)")
BM25 = bm25(LEXICAL, f"SELECT item_id AS query_id, unnest({tokens('text')}) AS token FROM benchmark")

DENSE = """
qv AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
cv AS (SELECT vec_id AS item_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT query_id, item_id, round(list_dot_product(qv.e, cv.e), 6) AS s, round(list_dot_product(qv.e[1:32], cv.e[1:32]), 6) AS h FROM qv, cv),
r1 AS (SELECT * FROM (SELECT query_id, item_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM sims) WHERE rank <= 100),
r2 AS (SELECT * FROM (SELECT query_id, item_id, h AS score, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, item_id) AS rank FROM sims) WHERE rank <= 100),
fused AS (
  SELECT coalesce(r1.query_id, r2.query_id) AS query_id, coalesce(r1.item_id, r2.item_id) AS item_id, r1.rank AS a, r2.rank AS b,
         round(coalesce(1.0::DOUBLE / (60 + r1.rank), 0) + coalesce(1.0::DOUBLE / (60 + r2.rank), 0), 12) AS score
  FROM r1 FULL OUTER JOIN r2 ON r1.query_id = r2.query_id AND r1.item_id = r2.item_id
),
r3 AS (SELECT * FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, a ASC NULLS LAST, b) AS rank FROM fused) WHERE rank <= 100),
ranked AS (
  SELECT query_id, 'dense' AS method, rank, item_id, score FROM r1
  UNION ALL SELECT query_id, 'dense_half', rank, item_id, score FROM r2
  UNION ALL SELECT query_id, 'hybrid', rank, item_id, score FROM r3
),
qrels AS (SELECT query_id, item_id FROM qv JOIN cv ON qv.label = cv.label)"""

FLAGGED = """
flagged AS (
  SELECT r.query_id, r.method, r.rank, r.item_id, r.score,
         CASE WHEN q.item_id IS NOT NULL AND row_number() OVER (PARTITION BY r.query_id, r.method, r.item_id ORDER BY r.rank) = 1 THEN 1 ELSE 0 END AS flag
  FROM ranked r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.item_id = r.item_id
),
relevant AS (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY query_id)"""


def metrics(pairs: str = "SELECT DISTINCT query_id, method FROM ranked") -> str:
    """CTEs up to `metrics`, unrounded."""
    at = lambda k: f"coalesce(sum(CASE WHEN rank <= {k} THEN flag END), 0)"
    return f"""{FLAGGED},
so AS (SELECT *, sum(flag) OVER (PARTITION BY query_id, method ORDER BY rank) AS so_far FROM flagged),
found AS (
  SELECT query_id, method, count(*) AS returned, sum(flag) AS hits, sum(CASE WHEN flag = 1 THEN CAST(so_far AS DOUBLE) / rank END) AS ap,
         min(CASE WHEN flag = 1 THEN rank END) AS first_rank, {", ".join(f"{at(k)} AS h{k}" for k in (1, 5, 10, 20, 50, 100))}
  FROM so GROUP BY query_id, method
),
metrics AS (
  SELECT p.query_id, p.method, CAST(v.relevant AS BIGINT) AS relevant, CAST(coalesce(f.returned, 0) AS BIGINT) AS returned, CAST(coalesce(f.hits, 0) AS BIGINT) AS hits,
         coalesce(f.hits, 0)::DOUBLE / v.relevant AS recall, coalesce(h1, 0)::DOUBLE AS precision_at_1, coalesce(h5, 0)::DOUBLE / 5 AS precision_at_5,
         coalesce(h10, 0)::DOUBLE / 10 AS precision_at_10, coalesce(h20, 0)::DOUBLE / 20 AS precision_at_k, coalesce(h10, 0)::DOUBLE / v.relevant AS recall_at_10,
         coalesce(h50, 0)::DOUBLE / v.relevant AS recall_at_50, coalesce(h100, 0)::DOUBLE / v.relevant AS recall_at_100, coalesce(f.ap, 0) / v.relevant AS map,
         coalesce(1.0::DOUBLE / f.first_rank, 0) AS mrr, f.first_rank
  FROM ({pairs}) p JOIN relevant v ON v.query_id = p.query_id LEFT JOIN found f ON f.query_id = p.query_id AND f.method = p.method
)"""


AVERAGED = ("recall", "precision_at_1", "precision_at_5", "precision_at_10", "precision_at_k", "recall_at_10", "recall_at_50", "recall_at_100", "map", "mrr")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in AVERAGED)
METRIC_ROWS = f"SELECT query_id, method, relevant, returned, hits, {ROUNDED}, first_rank FROM metrics"
SUMMARY_ROWS = f"SELECT method, count(*) AS tested, count(*) AS successful, {', '.join(f'round(sum({c}) / count(*), 6) AS {c}' for c in AVERAGED)}, CAST(0 AS BIGINT) AS failed FROM metrics GROUP BY method"

LEXICAL_QRELS = """
ranked AS (SELECT query_id, 'bm25' AS method, rank, item_id, score FROM lexical),
qrels AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id AS item_id FROM documents d, benchmark b WHERE contains(d.text, b.text))"""
LEXICAL_PAIRS = "SELECT item_id AS query_id, 'bm25' AS method FROM benchmark"

THRESHOLD = f"""{FLAGGED},
totals AS (SELECT method, sum(relevant) AS total FROM (SELECT DISTINCT method, query_id FROM flagged) p JOIN relevant USING (query_id) GROUP BY method),
steps AS (SELECT method, score, sum(flag) AS h, count(*) AS n FROM flagged GROUP BY method, score),
running AS (SELECT method, score, sum(h) OVER w AS hits, sum(n) OVER w AS returned FROM steps WINDOW w AS (PARTITION BY method ORDER BY score DESC)),
curve AS (
  SELECT method, hits::DOUBLE / returned AS precision, hits::DOUBLE / total AS recall, CAST(hits AS BIGINT) AS hits, CAST(returned AS BIGINT) AS returned, score AS threshold, CAST(total AS BIGINT) AS total_relevant
  FROM running JOIN totals USING (method)
  UNION ALL SELECT method, 1.0, 0.0, 0, 0, NULL, CAST(total AS BIGINT) FROM totals
)"""


def interpolated(by: str = "method") -> str:
    """CTEs up to `inter` from `curve`."""
    join = " AND ".join(f"p.{c} = b.{c}" for c in by.split(", "))
    return f"""
points AS (SELECT {by}, round(recall, 9) AS recall, max(precision) AS p FROM curve GROUP BY {by}, round(recall, 9)),
levels AS (SELECT recall FROM points UNION SELECT 0.0 UNION SELECT 1.0),
inter AS (
  SELECT {", ".join("b." + c for c in by.split(", "))}, l.recall, coalesce(max(p.p), 0.0) AS precision
  FROM (SELECT DISTINCT {by} FROM points) b CROSS JOIN levels l LEFT JOIN points p ON {join} AND p.recall >= l.recall
  GROUP BY {", ".join("b." + c for c in by.split(", "))}, l.recall
)"""


PAIRS = f"""
dw AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({tokens("text")}) AS token FROM documents)),
dn AS (SELECT d.doc_id, count(w.token) AS n FROM documents d LEFT JOIN dw w ON w.doc_id = d.doc_id GROUP BY d.doc_id),
step AS (SELECT unnest([1, 2]) AS k),
followed AS (SELECT a.doc_id AS query_id, b.doc_id AS target_id, a.n AS na, b.n AS nb FROM dn a, step JOIN dn b ON b.doc_id = a.doc_id + step.k),
shared AS (SELECT a.doc_id AS query_id, b.doc_id AS target_id, count(*) AS s FROM dw a, step JOIN dw b ON b.doc_id = a.doc_id + step.k AND b.token = a.token GROUP BY a.doc_id, b.doc_id),
pairs AS (
  SELECT f.query_id, f.target_id, round(CASE WHEN na + nb = 0 THEN 1.0 ELSE coalesce(s, 0)::DOUBLE / (na + nb - coalesce(s, 0)) END, 9) AS jaccard
  FROM followed f LEFT JOIN shared s ON s.query_id = f.query_id AND s.target_id = f.target_id
),
overlap AS (SELECT query_id, round(avg(jaccard), 9) AS jaccard FROM pairs GROUP BY query_id)"""

WIDE = """
wide AS (
  SELECT query_id, avg(CASE WHEN method = 'dense' THEN round(map, 6) END) AS dense, avg(CASE WHEN method = 'dense_half' THEN round(map, 6) END) AS dense_half,
         avg(CASE WHEN method = 'hybrid' THEN round(map, 6) END) AS hybrid
  FROM metrics GROUP BY query_id
),
joined AS (SELECT o.query_id, o.jaccard, w.dense, w.dense_half, w.hybrid FROM overlap o JOIN wide w ON w.query_id = o.query_id),
split AS (SELECT *, CASE WHEN jaccard < (SELECT median(jaccard) FROM joined) THEN 'lower' ELSE 'upper' END AS half FROM joined)"""

HALVES = "halves AS (SELECT query_id, CASE WHEN jaccard < (SELECT median(jaccard) FROM overlap) THEN 'lower' ELSE 'upper' END AS half FROM overlap)"


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Ways of writing the same that the texts of the tables lack.
VARIANTS = (
    "cano ⅓ e ⅛ pol, ⅔ ⅕ ⅖ ⅗ ⅘", "ac\u0327o inox, corrosa\u0303o, a\u0300 vista", "ﬁo ﬂexível ﬃ", "ＤＮ ５０ ｔｕｂｏ", "10㎜ 5㎏ 3㎡ 2㎞", "¼ ½ ¾ 3½ ⅐ ⅑ ⅒ ⅙ ⅚ ⅜ ⅝ ⅞", "ΣΑΣ Straße X × 2", "1 X 2 – 3 — 4 №5 ™ ²",
)


def undecorated(x: str) -> str:
    """SQL of a text in compatibility decomposition without combining marks: the basic plane's characters that become one
    or none; of those that become several, the ranges of letters, signs, fractions, units and ligatures."""
    to = {c: "".join(p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p)) for c in map(chr, range(0xA0, 0x10000)) if not "\ud800" <= c <= "\udfff"}
    one = {c: p for c, p in to.items() if len(p) == 1 and p != c}
    none = "".join(c for c, p in to.items() if not p)
    out = f"translate({x}, {quote(''.join(one) + none)}, {quote(''.join(one.values()))})"
    for low, high in ((0xA0, 0x250), (0x2010, 0x2190), (0x3371, 0x33E0), (0xFB00, 0xFB07)):
        for c in map(chr, range(low, high)):
            if len(to[c]) > 1:
                out = f"replace({out}, {quote(c)}, {quote(to[c])})"
    return out


def normal_ctes(source: str, s: str = "s") -> str:
    """CTEs s0 to s9 (or with another letter) with (id, t) after each step, from a query with (id, t)."""
    twice = lambda pattern, to: f"regexp_replace(regexp_replace({{t}}, '{pattern}', '{to}', 'g'), '{pattern}', '{to}', 'g')"
    stop = ", ".join(map(quote, PORTUGUESE))
    steps = [
        undecorated("t"),
        "replace(replace(lower(t), 'ß', 'ss'), 'ς', 'σ')",
        "translate(t, '×X–—', 'xx--')",
        twice(r"(\d)\s*/\s*(\d)", r"\1/\2").format(t="replace(t, '⁄', '/')"),  # decomposition has left no vulgar fraction
        twice(r"(\d),(\d)", r"\1.\2").format(t="t"),
        r"""regexp_replace(t, '[^\p{L}\p{M}\p{N}_\s./"-]+', ' ', 'g')""",
        r"regexp_replace(regexp_replace(regexp_replace(t, '(?i)(\d)\s*x\s*(\d)', '\1x\2', 'g'), '(?i)(\d)\s*(mm|cm|m|v|w|kw|kva|hp)\b', '\1\2', 'g'), '(?i)\b(dn)\s*(\d)', '\1\2', 'g')",
        f"array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '' AND w NOT IN ({stop})), ' ')",
        r"trim(regexp_replace(t, '\s+', ' ', 'g'))",
    ]
    return f"{s}0 AS (SELECT id, coalesce(t, '') AS t FROM ({source})),\n" + ",\n".join(f"{s}{i + 1} AS (SELECT id, {step} AS t FROM {s}{i})" for i, step in enumerate(steps))


WRITTEN, WRITTEN_ASKED = (f"SELECT {key} AS id, concat(text, ' ', [{', '.join(map(quote, VARIANTS))}][{key} % {len(VARIANTS)} + 1]) AS t FROM {name}" for key, name in (("doc_id", "documents"), ("item_id", "benchmark")))
STEP_NAMES = ("strip_accents", "normalize_case", "normalize_symbols", "normalize_fractions", "normalize_decimal_comma", "remove_noise_punct", "normalize_technical_spacing", "remove_stopwords", "normalize_whitespace")
CLEAN = r"upper(trim(regexp_replace(text, '\s+', ' ', 'g')))"
CTFIDF = f"""
topic_words AS (SELECT source AS topic, unnest({tokens("text")}) AS term FROM documents),
topic_counts AS (SELECT topic, term, count(*) AS n FROM topic_words GROUP BY topic, term),
sizes AS (SELECT topic, sum(n) AS size FROM topic_counts GROUP BY topic),
freq AS (SELECT term, sum(n) AS f FROM topic_counts GROUP BY term),
terms AS (
  SELECT * FROM (
    SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank
    FROM (
      SELECT c.topic, c.term, round(c.n::DOUBLE / s.size * ln(1 + (SELECT avg(size) FROM sizes) / f.f), 9) AS weight
      FROM topic_counts c JOIN sizes s ON s.topic = c.topic JOIN freq f ON f.term = c.term
    )
  ) WHERE rank <= 10
)"""
TOPIC_MAP = """
asked AS (SELECT q.query_id, CASE WHEN d.doc_id IS NULL THEN -1 ELSE CAST(d.doc_id // 20 % 6 AS INTEGER) END AS topic FROM qv q LEFT JOIN documents d ON d.doc_id = q.query_id),
by_topic AS (
  SELECT topic, avg(CASE WHEN method = 'dense' THEN round(map, 6) END) AS dense, avg(CASE WHEN method = 'dense_half' THEN round(map, 6) END) AS dense_half,
         avg(CASE WHEN method = 'hybrid' THEN round(map, 6) END) AS hybrid, count(DISTINCT m.query_id) AS n_queries
  FROM metrics m JOIN asked a ON a.query_id = m.query_id GROUP BY topic HAVING count(DISTINCT m.query_id) >= 2
),
topic_means AS (SELECT *, (dense + dense_half + hybrid) / 3 AS mean_quality FROM by_topic)"""
REPEATED = """
again AS (SELECT query_id, method, rank, item_id - item_id % 3 AS item_id, score FROM ranked WHERE method = 'dense'),
judged AS (SELECT DISTINCT query_id, item_id - item_id % 3 AS item_id FROM qrels),
marked AS (
  SELECT a.query_id, a.rank, a.item_id, j.item_id IS NOT NULL AS hit, row_number() OVER (PARTITION BY a.query_id, a.item_id ORDER BY a.rank) AS nth
  FROM again a LEFT JOIN judged j ON j.query_id = a.query_id AND j.item_id = a.item_id
)"""
PARTS = "SELECT p_partkey AS code, concat_ws(' ', CASE WHEN p_partkey % 4 < 2 THEN upper(p_name) ELSE p_name END, p_brand) AS text, p_partkey AS pos, p_partkey % 2 AS side FROM part"


def oracle() -> dict[str, str]:
    dense = lambda tail: f"WITH {DENSE}, {tail}"
    strata = lambda tail: f"WITH {DENSE}, {metrics()}, {PAIRS}, {tail}"
    return {
        "bm25_topk": f"WITH {BM25} SELECT query_id, item_id, score, rank FROM lexical",
        "term_stats": f"WITH {LEXICAL} SELECT item_id, CAST(len(t) AS BIGINT) AS doc_len, CAST(len(list_distinct(t)) AS BIGINT) AS distinct_terms FROM toks",
        "idf_stats": f"WITH {LEXICAL} SELECT token, df, round(idf, 9) AS idf FROM idf",
        "bm25_metrics": f"WITH {BM25}, {LEXICAL_QRELS}, {metrics(LEXICAL_PAIRS)} {METRIC_ROWS}",
        "bm25_summary": f"WITH {BM25}, {LEXICAL_QRELS}, {metrics(LEXICAL_PAIRS)} {SUMMARY_ROWS}",
        "bm25_normalized_topk": f"""WITH {normal_ctes("SELECT doc_id AS id, text AS t FROM documents")}, {normal_ctes("SELECT item_id AS id, text AS t FROM benchmark", "b")},
            {bm25(lexical("toks AS (SELECT id AS item_id, list_filter(string_split(t, ' '), lambda w: w <> '') AS t FROM s9)"), "SELECT id AS query_id, unnest(list_filter(string_split(t, ' '), lambda w: w <> '')) AS token FROM b9")}
            SELECT query_id, item_id, score, rank FROM lexical""",
        "hybrid_topk": f"""WITH {BM25},
            ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            ds AS (SELECT b.item_id AS query_id, c.vec_id AS item_id, round(list_dot_product(q.e, c.e), 6) AS s FROM benchmark b JOIN ev q ON q.vec_id = b.item_id, ev c),
            r2 AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM ds) WHERE rank <= 100),
            fused AS (
              SELECT coalesce(l.query_id, r2.query_id) AS query_id, coalesce(l.item_id, r2.item_id) AS item_id, l.rank AS a, r2.rank AS b,
                     round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + r2.rank), 0), 12) AS score
              FROM lexical l FULL OUTER JOIN r2 ON l.query_id = r2.query_id AND l.item_id = r2.item_id
            )
            SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, a ASC NULLS LAST, b) AS rank FROM fused) WHERE rank <= 100""",
        "dense_topk": f"WITH {DENSE} SELECT query_id, rank, item_id, score FROM r1",
        "rrf_topk": f"WITH {DENSE} SELECT query_id, rank, item_id, score FROM r3",
        "dense_metrics": dense(f"{metrics()} {METRIC_ROWS}"),
        "method_summary": dense(f"{metrics()} {SUMMARY_ROWS}"),
        "ndcg_by_query": dense(f"""{FLAGGED},
            gains AS (SELECT query_id, method, sum(CASE WHEN rank <= 10 AND flag = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g10, sum(CASE WHEN flag = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g100 FROM flagged GROUP BY query_id, method),
            ideal AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS i10, sum(1 / log2(i + 1)) AS i100 FROM (SELECT query_id, unnest(range(1, least(relevant, 100) + 1)) AS i FROM relevant) GROUP BY query_id)
            SELECT g.query_id, g.method, round(g10 / i10, 6) AS ndcg_at_10, round(g100 / i100, 6) AS ndcg_at_100 FROM gains g JOIN ideal i ON i.query_id = g.query_id"""),
        "flags_keep_repeats": dense(f"{REPEATED} SELECT query_id, rank, item_id, CASE WHEN hit AND nth = 1 THEN 1 ELSE 0 END AS flag FROM marked"),
        "flags_drop_repeats": dense(f"{REPEATED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, item_id, CASE WHEN hit THEN 1 ELSE 0 END AS flag FROM marked WHERE nth = 1"),
        "pr_by_rank": dense(f"""{FLAGGED},
            totals AS (SELECT method, sum(relevant) AS total FROM (SELECT DISTINCT method, query_id FROM flagged) p JOIN relevant USING (query_id) GROUP BY method),
            steps AS (SELECT method, rank, sum(flag) AS h, count(*) AS n FROM flagged GROUP BY method, rank),
            running AS (SELECT method, rank, sum(h) OVER w AS hits, sum(n) OVER w AS returned FROM steps WINDOW w AS (PARTITION BY method ORDER BY rank))
            SELECT method, round(hits::DOUBLE / returned, 6) AS precision, round(hits::DOUBLE / total, 6) AS recall, CAST(hits AS BIGINT) AS hits, CAST(returned AS BIGINT) AS returned, rank FROM running JOIN totals USING (method)
            UNION ALL SELECT method, 1.0, 0.0, 0, 0, 0 FROM totals"""),
        "pr_by_threshold": dense(f"{THRESHOLD} SELECT method, round(precision, 6) AS precision, round(recall, 6) AS recall, hits, returned, round(threshold, 12) AS threshold, total_relevant FROM curve"),
        "pr_pooled_sets": dense(f"""{FLAGGED},
            merged AS (SELECT * FROM flagged WHERE query_id % 40 = 0 UNION ALL SELECT * FROM flagged WHERE query_id % 60 = 0),
            totals AS (SELECT method, sum(relevant) AS total FROM (SELECT DISTINCT 40 AS s, method, query_id FROM flagged WHERE query_id % 40 = 0 UNION ALL SELECT DISTINCT 60, method, query_id FROM flagged WHERE query_id % 60 = 0) JOIN relevant USING (query_id) GROUP BY method),
            steps AS (SELECT method, score, sum(flag) AS h, count(*) AS n FROM merged GROUP BY method, score),
            running AS (SELECT method, score, sum(h) OVER w AS hits, sum(n) OVER w AS returned FROM steps WINDOW w AS (PARTITION BY method ORDER BY score DESC))
            SELECT method, round(hits::DOUBLE / returned, 6) AS precision, round(hits::DOUBLE / total, 6) AS recall, CAST(hits AS BIGINT) AS hits, CAST(returned AS BIGINT) AS returned, round(score, 12) AS threshold, CAST(total AS BIGINT) AS total_relevant FROM running JOIN totals USING (method)
            UNION ALL SELECT method, 1.0, 0.0, 0, 0, NULL, CAST(total AS BIGINT) FROM totals"""),
        "ap_from_curve": dense(f"{THRESHOLD}, gained AS (SELECT method, precision, recall - lag(recall, 1, 0.0) OVER (PARTITION BY method ORDER BY returned) AS gain FROM curve) SELECT method, round(sum(CASE WHEN gain > 0 THEN gain * precision ELSE 0 END), 6) AS ap FROM gained GROUP BY method"),
        "pr_interpolated": dense(f"{THRESHOLD}, {interpolated()} SELECT recall, " + ", ".join(f"round(max(CASE WHEN method = '{m}' THEN precision END), 9) AS {m}" for m in ("dense", "dense_half", "hybrid")) + " FROM inter GROUP BY recall"),
        "auc_interpolated": dense(f"{THRESHOLD}, {interpolated()}, w AS (SELECT method, precision, recall - lag(recall, 1, 0.0) OVER (PARTITION BY method ORDER BY recall) AS width FROM inter) SELECT method, round(sum(width * precision), 6) AS auc FROM w GROUP BY method"),
        "pooled_map": dense(f"{metrics()} SELECT method, count(*) AS n_queries, round(avg(map), 6) AS map FROM metrics GROUP BY method"),
        "candidate_lists": dense("""lists AS (SELECT query_id, method, string_agg(rank || ':' || item_id, ',' ORDER BY rank) AS candidates FROM ranked GROUP BY query_id, method),
            rel AS (SELECT query_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS relevant FROM qrels GROUP BY query_id)
            SELECT l.query_id AS product_id, l.method, q.label::VARCHAR AS search_terms, l.candidates, coalesce(r.relevant, '') AS relevant FROM lists l JOIN qv q ON q.query_id = l.query_id LEFT JOIN rel r ON r.query_id = l.query_id"""),
        "jaccard_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
        "jaccard_shares": f"WITH {PAIRS}, low AS (SELECT jaccard FROM pairs ORDER BY jaccard, query_id LIMIT 5), high AS (SELECT jaccard FROM pairs ORDER BY jaccard DESC, query_id LIMIT 5) SELECT 'low' AS side, count(*) AS n, round(sum(jaccard), 6) AS jaccard_sum FROM low UNION ALL SELECT 'high', count(*), round(sum(jaccard), 6) FROM high",
        "overlap_shares": f"WITH {PAIRS} SELECT CASE WHEN target_id = query_id + 1 THEN 'next' ELSE 'second' END AS side, count(*) AS n, round(avg((jaccard = 0)::INTEGER), 6) AS share_zero, round(avg((jaccard >= 0.1)::INTEGER), 6) AS share_high FROM pairs GROUP BY side",
        "nearest_extremes": f"WITH {PAIRS}, low AS (SELECT * FROM pairs ORDER BY jaccard, 2 * query_id + target_id - query_id LIMIT 5), high AS (SELECT * FROM pairs ORDER BY jaccard DESC, 2 * query_id + target_id - query_id LIMIT 5) SELECT *, 'low' AS side FROM low UNION ALL SELECT *, 'high' FROM high",
        "jaccard_median_split": strata(f"{WIDE} SELECT half, count(*) AS n, round(min(jaccard), 9) AS jaccard_min, round(max(jaccard), 9) AS jaccard_max, round(avg(jaccard), 9) AS jaccard_mean, round(avg(dense), 9) AS dense, round(avg(dense_half), 9) AS dense_half, round(avg(hybrid), 9) AS hybrid, round(avg(dense - dense_half), 9) AS advantage FROM split GROUP BY half"),
        "median_split_verdict": strata(f"{WIDE} SELECT (SELECT avg(dense - dense_half) FROM split WHERE half = 'lower') > (SELECT avg(dense - dense_half) FROM split WHERE half = 'upper') AS larger_below"),
        "jaccard_quartiles": strata("""rows_ AS (SELECT m.query_id, m.method, round(m.map, 6) AS map, o.jaccard FROM metrics m JOIN overlap o ON o.query_id = m.query_id),
            edge AS (SELECT list_sort(list_distinct([quantile_cont(jaccard, 0.0), quantile_cont(jaccard, 0.25), quantile_cont(jaccard, 0.5), quantile_cont(jaccard, 0.75), quantile_cont(jaccard, 1.0)])) AS e FROM rows_),
            binned AS (SELECT CAST(greatest(len(list_filter(e, lambda x: x < jaccard)), 1) AS BIGINT) AS bin, method, jaccard, map FROM rows_, edge)
            SELECT bin, method, count(*) AS n, round(min(jaccard), 9) AS low, round(max(jaccard), 9) AS high, round(avg(map), 9) AS map FROM binned GROUP BY bin, method"""),
        "spearman_jaccard_adv": strata(f"""{WIDE}, adv AS (SELECT jaccard AS a, round(dense - dense_half, 6) AS b FROM joined),
            ranks AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM adv)
            SELECT round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM ranks"""),
        "ndcg_by_half": f"""WITH {DENSE}, {FLAGGED}, {PAIRS}, {HALVES},
            gains AS (SELECT query_id, method, sum(CASE WHEN rank <= 10 AND flag = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g10, sum(CASE WHEN flag = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS g100 FROM flagged GROUP BY query_id, method),
            ideal AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS i10, sum(1 / log2(i + 1)) AS i100 FROM (SELECT query_id, unnest(range(1, least(relevant, 100) + 1)) AS i FROM relevant) GROUP BY query_id)
            SELECT half, method, count(*) AS n, round(avg(g10 / i10), 9) AS ndcg_at_10, round(avg(g100 / i100), 9) AS ndcg_at_100
            FROM gains g JOIN ideal i ON i.query_id = g.query_id JOIN halves h ON h.query_id = g.query_id GROUP BY half, method""",
        "pr_by_half": f"""WITH {DENSE}, {FLAGGED}, {PAIRS}, {HALVES},
            halved AS (SELECT f.*, h.half FROM flagged f JOIN halves h ON h.query_id = f.query_id),
            totals AS (SELECT method, half, sum(relevant) AS total FROM (SELECT DISTINCT method, half, query_id FROM halved) p JOIN relevant USING (query_id) GROUP BY method, half),
            steps AS (SELECT method, half, score, sum(flag) AS h, count(*) AS n FROM halved GROUP BY method, half, score),
            running AS (SELECT method, half, sum(h) OVER w AS hits, sum(n) OVER w AS returned FROM steps WINDOW w AS (PARTITION BY method, half ORDER BY score DESC)),
            curve AS (SELECT method, half, hits::DOUBLE / returned AS precision, hits::DOUBLE / total AS recall FROM running JOIN totals USING (method, half) UNION ALL SELECT method, half, 1.0, 0.0 FROM totals),
            {interpolated("method, half")} SELECT method, half, recall, round(precision, 9) AS precision FROM inter""",
        "length_ecdf": "SELECT n_chars AS value, round(row_number() OVER (ORDER BY n_chars)::DOUBLE / count(*) OVER (), 9) AS share FROM documents WHERE n_chars IS NOT NULL",
        "length_histogram": "WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents) SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((n_chars - lo) / (hi - lo) * 40) + 1, 40) END AS BIGINT) AS bin, count(*) AS count FROM documents, e WHERE n_chars IS NOT NULL GROUP BY bin",
        "length_box": "SELECT lang, min(n_chars) AS low, round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.75), 6) AS q3, max(n_chars) AS high FROM documents GROUP BY lang",
        "normalize_text": f"WITH {normal_ctes(WRITTEN)} SELECT id AS item_id, sha256(t) AS normalized_sha256, CAST(length(t) AS BIGINT) AS normalized_chars FROM s9",
        "normalize_steps": f"WITH {normal_ctes(WRITTEN_ASKED)} " + " UNION ALL ".join(f"SELECT a.id AS query_id, '{name}' AS step, a.t AS before, b.t AS after FROM s{i} a JOIN s{i + 1} b ON a.id = b.id WHERE a.t <> b.t" for i, name in enumerate(STEP_NAMES)),
        "stopword_multiset_diff": f"""WITH {normal_ctes("SELECT doc_id AS id, text AS t FROM documents")},
            gone AS (SELECT id, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w IN ({", ".join(map(quote, PORTUGUESE))})) AS r FROM s7)
            SELECT id AS item_id, CAST(len(r) AS BIGINT) AS n_removed, array_to_string(r, ' ') AS removed FROM gone""",
        "punctuated_tokens": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]') AS t FROM conversations)
            SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM t""",
        "topic_preprocess": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), '\\S+') AS t FROM documents)
            SELECT doc_id AS item_id, sha256(array_to_string(list_filter(t, lambda x: x NOT IN ({", ".join(map(quote, dict.fromkeys((*PORTUGUESE, *TOPIC_EXTRA, *DOMAIN))))}) AND NOT regexp_full_match(x, '[\\d,./\\-]+') AND length(x) > 1), ' ')) AS kept_sha256 FROM w""",
        "length_stats": f"WITH r AS (SELECT lang, length(text) AS c, len({tokens('text')}) AS t FROM documents) SELECT lang, count(*) AS docs, CAST(sum(t) AS BIGINT) AS tokens, round(avg(c), 6) AS mean_chars, round(median(c), 6) AS median_chars, round(avg(t), 6) AS mean_tokens, round(median(t), 6) AS median_tokens, round(100 * avg((c <= 300)::INTEGER), 6) AS short_pct FROM r GROUP BY lang",
        "vocab_overlap": f"""WITH w AS (SELECT DISTINCT lang, token FROM (SELECT lang, unnest({tokens("text")}) AS token FROM documents WHERE lang IN ('en', 'fr'))),
            s AS (SELECT token, max((lang = 'en')::INTEGER) AS a, max((lang = 'fr')::INTEGER) AS b FROM w GROUP BY token)
            SELECT CAST(sum(a) AS BIGINT) AS vocab_a, CAST(sum(b) AS BIGINT) AS vocab_b, CAST(sum(a * b) AS BIGINT) AS shared, count(*) AS united, round(100 * sum(a * b)::DOUBLE / count(*), 6) AS overlap_pct FROM s""",
        "corpus_dedup_union": f"""WITH p AS ({PARTS}), k AS (SELECT *, {CLEAN} AS key FROM p),
            g AS (SELECT key, min(CASE WHEN side = 0 THEN code END) AS code_left, min(CASE WHEN side = 1 THEN code END) AS code_right FROM k GROUP BY key),
            f AS (SELECT key, text FROM (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY side, pos) AS n FROM k) WHERE n = 1)
            SELECT trim(f.text) AS description, coalesce(code_left::VARCHAR, '') AS code_left, coalesce(code_right::VARCHAR, '') AS code_right, CASE WHEN code_left IS NOT NULL AND code_right IS NOT NULL THEN 'both' WHEN code_left IS NOT NULL THEN 'left' ELSE 'right' END AS source FROM g JOIN f ON f.key = g.key""",
        "qrels_grouping": """WITH c AS (SELECT DISTINCT l_partkey AS p, p_name AS pn, l_suppkey AS s, s_name AS sn FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
            SELECT p AS product_id, pn AS product_description, min_by(sn, s) AS original_description, string_agg(s::VARCHAR, ',' ORDER BY s) AS relevant_item_ids FROM c GROUP BY p, pn""",
        "unique_item_corpus": "SELECT DISTINCT l_suppkey AS item_id, s_name AS text FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey",
        "different_correlations": "SELECT * FROM (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) END AS other FROM part) WHERE p_name <> other",
        "first_n_codes": "WITH f AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY min(o_orderkey) LIMIT 100) SELECT o_custkey AS codigo, o_orderkey AS pos, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f)",
        "topic_distribution": "SELECT source AS topic, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY source",
        "largest_topics": "SELECT source AS topic, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY source ORDER BY n DESC, topic LIMIT 3",
        "long_enough_texts": f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), '\\S+') AS t FROM conversations)
            SELECT conv_id, turn FROM w WHERE length(array_to_string(list_filter(t, lambda x: x NOT IN ({", ".join(map(quote, dict.fromkeys((*PORTUGUESE, *TOPIC_EXTRA, *DOMAIN))))}) AND NOT regexp_full_match(x, '[\\d,./\\-]+') AND length(x) > 1), ' ')) >= 100""",
        "ctfidf_terms": f"WITH {CTFIDF} SELECT topic, term, weight, rank FROM terms",
        "topic_info": f"WITH {CTFIDF}, k AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords FROM terms WHERE rank <= 5 GROUP BY topic) SELECT s.topic, s.size, coalesce(k.keywords, '') AS keywords FROM (SELECT source AS topic, count(*) AS size FROM documents GROUP BY source) s LEFT JOIN k ON k.topic = s.topic",
        "ngram_vocab": f"""WITH t AS (SELECT doc_id, {tokens("text")} AS t FROM documents),
            w AS (SELECT doc_id, unnest(t) AS a, unnest(range(1, len(t) + 1)) AS i FROM t),
            g AS (SELECT DISTINCT doc_id, a AS term FROM w UNION SELECT doc_id, a || ' ' || n FROM (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM w) WHERE n IS NOT NULL)
            SELECT term, count(*) AS df FROM g GROUP BY term HAVING count(*) >= 3""",
        "query_topics": dense("""firsts AS (SELECT query_id, min(item_id) AS target FROM qrels GROUP BY query_id)
            SELECT f.query_id, coalesce(CAST(regexp_extract(d.source, '(\\d+)', 1) AS INTEGER), -1) AS topic FROM firsts f LEFT JOIN documents d ON d.doc_id = f.target"""),
        "topic_map_ranked": dense(f"{metrics()}, {TOPIC_MAP} SELECT topic, round(dense, 9) AS dense, round(dense_half, 9) AS dense_half, round(hybrid, 9) AS hybrid, n_queries, round(mean_quality, 9) AS mean_quality FROM topic_means"),
        "best_worst_topics": dense(f"{metrics()}, {TOPIC_MAP}, r AS (SELECT topic, n_queries, round(mean_quality, 9) AS mean_quality FROM topic_means) SELECT * FROM (SELECT * FROM r ORDER BY mean_quality DESC, topic LIMIT 3) UNION SELECT * FROM (SELECT * FROM r ORDER BY mean_quality, topic LIMIT 3)"),
    }
