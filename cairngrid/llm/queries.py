"""Registered corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from cairngrid.llm.collocations import op13_weighted_ngrams
from cairngrid.llm.decontaminate import op3_inverted_index
from cairngrid.llm.embedding_dedup import op2_pca_tiles
from cairngrid.llm.html_extract import op9_host_paths
from cairngrid.llm.langid import op1_langid_ecoc
from cairngrid.llm.lexical_search import op12_impact_shards
from cairngrid.llm.line_dedup import op11_line_bitmaps
from cairngrid.llm.mixing import op4_soft_mixing
from cairngrid.llm.quality import op8_cotraining
from cairngrid.llm.simhash import op6_simhash
from cairngrid.llm.substring_dedup import op10_compact_windows
from cairngrid.llm.suffix_dedup import op7_suffix_cover
from cairngrid.llm.token_output import op5_token_orc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_langid_ecoc": op1_langid_ecoc,
    "op2_pca_tiles": op2_pca_tiles,
    "op3_inverted_index": op3_inverted_index,
    "op4_soft_mixing": op4_soft_mixing,
    "op5_token_orc": op5_token_orc,
    "op6_simhash": op6_simhash,
    "op7_suffix_cover": op7_suffix_cover,
    "op8_cotraining": op8_cotraining,
    "op9_host_paths": op9_host_paths,
    "op10_compact_windows": op10_compact_windows,
    "op11_line_bitmaps": op11_line_bitmaps,
    "op12_impact_shards": op12_impact_shards,
    "op13_weighted_ngrams": op13_weighted_ngrams,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The other queries use a hash, a tokenizer, fitted models or byte windows that SQL lacks or cannot do on whole tables in time.
ORACLE: dict[str, str] = {
    "op2_pca_tiles": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE list_sum(list_transform(embedding::DOUBLE[], lambda c: c * c)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9e0),
cc(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.a, cc.root FROM cc JOIN e ON e.b = cc.id),
c AS (SELECT id, min(root) AS component_id FROM cc GROUP BY 1), n AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON c.id = n.id""",
    "op3_inverted_index": f"""WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win), dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)),
hit AS (SELECT dg.doc_id, dg.i, dg.k, win.item_id FROM dg JOIN win ON dg.k = win.k AND dg.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY 1),
post AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM dw), cnt AS (SELECT term, count(*) AS n FROM post GROUP BY 1),
wp AS (SELECT item_id, w, i, unnest(w[i:i + least(len(w), 10) - 1]) AS term, generate_subscripts(w[i:i + least(len(w), 10) - 1], 1) AS p FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
rk AS (SELECT item_id, w, i, term, p, row_number() OVER (PARTITION BY item_id, w, i ORDER BY n, p, term) AS k FROM wp JOIN cnt USING (term)),
pr AS (SELECT DISTINCT a.item_id, a.term AS ta, b.term AS tb, a.p - b.p AS gap FROM rk a JOIN rk b ON a.item_id IS NOT DISTINCT FROM b.item_id AND a.w = b.w AND a.i = b.i AND a.k = 1 AND b.k = 2),
nr AS (SELECT DISTINCT x.doc_id, pr.item_id FROM pr JOIN post x ON x.term = pr.ta JOIN post y ON y.term = pr.tb AND y.doc_id = x.doc_id WHERE abs(x.pos - y.pos - pr.gap) <= 5 AND x.pos <> y.pos UNION SELECT doc_id, item_id FROM hit),
near AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n FROM nr GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items, sha256(coalesce(ids.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated, coalesce(near.n, 0)::BIGINT AS n_near
FROM dw d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id LEFT JOIN near ON d.doc_id = near.doc_id""",
    "op11_line_bitmaps": """WITH k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id""",
    "op12_impact_shards": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nl FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT q.item_id, p.doc_id, sum(q.times * floor(1000 * ln((2 * c.nd + 2) / (2 * f.df + 1)))::BIGINT * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * c.nd) // c.nl))))::BIGINT AS score FROM q JOIN f ON q.term = f.term JOIN p ON p.term = q.term CROSS JOIN c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op13_weighted_ngrams": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, m FROM (SELECT lang, piece, count(*) AS m FROM p GROUP BY ALL)),
t AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, m FROM (SELECT lang, w, m, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, sum(m)::BIGINT AS f FROM g GROUP BY ALL HAVING sum(m) >= 100),
c AS (SELECT f.lang, f.k, phrase, f AS a, n, string_split(phrase, ' ') AS w FROM f JOIN t ON f.lang = t.lang WHERE f.k > 1),
x AS (SELECT lang, k, phrase, a, n, i, array_to_string(w[1:i], ' ') AS p, array_to_string(w[i + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT x.lang, x.phrase, x.k, a, n, i, l.f AS l, r.f AS r, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.p JOIN f r ON r.lang = x.lang AND r.phrase = x.q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
y AS (SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, a AS f FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))),
z AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.lang = b.lang AND y.phrase = b.phrase AND 100 * y.f >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= 2000""",
}
