"""The queries in DuckDB's SQL."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _tok(c: str) -> str:
    return f"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+(?:[''-][\\p{{L}}\\p{{N}}]+)*')"


_NUM = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '([A-Za-z])\d', '\1 ', 'g'), '([A-Za-z])[-+]', '\1 ', 'g'), '[-+]?\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')::DOUBLE)"
_NORM = r"trim(replace(lower(regexp_replace(text, '\s+', ' ', 'g')), 'ß', 'ss'))"
_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_DAILY = "daily AS (SELECT user_id, ts::DATE AS day, sum(value) AS value, count(*)::DOUBLE AS events, sum(CASE WHEN event_type = 'click' THEN value END) AS clicks FROM events GROUP BY 1, 2)"
_DENSE = _DAILY + ", dense AS (SELECT u.user_id, g.day, value FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day) g LEFT JOIN daily d ON d.user_id = u.user_id AND d.day = g.day)"
_SPANS = "spans AS (SELECT user_id, event_type, event_id AS id, ts AS start_at, ts + to_minutes(floor(value)::BIGINT) AS end_at FROM events)"
_MIN = "(hour(ts) * 60 + minute(ts))::DOUBLE"

ORACLES["tokenize_counts"] = f"SELECT doc_id, len({_tok('text')})::BIGINT AS tokens, len(list_distinct({_tok('text')}))::BIGINT AS distinct_tokens FROM documents"
ORACLES["normalized_text"] = f"SELECT doc_id, md5({_NORM}) AS digest FROM documents"
ORACLES["anchor_context"] = "SELECT page_id, md5(substr(html, greatest(1, instr(html, '<article>') - 50), instr(html, '<article>') - greatest(1, instr(html, '<article>') - 50) + 300)) AS digest FROM pages"
ORACLES["page_hash"] = "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages"
ORACLES["quote_containment"] = "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"

_BM25 = f"""q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT doc_id, {_tok('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM w),
tf AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM w) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
hits AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2),
top AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM hits UNION ALL
  (SELECT q.item_id, d.doc_id, 0.0 FROM (SELECT DISTINCT item_id FROM q) q CROSS JOIN documents d ANTI JOIN hits h ON h.item_id = q.item_id AND h.doc_id = d.doc_id)) QUALIFY rank <= 20)"""
_GOLD = """two AS (SELECT item_id, doc_id, lang, source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gold AS (SELECT item_id, doc_id, max(g) AS relevance FROM (SELECT item_id, doc_id, 2 AS g FROM two UNION ALL
  SELECT t.item_id, d.doc_id, 1 FROM (SELECT DISTINCT item_id, lang, source FROM two) t JOIN documents d ON d.lang = t.lang AND d.source = t.source) GROUP BY 1, 2)"""


def _metrics(run: str, item: str, top: str = "top") -> str:
    """Metrics of the ranking ``top`` against ``gold``, as the relation ``m``."""
    return f"""ideal AS (SELECT {run}, count(*) FILTER (relevance >= 1) AS pos, count(*) FILTER (relevance >= 2) AS strong, sum(CASE WHEN place <= 10 THEN (pow(2, relevance) - 1) / log2(place + 1) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY {run} ORDER BY relevance DESC, {item}) AS place FROM gold) GROUP BY 1),
h AS (SELECT t.*, coalesce(relevance, 0) AS g FROM {top} t LEFT JOIN gold USING ({run}, {item})),
per AS (SELECT {run}, count(*) FILTER (rank <= 5 AND g >= 1) AS h5, count(*) FILTER (rank <= 10 AND g >= 1) AS h10, count(*) FILTER (rank <= 20 AND g >= 1) AS h20, count(*) FILTER (rank <= 10 AND g >= 2) AS s10,
  count(*) FILTER (rank <= 10) AS shown, sum(CASE WHEN rank <= 10 THEN (pow(2, g) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1),
m AS (SELECT {run}, h5 / nullif(pos, 0)::DOUBLE AS recall5, h10 / nullif(pos, 0)::DOUBLE AS recall10, h20 / nullif(pos, 0)::DOUBLE AS recall20, s10 / nullif(strong, 0)::DOUBLE AS strong_recall10, dcg / nullif(idcg, 0) AS ndcg10,
  (shown - h10) / nullif(shown, 0)::DOUBLE AS irrelevant10, least(10, pos) / nullif(pos, 0)::DOUBLE AS recall_ceiling FROM per LEFT JOIN ideal USING ({run}))"""


_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in ("recall5", "recall10", "recall20", "strong_recall10", "ndcg10", "irrelevant10", "recall_ceiling"))
_DENSE_TOP = """dt AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS own, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 QUALIFY rank <= 20)"""
ORACLES["bm25_topk"] = f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM top"
ORACLES["bm25_metrics"] = f"WITH {_BM25}, {_GOLD}, {_metrics('item_id', 'doc_id')} SELECT item_id, {_COLS} FROM m"
ORACLES["dense_topk"] = f"WITH {_DENSE_TOP} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM dt"
ORACLES["dense_metrics"] = f"WITH {_DENSE_TOP}, gold AS (SELECT q.vec_id AS query_id, e.vec_id, CASE WHEN q.vec_id = e.vec_id THEN 2 ELSE 1 END AS relevance FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.label = e.label), {_metrics('query_id', 'vec_id', 'dt')} SELECT query_id, {_COLS} FROM m"
ORACLES["rrf_fusion"] = f"WITH {_DENSE_TOP}, f AS (SELECT own AS run_label, vec_id, round(sum(1 / (60.0::DOUBLE + rank)), 12) AS score FROM dt GROUP BY 1, 2) SELECT run_label, vec_id, round(score, 9) AS score, row_number() OVER (PARTITION BY run_label ORDER BY score DESC, vec_id) AS rank FROM f QUALIFY rank <= 20"
ORACLES["retriever_union"] = f"WITH {_BM25}, {_DENSE_TOP} SELECT 'bm25' AS retriever, item_id AS run, doc_id AS item, rank FROM top UNION ALL SELECT 'dense', query_id, vec_id, rank FROM dt"
_CUT = r"""cut AS (SELECT item_id, CASE WHEN len(x) > 6 THEN array_to_string(x[1:6], '') ELSE text END AS text FROM (SELECT item_id, text, regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*') AS x FROM benchmark))"""
ORACLES["recovery_lost_sets"] = f"""WITH {_GOLD}, {_CUT}, a AS (WITH {_BM25} SELECT item_id, doc_id FROM top SEMI JOIN gold USING (item_id, doc_id) WHERE rank <= 10),
b AS (WITH {_BM25.replace('FROM benchmark', 'FROM cut')} SELECT item_id, doc_id FROM top SEMI JOIN gold USING (item_id, doc_id) WHERE rank <= 10)
SELECT item_id, doc_id, CASE WHEN b.doc_id IS NULL THEN 'lost' WHEN a.doc_id IS NULL THEN 'recovered' ELSE 'both' END AS status FROM a FULL JOIN b USING (item_id, doc_id)"""
ORACLES["top_missed_items"] = f"WITH {_BM25}, {_GOLD} SELECT doc_id, count(*) AS missed FROM gold g ANTI JOIN (SELECT * FROM top WHERE rank <= 10) t ON t.item_id = g.item_id AND t.doc_id = g.doc_id WHERE relevance = 2 GROUP BY 1 ORDER BY missed DESC, doc_id LIMIT 4"
ORACLES["case_level_mean"] = f"WITH {_BM25}, {_GOLD}, {_metrics('item_id', 'doc_id')} SELECT item_id // 4 AS case_id, round(avg(ndcg10), 6) AS ndcg10, count(ndcg10) AS ndcg10_valid, count(*) AS repeats FROM m GROUP BY 1"
ORACLES["summary_grouping_sets"] = "SELECT lang, source, grouping(lang, source)::BIGINT AS grouping, round(avg(n_chars), 6) AS size, count(n_chars) AS size_valid FROM documents GROUP BY GROUPING SETS ((), (lang), (source))"
ORACLES["item_group_breakdown"] = f"WITH {_BM25}, p AS (SELECT item_id, lang, count(*) / 10.0::DOUBLE AS share FROM top JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY 1, 2) SELECT lang, round(avg(share), 6) AS share, count(*) AS cases FROM p GROUP BY 1"
_DIFFS = "m AS (SELECT event_type, user_id % 200 AS case_id, avg(value) AS m FROM events GROUP BY 1, 2), dif AS (SELECT case_id, x.event_type AS a, y.event_type AS b, y.m - x.m AS diff FROM m x JOIN m y USING (case_id) WHERE x.event_type < y.event_type)"
ORACLES["method_pair_diff"] = f"WITH {_DIFFS} SELECT a, b, round(avg(diff), 6) AS mean_diff, count(*) AS cases FROM dif GROUP BY 1, 2"
ORACLES["cluster_bootstrap_ci"] = f"""WITH {_DIFFS}, c AS (SELECT sum(diff) AS s, count(diff) AS c, row_number() OVER (ORDER BY case_id // 8) - 1 AS k FROM dif GROUP BY case_id // 8),
n AS (SELECT count(*) AS n, sum(s) / sum(c) AS mean FROM c), g AS (SELECT d.draw, mean, {_H.format("'1729|' || d.draw || '|' || j.j")} % n AS k FROM n CROSS JOIN (SELECT unnest(range(500)) AS draw) d CROSS JOIN LATERAL (SELECT unnest(range(n)) AS j) j),
b AS (SELECT draw, mean, sum(s) / sum(c) AS m FROM g JOIN c USING (k) GROUP BY 1, 2)
SELECT round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS draws FROM b GROUP BY mean"""
ORACLES["matched_pair_jaccard"] = f"""WITH {_BM25}, s AS (SELECT item_id, list(doc_id) AS s FROM top WHERE rank <= 10 GROUP BY 1), p AS (SELECT a.item_id AS left_id, a.s AS x, b.s AS y, len(list_intersect(a.s, b.s)) AS i FROM s a JOIN s b ON a.item_id % 2 = 0 AND b.item_id = a.item_id + 1)
SELECT left_id, round(i / (len(x) + len(y) - i)::DOUBLE, 6) AS jaccard, (len(x) - i)::BIGINT AS only_left, (len(y) - i)::BIGINT AS only_right FROM p"""

ORACLES["daily_series"] = f"WITH {_DAILY} SELECT user_id, day::VARCHAR AS day, round(value, 6) AS value, events::BIGINT AS events FROM daily"
ORACLES["daily_densified"] = f"WITH {_DENSE} SELECT user_id, day::VARCHAR AS day, round(value, 6) AS value FROM dense"
ORACLES["descriptive_stats"] = f"""WITH {_DENSE}, x AS (SELECT *, (day - DATE '1970-01-01')::DOUBLE AS x FROM dense)
SELECT user_id, count(value) AS valid_count, count(*) FILTER (value IS NULL) AS missing_count, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(var_pop(value), 4) AS variance, round(min(value), 4) AS min, round(max(value), 4) AS max,
round(covar_pop(value, x) / nullif(var_pop(CASE WHEN value IS NOT NULL THEN x END), 0), 4) AS slope FROM x GROUP BY 1"""
_N = "(day - DATE '2024-01-01')"
ORACLES["mean_difference"] = f"WITH {_DAILY}, m AS (SELECT user_id, avg(value) FILTER ({_N} < 20) AS b, avg(value) FILTER ({_N} >= 20) AS w FROM daily GROUP BY 1) SELECT user_id, round(w - b, 6) AS difference, round((w - b) / nullif(b, 0), 6) AS relative FROM m"
ORACLES["weekday_weekend_stats"] = f"WITH {_DAILY} SELECT user_id, CASE WHEN isodow(day) <= 5 THEN 'weekday' ELSE 'weekend' END AS kind, round(avg(value), 6) AS mean, count(value) AS days FROM daily GROUP BY 1, 2"


def _lag(left: str, right: str, source: str = "daily") -> str:
    return f"lagged AS (SELECT a.user_id, a.{left} AS x, b.{right} AS y FROM {source} a JOIN daily b ON a.user_id = b.user_id AND b.day = a.day + 1 WHERE a.{left} IS NOT NULL AND b.{right} IS NOT NULL)"


ORACLES["lagged_pearson"] = f"WITH {_DAILY}, {_lag('value', 'events')} SELECT user_id, count(*) AS pairs, round(CASE WHEN count(*) >= 3 THEN greatest(-1, least(1, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0))) END, 5) AS r FROM lagged GROUP BY 1"
ORACLES["adjacent_abs_delta"] = f"WITH {_DAILY}, {_lag('value', 'value')} SELECT user_id, round(avg(abs(y - x)), 6) AS delta FROM lagged GROUP BY 1"
ORACLES["half_window_means"] = f"WITH {_DAILY} SELECT user_id, round(avg(value) FILTER ({_N} < 7), 6) AS first_half, round(avg(value) FILTER ({_N} BETWEEN 23 AND 29), 6) AS last_half FROM daily GROUP BY 1"
ORACLES["longest_run"] = f"WITH {_DAILY}, i AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS island FROM daily WHERE value > 50), n AS (SELECT user_id, count(*) AS n FROM i GROUP BY user_id, island) SELECT user_id, max(n) AS longest_run_days FROM n GROUP BY 1"
ORACLES["circular_clock_mean"] = f"WITH a AS (SELECT user_id, avg(sin({_MIN} * (2 * pi() / 1440))) AS s, avg(cos({_MIN} * (2 * pi() / 1440))) AS c FROM events GROUP BY 1), m AS (SELECT *, atan2(s, c) * (1440 / (2 * pi())) AS t FROM a) SELECT user_id, round(CASE WHEN t < 0 THEN t + 1440 ELSE t END, 3) AS minute, round(sqrt(s * s + c * c), 6) AS resultant FROM m"
ORACLES["clock_range_from_noon"] = f"WITH m AS (SELECT user_id, ({_MIN} + 720) % 1440 AS m FROM events) SELECT user_id, min(m) AS least, max(m) AS most, max(m) - min(m) AS span FROM m GROUP BY 1"
ORACLES["conditional_next_day_mean"] = f"WITH {_DAILY}, e AS (SELECT user_id, ts::DATE AS day, (max(hour(ts)) >= 18)::INTEGER AS evening FROM events GROUP BY 1, 2), {_lag('evening', 'value', 'e')} SELECT user_id, round(avg(y) FILTER (x = 1), 6) AS after_evening, round(avg(y) FILTER (x = 0), 6) AS after_other FROM lagged GROUP BY 1"
ORACLES["baseline_extrema_overlap"] = f"WITH {_DAILY}, b AS (SELECT user_id, max(value) AS hi, min(value) AS lo FROM daily WHERE {_N} < 20 GROUP BY 1) SELECT user_id, count(*) FILTER (value > hi) AS above, count(*) FILTER (value < lo) AS below FROM daily JOIN b USING (user_id) WHERE {_N} >= 20 GROUP BY 1"
ORACLES["fixed_windows_phases"] = f"WITH {_DAILY} SELECT user_id, ({_N} // 15)::INTEGER AS block, CASE WHEN {_N} % 15 < 10 THEN 'baseline' ELSE 'current' END AS phase, count(*) AS days FROM daily GROUP BY 1, 2, 3"
ORACLES["observed_day_coverage"] = f"WITH {_DENSE} SELECT user_id, count(value) AS observed, count(*) AS days, count(value) >= 20 AS included FROM dense GROUP BY 1"

_MINUTES = "epoch_us({b}) - epoch_us({a})"
ORACLES["interval_day_minutes"] = f"""WITH {_SPANS}, x AS (SELECT *, unnest(generate_series(start_at::DATE, greatest(end_at - INTERVAL 1 MICROSECOND, start_at)::DATE, INTERVAL 1 DAY))::DATE AS day FROM spans),
m AS (SELECT user_id, day, greatest(0, (epoch_us(least(end_at, (day + 1)::TIMESTAMP)) - epoch_us(greatest(start_at, day::TIMESTAMP))) / 60e6) AS m FROM x) SELECT user_id, day::VARCHAR AS day, round(sum(m), 6) AS minutes FROM m GROUP BY user_id, m.day HAVING sum(m) > 0"""
ORACLES["interval_overlap_pairs"] = f"WITH {_SPANS} SELECT a.user_id, a.id AS left_id, b.id AS right_id, round((epoch_us(least(a.end_at, b.end_at)) - epoch_us(greatest(a.start_at, b.start_at))) / 60e6, 6) AS minutes FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND greatest(a.start_at, b.start_at) < least(a.end_at, b.end_at)"
ORACLES["interval_gaps"] = f"WITH {_SPANS}, g AS (SELECT user_id, max(end_at) OVER (PARTITION BY user_id ORDER BY start_at, end_at ROWS UNBOUNDED PRECEDING) AS a, lead(start_at) OVER (PARTITION BY user_id ORDER BY start_at, end_at) AS b FROM spans) SELECT user_id, count(*) AS gaps, round(max((epoch_us(b) - epoch_us(a)) / 60e6), 3) AS longest FROM g WHERE b > a GROUP BY 1"
ORACLES["bout_structure"] = f"WITH {_SPANS}, p AS (SELECT user_id, start_at::DATE AS day, sum((epoch_us(end_at) - epoch_us(start_at)) / 60e6) AS total, max((epoch_us(end_at) - epoch_us(start_at)) / 60e6) AS longest, count(*) AS n FROM spans GROUP BY 1, 2) SELECT user_id, round(avg(longest), 6) AS mean_longest, round(avg(total), 6) AS mean_total, max(n) AS most_bouts FROM p GROUP BY 1"

_RATERS = "ra AS (SELECT doc_id, lang, least(2, n_chars // 1500)::INTEGER AS a, least(2, len(string_split(text, ' ')) // 250)::INTEGER AS b FROM documents)"


def _kappa(rows: str, a: str, b: str, levels: list[int], keys: str = "", weighted: bool = True) -> str:
    d = f"abs({a} - {b}) / {max(levels) - min(levels)}.0::DOUBLE" if weighted else f"({a} <> {b})::INTEGER::DOUBLE"
    chance = " + ".join(f"count(*) FILTER ({a} = {x}) * count(*) FILTER ({b} = {y}) * {abs(x - y) / (max(levels) - min(levels)) if weighted else float(x != y)}::DOUBLE" for x in levels for y in levels)
    k = keys + ", " if keys else ""
    return f"SELECT {k}count(*) AS n, round(count(*) FILTER ({a} = {b}) / count(*)::DOUBLE, 6) AS exact, round(1 - avg({d}) / nullif(({chance}) / (count(*) * count(*))::DOUBLE, 0), 6) AS kappa FROM {rows}" + (f" GROUP BY {keys}" if keys else "")


ORACLES["ordinal_kappa"] = f"WITH {_RATERS} {_kappa('ra', 'a', 'b', [0, 1, 2])}"
ORACLES["nominal_kappa"] = _kappa("labels", "quality", "toxic", [0, 1], weighted=False)
ORACLES["agreement_by_group"] = f"WITH {_RATERS} {_kappa('ra', 'a', 'b', [0, 1, 2], 'lang')}"
ORACLES["macro_f1"] = f"""WITH {_RATERS}, p AS (SELECT l.label, count(*) FILTER (a = label AND b = label) AS tp, count(*) FILTER (b = label) AS pp, count(*) FILTER (a = label) AS support FROM ra CROSS JOIN (SELECT unnest([0, 1, 2]) AS label) l GROUP BY 1),
f AS (SELECT label, support, coalesce(tp / nullif(pp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS re, coalesce(2 * tp / nullif(pp + support, 0)::DOUBLE, 0) AS f1 FROM p)
SELECT label, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(avg(f1) OVER (), 6) AS macro_f1 FROM f"""
ORACLES["judged_pool_metrics"] = f"WITH {_BM25} SELECT item_id, round(count(quality) / count(*)::DOUBLE, 6) AS judged, round(avg(quality::DOUBLE), 6) AS good FROM top LEFT JOIN labels USING (doc_id) GROUP BY 1"
ORACLES["category_distribution"] = "WITH k AS (SELECT unnest(['click', 'view', 'purchase', 'absent']) AS event_type), n AS (SELECT event_type, count(e.event_id) AS n FROM k LEFT JOIN events e USING (event_type) GROUP BY 1) SELECT event_type, n, round(n / nullif(sum(n) OVER (), 0)::DOUBLE, 6) AS share FROM n"
ORACLES["token_usage_grouping_sets"] = f"WITH t AS (SELECT role, conv_id % 7 AS scope, len({_tok('text')}) AS tokens FROM conversations) SELECT role, scope, sum(tokens)::BIGINT AS tokens, count(*) AS turns FROM t GROUP BY GROUPING SETS ((), (role), (scope))"
ORACLES["missing_pairs"] = f"WITH {_DENSE} SELECT 'missing' AS rule, user_id || '|' || day AS key, 'absent' AS detail FROM dense WHERE value IS NULL"
ORACLES["matrix_violations"] = """SELECT 'missing' AS rule, doc_id::VARCHAR AS key, 'absent' AS detail FROM (SELECT DISTINCT doc_id FROM documents) ANTI JOIN labels USING (doc_id)
UNION ALL SELECT 'duplicate', lang || '|' || source, count(*)::VARCHAR FROM documents GROUP BY lang, source HAVING count(*) > 50 UNION ALL SELECT 'length', doc_id::VARCHAR, n_chars::VARCHAR FROM documents WHERE n_chars < 20"""
ORACLES["duplicate_conflict_withhold"] = "SELECT user_id, ts::DATE::VARCHAR AS day, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS event_type, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'repeated' END AS flag FROM events GROUP BY 1, 2"
ORACLES["multiset_equal_pairs"] = "WITH p AS (SELECT l_orderkey // 2 AS pair, list_sort(list(l_quantity) FILTER (l_orderkey % 2 = 0)) AS x, list_sort(list(l_quantity) FILTER (l_orderkey % 2 = 1)) AS y FROM lineitem GROUP BY 1) SELECT pair, x = y AS equal, len(x)::BIGINT AS n FROM p WHERE len(x) > 0 AND len(y) > 0"
ORACLES["changed_hashes"] = """WITH o AS (SELECT doc_id, md5(text) AS x FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, md5(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS y FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id) WHERE x IS DISTINCT FROM y"""
ORACLES["seeded_shuffle_batches"] = "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('seed-7|' || doc_id), doc_id) - 1) // 16 AS batch FROM documents"
ORACLES["fact_ledger_text"] = f"WITH {_DENSE} SELECT user_id, string_agg(strftime(day, '%Y-%m-%d') || ' ' || coalesce(rtrim(rtrim(printf('%.6f', round(value, 2)), '0'), '.'), 'null'), chr(10) ORDER BY day) AS ledger FROM dense GROUP BY 1"
ORACLES["kleene_applicability"] = """WITH j AS (SELECT doc_id, quality = 1 AS good, toxic = 1 AS tox, n_chars > 1500 AS lng FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT doc_id, (NOT tox) AND (CASE WHEN lng IS NULL THEN NULL WHEN NOT lng THEN TRUE ELSE good END) AND (good OR lng) AS c FROM j)
SELECT doc_id, CASE WHEN c THEN 'applicable' WHEN NOT c THEN 'not_applicable' ELSE 'insufficient_information' END AS status FROM c"""
ORACLES["preference_closure"] = """WITH RECURSIVE e AS (SELECT DISTINCT x, y FROM (SELECT n_nationkey AS x, unnest([n_nationkey * 2 % 25, (n_nationkey + 7) % 25]) AS y FROM nation) WHERE x <> y),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x, y FROM r"""
ORACLES["retention_probe"] = f"""WITH p AS (SELECT doc_id, contains(lower(text), 'license') AS a, contains(lower(text), 'version') AS c, len(list_filter({_NUM}, lambda x: abs(x - 2.0) <= 0.05)) > 0 AS n FROM documents)
SELECT doc_id, a AS alias_hit, c AS cue_hit, n AS number_hit, a AND (c OR n) AS candidate FROM p"""
ORACLES["number_extraction"] = f"WITH n AS (SELECT doc_id, {_NUM} AS n FROM documents) SELECT doc_id, len(n)::BIGINT AS numbers, list_max(n) AS largest FROM n WHERE len(n) > 0"
ORACLES["ranking_violations"] = "SELECT 'size' AS rule, '' AS key, '' AS detail WHERE FALSE"
# RE2 has no look-ahead: a token ends where the next one can't begin, so the text is cut into tokens with what precedes them
ORACLES["truncate_query"] = r"""WITH t AS (SELECT item_id, text, regexp_extract_all(text, '[^\p{L}\p{N}]*[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*') AS x FROM benchmark) SELECT item_id, CASE WHEN len(x) > 12 THEN array_to_string(x[1:12], '') ELSE text END AS text FROM t"""
ORACLES["greedy_pack"] = """WITH RECURSIVE o AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY -octet_length(encode(text)), turn) AS k FROM conversations),
p AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT conv_id FROM o) UNION ALL
  SELECT p.conv_id, o.k, CASE WHEN used + n <= 600 THEN used + n ELSE used END, CASE WHEN used + n <= 600 THEN list_append(kept, turn) ELSE kept END FROM p JOIN o ON o.conv_id = p.conv_id AND o.k = p.k + 1)
SELECT conv_id, used AS bytes, array_to_string(list_sort(kept), ',') AS turns FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1"""
