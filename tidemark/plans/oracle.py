"""The same results in SQL."""

from __future__ import annotations

_TYPE_ID = "CASE type WHEN 'clicks' THEN 1 WHEN 'carts' THEN 2 WHEN 'orders' THEN 3 ELSE 0 END"
_KINDS = "(SELECT unnest(['clicks', 'carts', 'orders']) AS type)"

#: Named parts; each uses those before it.
PARTS = {
    "ev": """SELECT user_id AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS aid, ts, event_id AS seq,
        CASE event_type WHEN 'signup' THEN 'carts' WHEN 'purchase' THEN 'orders' ELSE 'clicks' END AS type
        FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')""",
    "ord": """SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) - 1 AS pos, count(*) OVER (PARTITION BY session) AS n FROM ev""",
    "spl": """SELECT *, pos >= least(greatest(CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT), 1), n - 1) AS future FROM ord WHERE n >= 2""",
    "hist": f"""SELECT session, aid, ts, seq, type, {_TYPE_ID} AS tid, row_number() OVER (PARTITION BY session ORDER BY ts, seq) - 1 AS pos,
        count(*) OVER (PARTITION BY session) AS n FROM spl WHERE NOT future""",
    "lab": """SELECT session, type, aid, min(pos) AS fp FROM spl WHERE future GROUP BY session, type, aid""",
    "labels_": """SELECT session, type, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY fp, aid) AS labels, count(*) AS c FROM lab GROUP BY session, type""",
    "tgt": f"""SELECT session, type, {_TYPE_ID} AS tid FROM labels_""",
    "typed": """SELECT type, aid, cnt, row_number() OVER (PARTITION BY type ORDER BY cnt DESC, aid) AS rk FROM (SELECT type, aid, count(*) AS cnt FROM hist GROUP BY type, aid)""",
    "best": """SELECT aid, row_number() OVER (ORDER BY cnt DESC, aid) AS rk FROM (SELECT aid, count(*) AS cnt FROM hist GROUP BY aid)""",
    "popl": f"""SELECT type, aid, row_number() OVER (PARTITION BY type ORDER BY s, r) AS rk FROM (
        SELECT type, aid, 0 AS s, rk AS r FROM typed WHERE rk <= {{k}} UNION ALL
        SELECT t.type, g.aid, 1, g.rk FROM best g CROSS JOIN {_KINDS} t LEFT JOIN (SELECT * FROM typed WHERE rk <= {{k}}) y ON y.type = t.type AND y.aid = g.aid
        WHERE g.rk <= {{k}} AND y.aid IS NULL)""",
    "popsrc": """SELECT session, tgt.type, aid, rk FROM tgt JOIN popl ON popl.type = tgt.type WHERE rk <= {k}""",
    "lim": """SELECT session, aid, count(*) AS c FROM hist WHERE n - pos <= 30 GROUP BY session, aid""",
    "pairs": """SELECT a.aid, b.aid AS neighbor, CAST(sum(a.c * b.c) AS BIGINT) AS cnt FROM lim a JOIN lim b ON a.session = b.session AND a.aid <> b.aid GROUP BY a.aid, b.aid""",
    "edges": """SELECT aid, neighbor, cnt, row_number() OVER (PARTITION BY aid ORDER BY cnt DESC, neighbor) AS rk FROM pairs""",
    "covs": """SELECT h.session, e.neighbor AS aid, round(sum(e.cnt * h.w), 6) AS score
        FROM (SELECT session, aid, sum(CAST(1 AS DOUBLE) / (n - pos)) AS w FROM hist GROUP BY session, aid) h
        JOIN edges e ON e.aid = h.aid WHERE e.rk <= 50 GROUP BY h.session, e.neighbor""",
    "covr": """SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, aid) AS rk FROM covs""",
    "covsrc": """SELECT tgt.session, tgt.type, aid, rk, score FROM tgt JOIN covr ON covr.session = tgt.session WHERE rk <= {k}""",
    "raw": """SELECT vec_id AS aid, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""",
    "iv": """SELECT * FROM raw WHERE aid IN (SELECT aid FROM hist)""",
    "iu": """SELECT aid, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY aid)), 1e-12) AS x FROM iv""",
    "tv": """SELECT CASE aid WHEN 1 THEN 'clicks' WHEN 2 THEN 'carts' ELSE 'orders' END AS type, d, x FROM raw WHERE aid BETWEEN 1 AND 3""",
    "hk": """SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS place, count(*) OVER (PARTITION BY session) AS m FROM hist WHERE aid IN (SELECT aid FROM iv)""",
    "sv0": """SELECT hk.session, iv.d, sum(CAST(hk.place AS DOUBLE) / (CAST(hk.m AS DOUBLE) * (hk.m + 1) / 2) * (iv.x + tv.x)) AS x
        FROM hk JOIN iv ON iv.aid = hk.aid JOIN tv ON tv.type = hk.type AND tv.d = iv.d GROUP BY hk.session, iv.d""",
    "sv1": """SELECT tgt.session, tgt.type, sv0.d, sv0.x + tv.x AS x FROM tgt JOIN sv0 ON sv0.session = tgt.session JOIN tv ON tv.type = tgt.type AND tv.d = sv0.d""",
    "sv": """SELECT session, type, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY session, type)), 1e-12) AS x FROM sv1""",
    "vsc": """SELECT sv.session, sv.type, iu.aid, round(sum(sv.x * iu.x), 6) AS score FROM sv JOIN iu ON iu.d = sv.d GROUP BY sv.session, sv.type, iu.aid""",
    "vsr": """SELECT *, row_number() OVER (PARTITION BY session, type ORDER BY score DESC, aid) AS rk FROM vsc""",
    "vecsrc": """SELECT session, type, aid, rk, score FROM vsr WHERE rk <= {k}""",
    "src": """SELECT 'popular' AS source, session, type, aid, rk FROM popsrc UNION ALL SELECT 'covis', session, type, aid, rk FROM covsrc UNION ALL SELECT 'dssm', session, type, aid, rk FROM vecsrc""",
    "pool0": """SELECT session, type, aid, coalesce(min(CASE WHEN source = 'popular' THEN rk END), 0) AS popular_rank,
        coalesce(min(CASE WHEN source = 'covis' THEN rk END), 0) AS covis_rank, coalesce(min(CASE WHEN source = 'dssm' THEN rk END), 0) AS dssm_rank FROM src GROUP BY session, type, aid""",
    "pool1": """SELECT *, CASE WHEN popular_rank > 0 THEN CAST(1 AS DOUBLE) / popular_rank ELSE 0 END AS popular_score, CASE WHEN covis_rank > 0 THEN CAST(1 AS DOUBLE) / covis_rank ELSE 0 END AS covis_score,
        CASE WHEN dssm_rank > 0 THEN CAST(1 AS DOUBLE) / dssm_rank ELSE 0 END AS dssm_score FROM pool0""",
    "pool": f"""SELECT *, popular_score + covis_score + dssm_score AS rrf_score, {_TYPE_ID} AS target_type_id,
        CAST(popular_rank > 0 AS INT) + CAST(covis_rank > 0 AS INT) + CAST(dssm_rank > 0 AS INT) AS source_count,
        least(CASE WHEN popular_rank > 0 THEN popular_rank ELSE 9999 END, CASE WHEN covis_rank > 0 THEN covis_rank ELSE 9999 END, CASE WHEN dssm_rank > 0 THEN dssm_rank ELSE 9999 END) AS min_rank FROM pool1""",
    "istat": """SELECT aid, count(*) AS item_popularity, count(*) FILTER (type = 'clicks') AS item_clicks_count, count(*) FILTER (type = 'carts') AS item_carts_count, count(*) FILTER (type = 'orders') AS item_orders_count FROM hist GROUP BY aid""",
    "sstat": """SELECT session, count(*) AS session_len, count(*) FILTER (type = 'clicks') AS session_clicks_count, count(*) FILTER (type = 'carts') AS session_carts_count, count(*) FILTER (type = 'orders') AS session_orders_count FROM hist GROUP BY session""",
    "hstat": """SELECT session, aid, count(*) AS session_aid_count, min(n - pos - 1) AS aid_last_pos_from_end, arg_max(tid, pos) AS aid_last_type_id FROM hist GROUP BY session, aid""",
}


def sql(body: str, k: int = 50) -> str:
    """``body`` with all parts in front of it that it may use."""
    needed: list[str] = []

    def want(text: str) -> None:
        import re

        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text):
            if name in PARTS and name not in needed:
                want(PARTS[name])
                needed.append(name)

    want(body)
    parts = ", ".join(f"{n} AS ({PARTS[n].format(k=k)})" for n in needed)
    return f"WITH {parts} {body}" if parts else body


_POOL = """CAST(popular_rank > 0 AS DOUBLE) AS from_popular, CAST(popular_rank AS DOUBLE) AS popular_rank, round(popular_score, 6) AS popular_score,
    CAST(covis_rank > 0 AS DOUBLE) AS from_covis, CAST(covis_rank AS DOUBLE) AS covis_rank, round(covis_score, 6) AS covis_score,
    CAST(dssm_rank > 0 AS DOUBLE) AS from_dssm, CAST(dssm_rank AS DOUBLE) AS dssm_rank, round(dssm_score, 6) AS dssm_score,
    CAST(source_count AS DOUBLE) AS source_count, CAST(min_rank AS DOUBLE) AS min_rank, round(rrf_score, 6) AS rrf_score, CAST(target_type_id AS DOUBLE) AS target_type_id"""
_FLOATS = _POOL
for _c in ("popular_score", "covis_score", "dssm_score", "rrf_score"):
    _FLOATS = _FLOATS.replace(f"round({_c}, 6)", f"round(CAST(CAST({_c} AS FLOAT) AS DOUBLE), 6)")
_LISTS = "string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY rk)"
_FUSED = """, weights AS ({weights}),
    fu AS (SELECT g, src.session, src.type, aid, round(sum(w / rk), 6) AS score FROM src JOIN weights ON weights.source = src.source GROUP BY g, src.session, src.type, aid),
    ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, session, type ORDER BY score DESC, aid) AS rk FROM fu) WHERE rk <= 20),
    fb AS (SELECT aid, rk FROM popsrc WHERE rk <= 20 AND session = (SELECT min(session) FROM popsrc) AND type = (SELECT min(type) FROM popsrc WHERE session = (SELECT min(session) FROM popsrc))),
    gg AS (SELECT DISTINCT g FROM weights),
    fl AS (SELECT * FROM (SELECT g, session, type, aid, row_number() OVER (PARTITION BY g, session, type ORDER BY s, r) AS rk FROM (
        SELECT g, session, type, aid, 0 AS s, rk AS r FROM ft UNION ALL
        SELECT gg.g, tgt.session, tgt.type, fb.aid, 1, fb.rk FROM gg CROSS JOIN tgt CROSS JOIN fb LEFT JOIN ft ON ft.g = gg.g AND ft.session = tgt.session AND ft.type = tgt.type AND ft.aid = fb.aid WHERE ft.aid IS NULL)) WHERE rk <= 20)"""
_W1 = "SELECT 0 AS g, unnest(['popular', 'covis', 'dssm']) AS source, unnest([CAST(0.1 AS DOUBLE), CAST(2.5 AS DOUBLE), CAST(0.6 AS DOUBLE)]) AS w"
_COMBOS = """SELECT p * 1000000 + c * 1000 + d AS g, CAST(p AS DOUBLE) / 10 AS pw, CAST(c AS DOUBLE) / 10 AS cw, CAST(d AS DOUBLE) / 10 AS dw FROM
    (SELECT unnest([1, 2]) AS p) CROSS JOIN (SELECT unnest([10, 15, 20]) AS c) CROSS JOIN (SELECT unnest([5, 8, 10, 15]) AS d)"""
_WG = "SELECT g, 'popular' AS source, pw AS w FROM combos UNION ALL SELECT g, 'covis', cw FROM combos UNION ALL SELECT g, 'dssm', dw FROM combos"


def _with(body: str, extra: str, k: int = 50) -> str:
    """A query with own parts after the shared ones."""
    full = sql(extra.lstrip(", ") + " " + body, k)
    cut = full.index(extra.lstrip(", "))
    return full[:cut].rstrip() + ", " + full[cut:]


def _recall(lists: str, extra: str = "", k: int = 20) -> str:
    return f""", kinds AS (SELECT 'clicks' AS type, CAST(0.1 AS DOUBLE) AS weight UNION ALL SELECT 'carts', CAST(0.3 AS DOUBLE) UNION ALL SELECT 'orders', CAST(0.6 AS DOUBLE)),
    hit AS (SELECT lab.session, lab.type, count(*) AS h FROM lab JOIN {lists} x ON x.session = lab.session AND x.type = lab.type AND x.aid = lab.aid WHERE x.rk <= {k} GROUP BY lab.session, lab.type),
    rowz AS (SELECT labels_.type, CAST(least(coalesce(h, 0), 20) AS BIGINT) AS h, CAST(least(c, 20) AS BIGINT) AS d, CAST(coalesce(h, 0) > 0 AS BIGINT) AS cov FROM labels_ LEFT JOIN hit ON hit.session = labels_.session AND hit.type = labels_.type),
    byt AS (SELECT kinds.type, weight, count(d) AS rows, CAST(coalesce(sum(h), 0) AS BIGINT) AS hits, CAST(coalesce(sum(d), 0) AS BIGINT) AS denominator, CAST(coalesce(sum(cov), 0) AS BIGINT) AS covered FROM kinds LEFT JOIN rowz ON rowz.type = kinds.type GROUP BY kinds.type, weight),
    rec AS (SELECT *, CASE WHEN denominator > 0 THEN CAST(hits AS DOUBLE) / denominator ELSE 0 END AS recall FROM byt){extra}"""


def oracle_sql() -> dict[str, str]:
    grid = f", combos AS ({_COMBOS})" + _FUSED.format(weights=_WG)
    grid += """, bef AS (SELECT gg.g, tgt.session, tgt.type, count(ft.aid) AS n FROM gg CROSS JOIN tgt LEFT JOIN ft ON ft.g = gg.g AND ft.session = tgt.session AND ft.type = tgt.type GROUP BY gg.g, tgt.session, tgt.type),
        aft AS (SELECT gg.g, tgt.session, tgt.type, count(fl.aid) AS n FROM gg CROSS JOIN tgt LEFT JOIN fl ON fl.g = gg.g AND fl.session = tgt.session AND fl.type = tgt.type GROUP BY gg.g, tgt.session, tgt.type),
        hg AS (SELECT fl.g, lab.type, count(*) AS h FROM fl JOIN lab ON lab.session = fl.session AND lab.type = fl.type AND lab.aid = fl.aid GROUP BY fl.g, lab.type),
        dg AS (SELECT type, sum(least(c, 20)) AS d FROM labels_ GROUP BY type),
        rg AS (SELECT gg.g, dg.type, CAST(coalesce(h, 0) AS DOUBLE) / d AS r FROM gg CROSS JOIN dg LEFT JOIN hg ON hg.g = gg.g AND hg.type = dg.type),
        rp AS (SELECT g, coalesce(max(r) FILTER (type = 'clicks'), 0) AS c, coalesce(max(r) FILTER (type = 'carts'), 0) AS a, coalesce(max(r) FILTER (type = 'orders'), 0) AS o FROM rg GROUP BY g)"""
    return {
        "explode_events": sql("SELECT session, aid, epoch_us(ts) AS ts, pos AS seq, type FROM ord"),
        "split_history": sql("SELECT session, aid, seq, type FROM hist"),
        "split_labels": sql("SELECT session, type, labels FROM labels_"),
        "split_summary": sql("SELECT (SELECT count(DISTINCT session) FROM spl) AS sessions, (SELECT count(*) FROM spl WHERE NOT future) AS history_events, (SELECT count(*) FROM spl WHERE future) AS future_events, (SELECT count(DISTINCT session) FROM ord WHERE n < 2) AS skipped"),
        "target_rows": sql(f"SELECT session, t.type FROM (SELECT DISTINCT session FROM ev) s CROSS JOIN {_KINDS} t"),
        "session_item_lists": sql("SELECT session, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY pos) AS items FROM ord GROUP BY session"),
        "popular_topk": sql("SELECT type, aid, cnt, rk FROM typed WHERE rk <= 20"),
        "popular_recall": sql(f"SELECT session, type, {_LISTS} AS predictions FROM popsrc GROUP BY session, type", 20),
        "covis_pairs": sql("SELECT aid, neighbor, cnt FROM pairs"),
        "covis_topk": sql("SELECT aid, neighbor, cnt, rk FROM edges WHERE rk <= 20"),
        "covis_topk_sparse": """WITH j AS (SELECT o_custkey AS session, l_partkey AS aid, l_shipdate AS ts, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS tid FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
            o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, aid DESC, tid DESC) AS r FROM j), l AS (SELECT session, aid, count(*) AS c FROM o WHERE r <= 30 GROUP BY session, aid),
            p AS (SELECT a.aid, b.aid AS neighbor, CAST(sum(a.c * b.c) AS BIGINT) AS cnt FROM l a JOIN l b ON a.session = b.session AND a.aid <> b.aid GROUP BY a.aid, b.aid)
            SELECT * FROM (SELECT aid, neighbor, cnt, row_number() OVER (PARTITION BY aid ORDER BY cnt DESC, neighbor) AS rk FROM p) WHERE rk <= 20""",
        "covis_recall": sql(f"SELECT tgt.session, tgt.type, coalesce(p, '') AS predictions FROM tgt LEFT JOIN (SELECT session, type, {_LISTS} AS p FROM covsrc GROUP BY session, type) x ON x.session = tgt.session AND x.type = tgt.type", 20),
        "covis_details": sql("SELECT session, type, aid, rk AS rank, score AS covis_score FROM covsrc", 20),
        "session_vectors": sql("SELECT session, type, CAST(d AS BIGINT) AS d, round(x, 6) AS x FROM sv"),
        "vector_topk": sql("SELECT session, type, aid, rk AS rank, score AS dssm_score FROM vecsrc", 20),
        "item_similarity": """WITH raw AS (SELECT vec_id AS aid, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
            u AS (SELECT aid, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY aid)), 1e-12) AS x FROM raw),
            s AS (SELECT p.aid, q.aid AS neighbor, round(sum(p.x * q.x), 6) AS cosine FROM u p JOIN u q ON p.d = q.d WHERE p.aid % 20 = 0 AND p.aid <> q.aid GROUP BY p.aid, q.aid),
            r AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY cosine DESC, neighbor) AS rank FROM s)
            SELECT aid, neighbor, rank, cosine FROM r WHERE rank <= 20""",
        "label_counts": sql(f"SELECT k.type, count(c) AS rows, CAST(coalesce(sum(c), 0) AS BIGINT) AS items, round(coalesce(avg(c), 0), 6) AS mean_items FROM {_KINDS} k LEFT JOIN labels_ ON labels_.type = k.type GROUP BY k.type"),
        "vocabulary_counts": "SELECT count(*) AS events, count(v.vec_id) AS known, count(*) - count(v.vec_id) AS skipped FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = l_partkey",
        "matched_scores": sql("SELECT count(*) AS candidates, count(c.aid) AS matched FROM pool LEFT JOIN (SELECT session, type, aid FROM covsrc WHERE rk <= 20) c ON c.session = pool.session AND c.type = pool.type AND c.aid = pool.aid"),
        "session_holdout": sql("SELECT session FROM (SELECT session, row_number() OVER (ORDER BY md5(session || ':2024'), session) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM ev)) WHERE r <= greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT))"),
        "fusion_rrf": _with("SELECT tgt.session, tgt.type, p AS predictions, coalesce(n, 0) AS n_before FROM tgt JOIN (SELECT session, type, string_agg(CAST(aid AS VARCHAR), ' ' ORDER BY rk) AS p FROM fl GROUP BY session, type) x ON x.session = tgt.session AND x.type = tgt.type LEFT JOIN (SELECT session, type, count(*) AS n FROM ft GROUP BY session, type) y ON y.session = tgt.session AND y.type = tgt.type", _FUSED.format(weights=_W1)),
        "fusion_grid": _with("""SELECT combos.pw AS popular_weight, cw AS covis_weight, dw AS dssm_weight, round(rp.c, 6) AS clicks_recall, round(a, 6) AS carts_recall, round(o, 6) AS orders_recall, round(rp.c * CAST(0.1 AS DOUBLE) + a * CAST(0.3 AS DOUBLE) + o * CAST(0.6 AS DOUBLE), 6) AS weighted_score,
            (SELECT count(*) FROM bef WHERE bef.g = combos.g AND n < 20) AS underfilled_before_fallback, (SELECT count(*) FROM aft WHERE aft.g = combos.g AND n < 20) AS underfilled_after_fallback FROM combos JOIN rp ON rp.g = combos.g""", grid),
        "candidate_pool": sql(f"SELECT session, type, aid, {_POOL} FROM pool"),
        "candidate_raw_norm": sql("""SELECT pool.session, pool.type, pool.aid, round(coalesce(c.norm, 0), 6) AS covis_raw_score_norm, round(coalesce(v.norm, 0), 6) AS dssm_raw_score_norm FROM pool
            LEFT JOIN (SELECT session, type, aid, CASE WHEN mx > mn THEN (score - mn) / (mx - mn) ELSE 1 END AS norm FROM (SELECT *, max(score) OVER (PARTITION BY session, type) AS mx, min(score) OVER (PARTITION BY session, type) AS mn FROM covsrc)) c ON c.session = pool.session AND c.type = pool.type AND c.aid = pool.aid
            LEFT JOIN (SELECT session, type, aid, CASE WHEN mx > mn THEN (score - mn) / (mx - mn) ELSE 1 END AS norm FROM (SELECT *, max(score) OVER (PARTITION BY session, type) AS mx, min(score) OVER (PARTITION BY session, type) AS mn FROM vecsrc)) v ON v.session = pool.session AND v.type = pool.type AND v.aid = pool.aid"""),
        "candidate_summary": sql("SELECT count(*) AS candidates, count(DISTINCT (session, type)) AS groups, count(*) - count(DISTINCT (session, type, aid)) AS repeated, (SELECT count(*) FROM labels_) AS label_groups, round(CAST(count(*) AS DOUBLE) / count(DISTINCT (session, type)), 6) AS mean_candidates FROM pool"),
        "labels_attached": sql("SELECT pool.session, pool.type, pool.aid, CAST(lab.aid IS NOT NULL AS BIGINT) AS label FROM pool LEFT JOIN lab ON lab.session = pool.session AND lab.type = pool.type AND lab.aid = pool.aid"),
        "item_stats": sql("SELECT * FROM istat"),
        "session_stats": sql("SELECT * FROM sstat"),
        "history_features": sql("SELECT session, aid, session_aid_count, aid_last_pos_from_end, CAST(aid_last_type_id AS BIGINT) AS aid_last_type_id FROM hstat"),
        "ranker_features": sql(f"""SELECT pool.session, pool.type, pool.aid, {_FLOATS}, CAST(lab.aid IS NOT NULL AS DOUBLE) AS label,
            {', '.join(f'CAST(coalesce({c}, 0) AS DOUBLE) AS {c}' for c in ('item_popularity', 'item_clicks_count', 'item_carts_count', 'item_orders_count', 'session_len', 'session_clicks_count', 'session_carts_count', 'session_orders_count', 'session_aid_count'))},
            CAST(coalesce(aid_last_pos_from_end, -1) AS DOUBLE) AS aid_last_pos_from_end, CAST(coalesce(aid_last_type_id, 0) AS DOUBLE) AS aid_last_type_id, CAST(hstat.aid IS NOT NULL AS DOUBLE) AS in_session_history
            FROM pool LEFT JOIN lab ON lab.session = pool.session AND lab.type = pool.type AND lab.aid = pool.aid LEFT JOIN istat ON istat.aid = pool.aid LEFT JOIN sstat ON sstat.session = pool.session LEFT JOIN hstat ON hstat.session = pool.session AND hstat.aid = pool.aid"""),
        "inference_features": sql("""SELECT pool.session, pool.type, pool.aid, CAST(coalesce(item_popularity, 0) AS DOUBLE) AS item_popularity, CAST(coalesce(session_len, 0) AS DOUBLE) AS session_len, CAST(hstat.aid IS NOT NULL AS DOUBLE) AS in_session_history, CAST(coalesce(aid_last_pos_from_end, -1) AS DOUBLE) AS aid_last_pos_from_end
            FROM pool LEFT JOIN istat ON istat.aid = pool.aid LEFT JOIN sstat ON sstat.session = pool.session LEFT JOIN hstat ON hstat.session = pool.session AND hstat.aid = pool.aid"""),
        "topk_per_group": sql("SELECT * FROM (SELECT session, type, aid, row_number() OVER (PARTITION BY session, type ORDER BY round(rrf_score, 6) DESC, aid) AS rank FROM pool) WHERE rank <= 20"),
        "lists_from_scores": sql(f"SELECT session, type, {_LISTS} AS predictions FROM (SELECT session, type, aid, row_number() OVER (PARTITION BY session, type ORDER BY round(rrf_score, 6) DESC, aid) AS rk FROM pool) WHERE rk <= 20 GROUP BY session, type"),
        "eval_by_type": _with("SELECT type, rows, hits, denominator, round(recall, 6) AS recall, weight, round(recall * weight, 6) AS contribution FROM rec", _recall("covsrc"), 20),
        "eval_overall": _with("SELECT CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(denominator) AS BIGINT) AS denominator, round(CAST(sum(hits) AS DOUBLE) / sum(denominator), 6) AS recall, round(sum(recall * weight), 6) AS weighted_score FROM rec", _recall("popsrc"), 20),
        "oracle_recall": _with("SELECT type, rows, hits, denominator, covered, round(recall, 6) AS recall, round(recall * weight, 6) AS contribution FROM rec", _recall("(SELECT session, type, aid, 1 AS rk FROM pool)")),
        "submission": sql(f"SELECT session || '_' || type AS session_type, {_LISTS} AS labels FROM popsrc GROUP BY session, type", 20),
        "list_counters": sql("SELECT count(*) AS rows, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n < 20) AS underfilled FROM (SELECT tgt.session, tgt.type, count(covsrc.aid) AS n FROM tgt LEFT JOIN covsrc ON covsrc.session = tgt.session AND covsrc.type = tgt.type GROUP BY tgt.session, tgt.type)", 20),
        "parse_item_lists": """WITH t AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS e FROM events),
            x AS (SELECT event_id, u, e, CASE WHEN u = '1' THEN '1 01' ELSE u || ' 01 1' END || CASE WHEN e = u OR e = '1' THEN '' ELSE ' ' || e END AS d FROM t)
            SELECT event_id, CASE WHEN u = '1' THEN '1 1' ELSE u || ' 1 1' END || CASE WHEN e = u OR e = '1' THEN '' ELSE ' ' || e END AS ids, u || ' 01 1 ' || e || ' ' || u AS tokens, array_to_string(list_slice(string_split(d, ' '), 1, 3), ' ') AS first_three FROM x""",
        "vocabulary": sql("SELECT aid, row_number() OVER (ORDER BY session, ts, seq) AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY session, ts, seq) AS r FROM hist) WHERE r = 1"),
        "pair_windows": sql("""SELECT session, pos, aid, CAST(tid AS BIGINT) AS target_type_id, CASE tid WHEN 2 THEN CAST(3 AS DOUBLE) WHEN 3 THEN CAST(6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sample_weight, history, history_types FROM
            (SELECT *, string_agg(CAST(aid AS VARCHAR), ' ') OVER w AS history, string_agg(CAST(tid AS VARCHAR), ' ') OVER w AS history_types FROM hist WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) WHERE pos > 0"""),
        "pair_stats": sql("SELECT CAST(tid AS BIGINT) AS target_type_id, count(*) AS pairs, count(DISTINCT aid) AS items FROM hist WHERE pos > 0 GROUP BY tid"),
        "sample_pairs": sql("SELECT session, pos FROM hist WHERE pos > 0 ORDER BY md5(session || ':' || pos || ':2024'), session, pos LIMIT 1000"),
        "session_split_md5": sql("SELECT session, CAST(CAST('0x' || substr(md5(session || ':2024'), 29, 4) AS INT) < 13107 AS BIGINT) AS holdout FROM (SELECT DISTINCT session FROM ev)"),
        "recency_weights": sql("SELECT session, seq, n - pos AS rpos, CAST(tid AS BIGINT) AS type_id, round(CAST(1 AS DOUBLE) / (n - pos), 6) AS weight FROM hist"),
    }
