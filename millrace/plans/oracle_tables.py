"""The domain tables of ``millrace.sources.domain`` as common table expressions for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

_TAGS = "['anvil', 'blue', 'bolt', 'cold', 'gear', 'gizmo', 'hot', 'large', 'new', 'old', 'plate', 'red', 'ring', 'rod', 'small', 'widget']"


def _list(values: Sequence[str], keep: str) -> str:
    """The values for whose place {n} the condition holds."""
    cases = ", ".join(f"CASE WHEN {keep.format(n=n)} THEN '{v}' END" for n, v in enumerate(values))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_LIFE, _TIMES, _ACTS = ("active", "homebody", "foodie", "traveler"), ("morning", "noon", "evening", "night"), ("work", "sport", "dining", "travel")
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

TABLES = {
    "posts": """
  SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS source_id, substr(text, 1, 64) AS title, text AS content,
    ['求助', '问答', '吐槽'][CAST(doc_id % 3 AS INTEGER) + 1] AS category, [lang, source, 'm' || (doc_id % 7)] AS tags,
    CASE WHEN doc_id % 23 <> 0 THEN 37.0::DOUBLE + (doc_id % 200) * 0.01::DOUBLE END AS latitude,
    CASE WHEN doc_id % 23 <> 0 THEN 112.0::DOUBLE + (doc_id % 170) * 0.01::DOUBLE END AS longitude,
    'c' || (doc_id % 5) AS city, 'd' || (doc_id % 11) AS district, CASE WHEN doc_id % 3 <> 0 THEN 'road ' || (doc_id % 40) END AS address, n_chars AS views, n_chars % 97 AS likes, n_chars % 31 AS marks, n_chars % 7 AS dislikes,
    CASE WHEN doc_id % 13 <> 0 THEN (n_chars % 50) / 10.0::DOUBLE END AS ratescore, CAST(doc_id % 3 AS VARCHAR) AS visible_status,
    CAST(doc_id % 150 AS VARCHAR) AS owner_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id % 1000000) AS created_at,
    CASE WHEN doc_id % 19 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id % 1000000) + to_hours(doc_id % 50) END AS updated_at
  FROM documents""",
    "counters": """
  SELECT CAST(event_id % (SELECT count(*) FROM documents) AS VARCHAR) AS source_id,
    count(*) FILTER (WHERE event_type = 'view' AND ts > now_ - INTERVAL 1 HOUR) AS views_1h,
    count(*) FILTER (WHERE event_type = 'view' AND ts > now_ - INTERVAL 24 HOUR) AS views_24h,
    count(*) FILTER (WHERE event_type = 'click' AND ts > now_ - INTERVAL 24 HOUR) AS likes_24h,
    count(*) FILTER (WHERE event_type = 'signup' AND ts > now_ - INTERVAL 24 HOUR) AS marks_24h,
    count(*) FILTER (WHERE event_type = 'purchase' AND ts > now_ - INTERVAL 24 HOUR) AS unlocks_24h
  FROM events, (SELECT max(ts) AS now_ FROM events) GROUP BY 1""",
    "users": """
  SELECT c_custkey AS key, 'user_' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 4 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS user_id,
    CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
    CASE WHEN c_custkey % 31 <> 0 THEN 18 + c_custkey % 60 END AS age,
    list_filter([CASE WHEN (c_custkey * 7) % 4 < 2 THEN 'music' END, CASE WHEN (c_custkey * 7 + 3) % 4 < 2 THEN 'travel' END, CASE WHEN (c_custkey * 7 + 6) % 4 < 2 THEN 'food' END,
      CASE WHEN (c_custkey * 7 + 9) % 4 < 2 THEN 'sport' END, CASE WHEN (c_custkey * 7 + 12) % 4 < 2 THEN 'film' END, CASE WHEN (c_custkey * 7 + 15) % 4 < 2 THEN 'books' END],
      lambda x: x IS NOT NULL) AS interests,
    c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation,
    CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 11) / 10.0::DOUBLE END AS extraversion, CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 7) / 6.0::DOUBLE END AS agreeableness,
    CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 13) / 12.0::DOUBLE END AS conscientiousness, CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 5) / 4.0::DOUBLE END AS neuroticism,
    CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey % 9) / 8.0::DOUBLE END AS openness
  FROM customer""",
    "items": """
  SELECT p_partkey AS item_id, p_name AS name, p_type AS type, string_split(p_name, ' ') AS tags, p_brand AS brand, p_retailprice AS price, p_size AS size,
    CASE WHEN p_partkey % 3 = 0 THEN 'male' WHEN p_partkey % 3 = 1 THEN 'female' END AS target_gender,
    CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 18 + p_partkey % 30 END AS target_age_min, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 18 + p_partkey % 30 END + 20 AS target_age_max,
    (p_partkey % 10) / 10.0::DOUBLE AS couples_score
  FROM part""",
    "profiles": f"""
  SELECT * REPLACE (list_distinct(list_concat(interests, [{_TAGS}[key % 16 + 1], {_TAGS}[key * 5 % 16 + 1]])) AS interests),
    [{{'name': {_TAGS}[key % 16 + 1], 'value': (key % 5) / 4.0::DOUBLE}}, {{'name': {_TAGS}[(key + 3) % 16 + 1], 'value': ((key + 1) % 5) / 4.0::DOUBLE}}, {{'name': {_TAGS}[(key + 7) % 16 + 1], 'value': ((key + 2) % 5) / 4.0::DOUBLE}}] AS preferences,
    'c' || (key % 5) AS location, CASE WHEN key % 10 <> 0 THEN ['bachelor', 'master', 'phd'][key % 3 + 1] END AS education, segment AS occupation, balance * 12 AS income,
    CASE WHEN key % 4 <> 3 THEN ['single', 'dating', 'married'][key % 3 + 1] END AS relationship, {_list(_LIFE, "(key + {n}) % 3 = 0")} AS lifestyle, 'g' || (key % 4) AS social_group,
    CASE WHEN key % 6 = 0 THEN (key % 11) / 10.0::DOUBLE WHEN key % 6 = 1 THEN 1.5 END AS novelty, CASE WHEN key % 5 = 0 THEN (key % 9) / 8.0::DOUBLE WHEN key % 5 = 1 THEN 2.0 END AS social_preference,
    CASE WHEN key % 7 = 3 THEN NULL WHEN key % 11 = 0 THEN 1.5 ELSE (key % 7) / 6.0::DOUBLE END AS activity_level, CASE WHEN key % 9 <> 0 THEN key % 4 END AS received, key % 3 AS accepted,
    key % 30 AS friends, (key % 8) / 7.0::DOUBLE AS response_rate, {_list(_TIMES, "(key + {n}) % 2 = 0")} AS active_times, {_list(_ACTS, "(key + {n}) % 3 = 1")} AS preferred_activities,
    CASE WHEN key % 3 = 0 THEN 'all' WHEN key % 3 = 1 THEN 'female' END AS gender_preference, CASE WHEN key % 8 <> 0 THEN 18 + key % 20 END AS wanted_age_min, CASE WHEN key % 8 <> 0 THEN 38 + key % 20 END AS wanted_age_max
  FROM users""",
    "item_profiles": f"""
  SELECT * REPLACE (CASE WHEN item_id % 5 = 0 THEN 'both' ELSE target_gender END AS target_gender),
    list_transform(list_distinct(tags), lambda x: {{'name': x, 'value': (item_id + list_position(tags, x) - 1) % 5 / 5.0::DOUBLE + 0.2::DOUBLE}}) AS features,
    CASE WHEN item_id % 6 <> 0 THEN ['teen', 'young_adult', 'adult', 'middle_age', 'senior'][item_id % 5 + 1] END AS target_age_group, {_list(("c0", "c1", "c2", "c3", "c4"), "(item_id + {n}) % 5 < 2")} AS target_location,
    CASE WHEN item_id % 7 <> 0 THEN ['bachelor', 'master', 'phd'][item_id % 3 + 1] END AS target_education, {_list(_SEGMENTS, "(item_id + {n}) % 5 < 2")} AS target_occupation, ['low', 'medium', 'high'][item_id % 3 + 1] AS target_income,
    ['single', 'dating', 'married'][item_id * 2 % 3 + 1] AS target_relationship, {_list(_LIFE, "(item_id + {n}) % 2 = 0")} AS target_lifestyle, 'g' || (item_id % 4) AS target_social_group,
    {_list(_TIMES, "(item_id + {n}) % 4 = 0")} AS suitable_time, {_list(("c0", "c1", "c2"), "(item_id + {n}) % 3 = 0")} AS suitable_location, {_list(("mobile", "desktop"), "(item_id + {n}) % 2 = 0")} AS suitable_device,
    {_list(_ACTS, "(item_id + {n}) % 5 = 0")} AS suitable_activity
  FROM items""",
    "interactions": """
  SELECT o_custkey AS "user", l_partkey AS item_id, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq,
    CASE l_returnflag WHEN 'A' THEN 'rate' WHEN 'N' THEN 'like' ELSE 'purchase' END AS interaction_type,
    CASE WHEN l_returnflag = 'A' THEN 1 + l_quantity % 5 END AS rating_value, l_quantity AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ratings": """
  SELECT "user", item_id, CASE interaction_type WHEN 'rate' THEN rating_value WHEN 'like' THEN 4.0::DOUBLE ELSE 5.0::DOUBLE END AS rating, ts
  FROM interactions QUALIFY row_number() OVER (PARTITION BY "user", item_id ORDER BY ts DESC, seq DESC) = 1""",
    "raw_posts": """
  SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE substr(text, 1, 30) END AS title, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS detail,
    [' ', '求助', '我要问答', '想吐一下', '抱怨', 'other'][CAST(doc_id % 6 AS INTEGER) + 1] AS typecategory,
    lang || ' ,' || source || '；' || lang || ';;x' || (doc_id % 4) AS tags,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id % 1000000) END AS createtime,
    CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id % 1000000) - INTERVAL 1 HOUR WHEN doc_id % 5 = 1 THEN NULL
      ELSE TIMESTAMP '2024-01-01' + to_minutes(doc_id % 1000000) + INTERVAL 2 HOUR END AS updatetime,
    CASE WHEN doc_id % 37 = 0 THEN 0.0 WHEN doc_id % 29 = 0 THEN 95.0::DOUBLE WHEN doc_id % 7 = 0 THEN NULL ELSE 37.0::DOUBLE + (doc_id % 200) * 0.01::DOUBLE END AS from_lat,
    CASE WHEN doc_id % 37 = 0 THEN 0.0 WHEN doc_id % 31 = 0 THEN -200.0::DOUBLE WHEN doc_id % 14 = 0 THEN NULL ELSE 112.0::DOUBLE + (doc_id % 170) * 0.01::DOUBLE END AS from_lng,
    n_chars - 500 AS views, CASE WHEN doc_id % 9 <> 0 THEN n_chars % 97 END AS likes, CAST(doc_id % 150 AS VARCHAR) AS owner,
    CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE ' c' || (doc_id % 5) END AS city, CASE WHEN doc_id % 4 <> 0 THEN (n_chars % 50) / 10.0::DOUBLE - 1 END AS ratescore,
    CASE WHEN doc_id % 12 = 0 THEN '' ELSE 'd' || (doc_id % 11) END AS district, CASE WHEN doc_id % 40 <> 0 THEN 'cn' END AS country, 'p' || (doc_id % 3) AS province, CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE 'road' END AS address,
    n_chars % 31 - 2 AS marks, CASE WHEN doc_id % 6 <> 0 THEN n_chars % 7 - 1 END AS dislikes, CAST(doc_id % 3 AS VARCHAR) AS status
  FROM documents""",
    "case_results": """
  SELECT event_id AS case_id, event_type <> 'error' AS success, event_id % 12 AS returned, event_id % 5 <> 0 AS expected, event_id % 4 AS located, least(event_id % 3, event_id % 4) AS geo_hits, event_id % 7 = 0 AS degraded,
    CASE WHEN event_id % 2 <> 0 THEN event_id % 9 <> 0 END AS stable, CASE WHEN event_id % 3 = 0 THEN event_id % 11 <> 0 END AS survived, CASE WHEN event_id % 6 <> 0 THEN (event_id % 10) / 10.0::DOUBLE END AS precision,
    CASE WHEN event_id % 6 <> 0 THEN (event_id % 8) / 8.0::DOUBLE END AS recall, CASE WHEN event_id % 6 <> 0 THEN 1 / (event_id % 5 + 1)::DOUBLE END AS rr, CASE WHEN event_id % 6 <> 0 THEN (event_id % 4) / 4.0::DOUBLE END AS ndcg, value AS latency_ms
  FROM events""",
    "repeated_runs": """
  SELECT case_id, run, rank, source_id, CASE WHEN source_id::BIGINT % 9 <> 0 THEN (source_id::BIGINT % 50)::DOUBLE END AS distance_km, (source_id::BIGINT % 40 + run * 3)::DOUBLE AS latency_ms
  FROM routes, (VALUES (1), (2)) v(run) WHERE route = 'lexical' AND rank <= 12 AND NOT (run = 2 AND case_id LIKE '%3' AND rank = 5)""",
    "drafts": """
  SELECT 'draft_' || id AS draft_id, concat_ws(' ', 'the of', lower(category), split_part(title, ' ', 1)) AS query, ['text_intent', 'geo_intent', 'category_intent'][id % 3 + 1] AS query_type, source_id AS anchor, source, category, city, district, latitude, longitude
  FROM posts WHERE id % 50 = 0""",
    "qrels": """
  SELECT source AS case_id, CAST(doc_id AS VARCHAR) AS source_id, CAST(quality * 2 + CASE WHEN quality = 1 AND doc_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS grade
  FROM labels JOIN documents USING (doc_id)""",
    "routes": """
  SELECT * FROM (
    SELECT source AS case_id, 'freshness' AS route, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank, CAST(doc_id AS VARCHAR) AS source_id FROM documents
    UNION ALL SELECT source, 'lexical', row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC), CAST(doc_id AS VARCHAR) FROM documents
    UNION ALL SELECT source, 'semantic', row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1009, doc_id DESC), CAST(doc_id AS VARCHAR) FROM documents
  ) WHERE rank <= 40""",
}
_NEEDS = {"ratings": ["interactions"], "profiles": ["users"], "item_profiles": ["items"], "repeated_runs": ["routes"], "drafts": ["posts"]}


def with_tables(sql: str, tables: Sequence[str]) -> str:
    """``sql`` behind the named tables, and those that they need, as common table expressions."""
    names: list[str] = []
    for t in tables:
        for name in (*_NEEDS.get(t, ()), t):
            if name not in names:
                names.append(name)
    if not names:
        return sql
    made = ",\n".join(f"{n} AS ({TABLES[n]}\n)" for n in names)
    rest = sql.strip()
    if rest[:5].upper() == "WITH ":
        return f"WITH {made},\n{rest[5:]}"
    return f"WITH {made}\n{rest}"
