"""The registered queries once more, as SQL for a second engine.

Each text reads the same whole tables as its query and computes the result in
its own way: power sums instead of moment functions, sorted ranks instead of
refined cells, joins instead of projections.
"""

from __future__ import annotations

from tallylens.functions.names import DOMAIN_SIGNATURES


def rounded(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


DIRTY = """
raw AS (
  SELECT o_orderkey AS k, 'ORD' || lpad(o_orderkey::VARCHAR, 9, '0') AS order_id,
    'C' || lpad(o_custkey::VARCHAR, 8, '0') AS customer_id,
    CASE WHEN o_orderkey % 10 < 3 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END
      AS order_date,
    o_orderkey % 7 + 1 AS quantity, o_totalprice::DECIMAL(18,2) AS price,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS state,
    o_orderpriority AS method
  FROM orders),
once AS (
  SELECT k, order_id, customer_id, order_date, quantity,
    CASE WHEN k % 5 = 0 THEN '$' ELSE '' END || price::VARCHAR AS unit_price,
    CASE WHEN k % 12 <> 0 THEN quantity * price::DOUBLE END AS total_amount,
    CASE k % 3 WHEN 0 THEN upper(state) WHEN 1 THEN upper(state[1]) || state[2:] ELSE state END AS status,
    CASE WHEN k % 4 = 0 THEN '  ' || method || ' ' ELSE method END AS "Payment Method",
    CASE WHEN k % 20 >= 9 THEN (['North', 'South', 'East', 'West', 'Central'])[(k % 5)::INT + 1] END AS region,
    CASE WHEN k % 4 <> 0 THEN (k % 10)::DOUBLE / 10 END AS discount
  FROM orders_raw),
dirty AS (SELECT * EXCLUDE (k) FROM (SELECT * FROM once UNION ALL SELECT * FROM once WHERE k % 33 = 0))
""".replace("orders_raw", "raw")

DIRTY_COLUMNS = {
    "order_id": "text", "customer_id": "text", "order_date": "text", "quantity": "long", "unit_price": "text",
    "total_amount": "double", "status": "text", "Payment Method": "text", "region": "text", "discount": "double",
}

PRICED = "priced AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"

CLEAN = f"""
{DIRTY},
single AS (SELECT DISTINCT * FROM dirty),
cleaned AS (
  SELECT order_id, customer_id,
    coalesce(try_strptime(trim(order_date), '%Y-%m-%d')::DATE, try_strptime(trim(order_date), '%d/%m/%Y')::DATE)::VARCHAR
      AS order_date,
    quantity, try_cast(regexp_replace(unit_price, '[$,£€\\s]', '', 'g') AS DOUBLE) AS unit_price,
    total_amount AS total, lower(trim(status)) AS status, lower(trim("Payment Method")) AS payment_method, region, discount
  FROM single),
clean AS (
  SELECT order_id, customer_id, order_date, quantity, unit_price, coalesce(total, quantity * unit_price) AS total_amount,
    status, payment_method, region, discount FROM cleaned)
"""


def quoted(name: str) -> str:
    return '"' + name + '"'


def tag_sql(name: str, is_text: bool, dollar: str) -> str:
    low = name.lower()
    return f"""CASE WHEN regexp_matches('{low}', 'price|amount|cost|revenue|value|salary') OR {dollar} THEN 'currency'
      WHEN regexp_matches('{low}', 'date|time|at|created|updated') THEN 'date'
      WHEN '{low}' LIKE '%\\_id' ESCAPE '\\' OR '{low}' = 'id' THEN 'id'
      WHEN '{low}' LIKE '%status%' AND {str(is_text).lower()} THEN 'status'
      WHEN regexp_matches('{low}', 'category|type|kind|group|segment') THEN 'category'
      WHEN '{low}' LIKE '%email%' THEN 'email'
      WHEN regexp_matches('{low}', 'city|country|region|state|zip') THEN 'geo' END"""


def profile_branch(name: str, kind: str) -> str:
    c, text = quoted(name), kind == "text"
    dollar = f"coalesce(bool_or(starts_with({c}, '$')), false)" if text else "false"
    dated = text and ("date" in name.lower() or "time" in name.lower())
    mixed = (f"bool_or(contains({c}, '-') AND NOT contains({c}, '/')) AND bool_or(contains({c}, '/'))" if dated else "false")
    variants = f"count(DISTINCT {c}) BETWEEN 2 AND 20 AND count(DISTINCT lower({c})) < count(DISTINCT {c})" if text else "false"
    share = f"(count(*) - count({c})) / count(*)"
    return f"""SELECT '{name}' AS "column", {rounded(share, 4)} AS null_pct,
      count(DISTINCT {c}) + (count(*) > count({c}))::INT AS unique_count, {tag_sql(name, text, dollar)} AS semantic_tag,
      array_to_string(list_filter([
        CASE WHEN {share} > 0.15 THEN 'high_null_rate_' || round_even({share} * 100, 0)::INT || '%' END,
        CASE WHEN {mixed} THEN 'mixed_date_formats' END, CASE WHEN {dollar} THEN 'leading_dollar_sign' END,
        CASE WHEN {variants} THEN 'case_inconsistency' END], lambda x: x IS NOT NULL), ',') AS issues, 5 AS n_samples
      FROM dirty"""


PROFILE = " UNION ALL ".join(profile_branch(c, k) for c, k in DIRTY_COLUMNS.items())

QUALITY = f"""
counts AS (SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows FROM dirty),
shares AS ({" UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS name, (count(*) - count({quoted(c)})) / count(*) AS share FROM dirty"
    for i, c in enumerate(DIRTY_COLUMNS))}),
merged AS (
  SELECT any_value(total_rows) AS total_rows, any_value(total_rows - distinct_rows) AS duplicate_rows, avg(share) AS avg_null,
    coalesce(string_agg(name, ',' ORDER BY place) FILTER (WHERE share > 0.3), '') AS columns_failing,
    count(*) FILTER (WHERE share > 0.3) AS n_failing FROM shares, counts),
quality AS (
  SELECT total_rows, duplicate_rows, {rounded("avg_null", 4)} AS null_row_pct, columns_failing,
    greatest(0.0, {rounded("1 - least(2 * avg_null, 0.4) - least(3 * duplicate_rows / total_rows, 0.3) - 0.05 * n_failing", 3)})
      AS overall_score, duplicate_rows / total_rows < 0.05 AS few_duplicates FROM merged)
"""


def ranked(source: str, value: str, rank: str) -> str:
    """The value at a zero-based rank of a sorted column."""
    return f"(SELECT v FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS i FROM {source}) WHERE i = {rank})"


def distribution_sql(source: str, columns: list[str]) -> str:
    one = []
    for c in columns:
        one.append(f"""
        SELECT '{c}' AS columns, any_value(m.n) AS n, any_value(m.mean) AS mean, sqrt(avg((v - m.mean) ** 2)) AS sd,
          avg((v - m.mean) ** 3) AS m3, avg((v - m.mean) ** 4) AS m4, any_value(m.q1) AS q1, any_value(m.q3) AS q3,
          count(*) FILTER (WHERE v < m.q1 - 1.5 * (m.q3 - m.q1) OR v > m.q3 + 1.5 * (m.q3 - m.q1)) AS outlier_count
        FROM (SELECT {c}::DOUBLE AS v FROM {source}),
          (SELECT count({c}) AS n, avg({c}::DOUBLE) AS mean, quantile_cont({c}::DOUBLE, 0.25) AS q1,
             quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}) m""")
    share = "outlier_count / n"
    return f"""
    SELECT columns, CASE WHEN {share} > 0.10 THEN 'critical' WHEN {share} > 0.03 THEN 'warning' ELSE 'info' END AS severity,
      {share} > 0.05 AS actionable, {rounded("mean", 2)} AS mean, {rounded("sd", 2)} AS std, {rounded("m3 / sd ** 3", 3)} AS skew,
      {rounded("m4 / sd ** 4 - 3", 3)} AS kurtosis, outlier_count::DOUBLE AS outlier_count, {rounded(share, 4)} AS outlier_pct,
      {rounded("q1", 2)} AS q1, {rounded("q3", 2)} AS q3, {rounded("q3 - q1", 2)} AS iqr
    FROM ({" UNION ALL ".join(one)}) WHERE n >= 20 AND sd > 0"""


LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

EVENT_ANOMALY = """
m AS (SELECT avg(value) AS mean, stddev_pop(value) AS sd, count(value) AS n FROM events),
z AS (SELECT value, abs((value - mean) / sd) AS z FROM events, m),
anomaly AS (
  SELECT count(*) FILTER (WHERE z > 3) AS n_anomalies, max(z) AS max_z, any_value(n) AS n, any_value(mean) AS mean,
    any_value(sd) AS sd,
    (SELECT list(value ORDER BY value) FROM (SELECT value FROM z WHERE z > 3 ORDER BY value DESC LIMIT 5)) AS tops
  FROM z, m)
"""


def category_branch(place: int, source: str, column: str) -> str:
    c = quoted(column)
    return f"""SELECT {place} AS place, '{column}' AS columns, {c} AS value, count(*) AS n,
      row_number() OVER (ORDER BY count(*) DESC, {c}) AS top, row_number() OVER (ORDER BY count(*), {c} DESC) AS bottom,
      sum(count(*)) OVER () AS total, count(*) OVER () AS uniques FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"""


def category_sql(branches: list[tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(category_branch(i, s, c) for i, (s, c) in enumerate(branches))
    return f"""
    SELECT columns, CASE WHEN share > 0.9 THEN 'critical' WHEN share > 0.7 THEN 'warning' ELSE 'info' END AS severity,
      share > 0.7 AS actionable, uniques::DOUBLE AS n_unique, {rounded("share", 4)} AS top_pct,
      {rounded("least_share", 4)} AS bottom_pct, {rounded("share / (least_share + 1e-9)", 2)} AS imbalance_ratio, top_value, top_5
    FROM (SELECT columns, any_value(uniques) AS uniques, max(n) FILTER (WHERE top = 1) / any_value(total) AS share,
            max(n) FILTER (WHERE bottom = 1) / any_value(total) AS least_share,
            max(value) FILTER (WHERE top = 1) AS top_value,
            string_agg(n::VARCHAR, ',' ORDER BY top) FILTER (WHERE top <= 5) AS top_5
          FROM ({rows}) GROUP BY place, columns) WHERE uniques BETWEEN 2 AND 50"""


def p_value_sql(source: str) -> str:
    """Two-sided p-values by the finite cosine series of the t distribution, for even degrees of freedom.

    ``source`` has ``id``, ``r`` and ``n``; the result has ``id`` and ``p``.
    """
    return f"""
    terms AS (SELECT j, exp(sum(ln((2 * j - 1) / (2 * j))) OVER (ORDER BY j)) AS c
              FROM (SELECT unnest(range(1, (SELECT max(n) // 2 FROM {source})))::DOUBLE AS j)),
    p_values AS (
      SELECT id, greatest(0.0, 1 - any_value(abs(r)) * (1 + sum(CASE WHEN j <= (n - 4) / 2 THEN c * (1 - r * r) ** j ELSE 0 END)))
        AS p FROM {source}, terms GROUP BY id)"""


MONTHS = "months AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)"
TREND = f"""
{MONTHS},
numbered AS (SELECT month, n::DOUBLE AS y, (row_number() OVER (ORDER BY month) - 1)::DOUBLE AS x FROM months),
fit AS (SELECT 1 AS id, regr_slope(y, x) AS slope, avg(y) AS mean, corr(y, x) AS r, count(*) AS n FROM numbered),
{p_value_sql("fit")}
"""

CORRELATED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]
PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]]
CORR = f"""
{PRICED},
corrs AS ({" UNION ALL ".join(
    f"SELECT {i} AS id, '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM priced "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, (a, b) in enumerate(PAIRS))}),
{p_value_sql("corrs")}
"""

VAGUE = ("may indicate", "could be", "might suggest", "possibly", "it appears", "seems like", "unclear", "unknown")


def vague_sql(text: str) -> str:
    return "(" + " + ".join(f"contains(lower({text}), '{p}')::INT" for p in VAGUE) + ")"


def word_list(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


LINES = r"""
lines AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]'),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents),
split AS (
  SELECT doc_id, trim(regexp_replace(ls[1], '\*+', '', 'g')) AS title,
    trim(regexp_replace(CASE WHEN len(ls) > 1 THEN array_to_string(ls[2:], ' ') ELSE ls[1] END, '\*+', '', 'g')) AS rest
  FROM lines)
"""

INSIGHTS = f"""
{LINES},
insight AS (
  SELECT doc_id AS place, 'DOC-' || doc_id AS id,
    CASE doc_id % 5 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'summary' WHEN 2 THEN 'trend' WHEN 3 THEN 'distribution'
      ELSE 'correlation' END AS type,
    CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity,
    (['', 'Null rate: ', 'Declining: ', 'Cancelled: ', 'Increasing: ', 'Pending: '])[(doc_id % 6)::INT + 1]
      || coalesce(title, '') AS title,
    coalesce(rest, '') AS explanation, doc_id % 4 <> 0 AS has_evidence, n_chars::DOUBLE AS n_chars,
    CASE WHEN doc_id % 3 = 0 THEN source END AS missing, doc_id % 7 = 0 AS actionable
  FROM documents JOIN split USING (doc_id) LEFT JOIN labels USING (doc_id))
"""


def ranges_sql(source: str, column: str) -> str:
    """Mean, sample deviation and fences at three quartile ranges, with nearest-rank quartiles."""
    n = f"(SELECT count(*) FROM {source})"
    return f"""
    quartile AS (SELECT {ranked(source, column, f"floor(({n} - 1) * 0.25 + 0.5)")} AS q1,
      {ranked(source, column, f"floor(({n} - 1) * 0.75 + 0.5)")} AS q3),
    ranges AS (SELECT avg({column}) AS mean, stddev_samp({column}) AS sd, any_value(q1) - 3 * (any_value(q3) - any_value(q1)) AS lo,
      any_value(q3) + 3 * (any_value(q3) - any_value(q1)) AS hi FROM {source}, quartile)"""


ODD = "(NOT abs(v - mean) / abs(mean) < 0.05 AND abs(v - mean) / sd > 3 AND (v < lo OR v > hi))"

VERDICTS = f"""
{INSIGHTS},
{ranges_sql("documents", "n_chars")},
facts AS (
  SELECT *, n_chars AS v, len({word_list("title")}) AS title_words, {vague_sql("title")} > 0 AS vague_title,
    contains(title, '**') AS bold, regexp_matches(title, '[0-9]') AS digit, len({word_list("explanation")}) AS words,
    {vague_sql("explanation")} AS vague FROM insight),
flagged AS (
  SELECT *, list_filter([
    CASE WHEN missing IS NOT NULL THEN 'column_not_in_data: [''' || missing || ''']' END,
    CASE WHEN has_evidence AND type IN ('anomaly', 'trend') AND {ODD} THEN 'evidence_value_implausible: length=' || v END,
    CASE WHEN vague_title THEN 'vague_title_language' END, CASE WHEN bold THEN 'markdown_in_title' END,
    CASE WHEN title_words > 20 THEN 'title_too_long: ' || title_words || ' words' END,
    CASE WHEN words < 15 THEN 'explanation_too_short: ' || words || ' words' END,
    CASE WHEN vague > 1 THEN 'too_vague: ' || vague || ' vague phrases' END,
    CASE WHEN NOT has_evidence THEN 'no_evidence_attached' END], lambda f: f IS NOT NULL) AS flags
  FROM facts, ranges),
scored AS (
  SELECT *, {rounded('''greatest(0.0, least(1.0, (missing IS NULL)::INT * 0.35::DOUBLE
      + CASE WHEN title_words <= 20 AND NOT vague_title AND NOT bold THEN 0.2::DOUBLE + digit::INT * 0.05::DOUBLE ELSE 0 END
      + CASE WHEN words >= 15 AND vague <= 1 THEN 0.2::DOUBLE ELSE 0 END + has_evidence::INT * 0.2::DOUBLE
      - least(len(flags) * 0.15::DOUBLE, 0.45::DOUBLE)))''', 3)} AS score,
    list_filter(flags, lambda f: contains(f, 'column_not_in_data') OR contains(f, 'evidence_value_implausible'))[1] AS critical
  FROM flagged),
verdict AS (SELECT *, score >= 0.5 AND critical IS NULL AS passed FROM scored)
"""

RULES = """
rules(o, r_type, r_severity, keyword, action_type, impact_level, effort_level, owner, kpi, boost) AS (VALUES
  (1, 'anomaly', 'critical', NULL, 'investigate', 'high', 'low', 'Data Engineering', 'anomaly_resolution_rate', 0.3::DOUBLE),
  (2, 'anomaly', 'warning', NULL, 'investigate', 'medium', 'low', 'Data Engineering', 'anomaly_resolution_rate', 0.2),
  (3, 'summary', 'critical', 'null', 'fix', 'high', 'medium', 'Data Engineering', 'data_completeness_pct', 0.25),
  (4, 'summary', 'warning', 'null', 'fix', 'medium', 'low', 'Data Engineering', 'data_completeness_pct', 0.15),
  (5, 'trend', 'critical', 'declin', 'escalate', 'high', 'medium', 'Product / Marketing', 'monthly_revenue_growth', 0.35),
  (6, 'trend', 'warning', 'declin', 'optimise', 'medium', 'medium', 'Marketing', 'conversion_rate', 0.2),
  (7, 'trend', 'critical', 'increas', 'monitor', 'medium', 'low', 'Operations', 'fulfillment_rate', 0.1),
  (8, 'distribution', 'warning', 'cancel', 'fix', 'high', 'medium', 'Product / CX', 'cancellation_rate', 0.3),
  (9, 'distribution', 'warning', 'pending', 'investigate', 'medium', 'low', 'Operations', 'order_fulfillment_rate', 0.15),
  (10, 'correlation', 'info', NULL, 'optimise', 'medium', 'medium', 'Analytics', 'revenue_per_order', 0.05),
  (11, 'distribution', 'info', NULL, 'monitor', 'low', 'low', 'Analytics', 'distribution_stability', 0.0),
  (12, NULL, 'critical', NULL, 'escalate', 'high', 'medium', 'Leadership', 'business_health_score', 0.25),
  (13, NULL, 'warning', NULL, 'investigate', 'medium', 'low', 'Operations', 'issue_resolution_rate', 0.1),
  (14, NULL, 'info', NULL, 'monitor', 'low', 'low', 'Analytics', 'kpi_dashboard', 0.0))
"""


def matched_sql(source: str) -> str:
    return f"""
    {RULES},
    matched AS (
      SELECT * FROM {source} JOIN rules ON severity = r_severity AND coalesce(r_type, type) = type
        AND (keyword IS NULL OR contains(lower(title), keyword))
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1)"""


DECISIONS = f"""
{VERDICTS},
accepted AS (SELECT * FROM verdict WHERE passed AND (actionable OR severity IN ('critical', 'warning'))),
{matched_sql("accepted")},
decision AS (
  SELECT 'DEC-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS id, * EXCLUDE (id, n), id AS insight_id,
    {rounded("least(1.0, CASE severity WHEN 'critical' THEN 0.7::DOUBLE WHEN 'warning' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END + boost + score * 0.1::DOUBLE)", 3)}
      AS priority_score
  FROM (SELECT *, row_number() OVER (ORDER BY place) AS n FROM matched))
"""


def bar_sql(source: str, label: str, value: str, top: int, keep_nulls: bool = False) -> str:
    where = "" if keep_nulls else f"WHERE {label} IS NOT NULL"
    return f"""
    WITH g AS (SELECT {label} AS label, {value} AS value FROM {source} {where} GROUP BY 1
               ORDER BY value DESC, label LIMIT {top})
    SELECT row_number() OVER (ORDER BY value DESC, label) AS place, label, value,
      {rounded("value / sum(value) OVER () * 100", 1)} AS share FROM g"""


def choice_sql(columns: dict[str, list[tuple[str, str]]], text_limit: bool) -> str:
    parts = []
    for source, fields in columns.items():
        for name, kind in fields:
            uniques = f"(count(DISTINCT {name}) + (count(*) > count({name}))::INT)"
            ratio = f"{uniques} / count(*)"
            by_name = (f"regexp_matches('{name}', '(id|_key|_uuid|_index)$|^(index|uuid|key|idx)$|lat|lng|lon|x_coord|y_coord"
                       "|coordinates|geoloc|zip|postal|pincode|postcode|created_at|updated_at|timestamp|datetime|event_time')")
            data = {
                "int": f"WHEN {ratio} > 0.8 THEN 'nearly_unique_integer'",
                "double": f"WHEN {ratio} > 0.9 AND min({name}) >= -180 AND max({name}) <= 180 THEN 'coordinate_like'",
                "text": f"WHEN {uniques} > 50 THEN 'many_texts'" if text_limit else "",
            }.get(kind, "") if kind != "other" else ""
            parts.append(
                f"SELECT '{source}' AS source, '{name}' AS \"column\", CASE WHEN {by_name} THEN 'name' {data} ELSE 'kept' END "
                f"AS reason, count(*) AS n FROM {source}")
    return "SELECT source, \"column\", reason = 'kept' AS kept, reason FROM (" + " UNION ALL ".join(parts) + ")"


CHOICE_TABLES = {
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "double"),
               ("o_orderdate", "other"), ("o_orderpriority", "text")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "other")],
    "events": [("event_id", "int"), ("ts", "other"), ("user_id", "int"), ("event_type", "text"), ("value", "double"),
               ("props", "text")],
    "part": [("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "int"),
             ("p_retailprice", "double")],
    "customer": [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "text")],
    "documents": [("doc_id", "int"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "int")],
}

EVENT_FINDINGS = f"""
WITH {EVENT_ANOMALY},
dist AS ({distribution_sql("events", ["value"])}),
cat AS ({category_sql([("events", "event_type")])}),
found AS (
  SELECT 0 AS seq, 'summary' AS stat_type, 'value' AS columns, 'info' AS severity, false AS actionable,
    [{{'m': 'value.mean', 'v': {rounded("avg(value)", 2)}}}, {{'m': 'value.median', 'v': {rounded("median(value)", 2)}}},
     {{'m': 'value.std', 'v': {rounded("stddev_samp(value)", 2)}}}, {{'m': 'value.min', 'v': {rounded("min(value)", 2)}}},
     {{'m': 'value.max', 'v': {rounded("max(value)", 2)}}}, {{'m': 'value.count', 'v': count(value)::DOUBLE}}] AS ms FROM events
  UNION ALL
  SELECT 200000, 'distribution', columns, severity, actionable,
    [{{'m': 'mean', 'v': mean}}, {{'m': 'std', 'v': std}}, {{'m': 'skew', 'v': skew}}, {{'m': 'kurtosis', 'v': kurtosis}},
     {{'m': 'outlier_count', 'v': outlier_count}}, {{'m': 'outlier_pct', 'v': outlier_pct}}, {{'m': 'q1', 'v': q1}},
     {{'m': 'q3', 'v': q3}}, {{'m': 'iqr', 'v': iqr}}] FROM dist
  UNION ALL
  SELECT 300001, 'categorical_distribution', columns, severity, actionable,
    [{{'m': 'n_unique', 'v': n_unique}}, {{'m': 'top_pct', 'v': top_pct}}, {{'m': 'bottom_pct', 'v': bottom_pct}},
     {{'m': 'imbalance_ratio', 'v': imbalance_ratio}}] FROM cat
  UNION ALL
  SELECT 600000, 'anomaly', 'value', CASE WHEN n_anomalies / n > 0.02 THEN 'critical' WHEN n_anomalies >= 3 THEN 'warning'
      ELSE 'info' END, n_anomalies / n > 0.01,
    [{{'m': 'n_anomalies', 'v': n_anomalies::DOUBLE}}, {{'m': 'anomaly_pct', 'v': {rounded("n_anomalies / n", 4)}}},
     {{'m': 'max_z_score', 'v': {rounded("max_z", 2)}}}, {{'m': 'column_mean', 'v': {rounded("mean", 2)}}},
     {{'m': 'column_std', 'v': {rounded("sd", 2)}}}] FROM anomaly WHERE n_anomalies > 0)
"""

EVENT_INSIGHTS = f"""
{EVENT_FINDINGS},
facts AS (
  SELECT *, map_from_entries(list_transform(ms, lambda e: {{'k': e.m, 'v': e.v}})) AS mm,
    row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, seq) AS place FROM found),
titled AS (
  SELECT printf('INS-%03d', place) AS id, place, stat_type,
    CASE stat_type WHEN 'categorical_distribution' THEN 'distribution' ELSE stat_type END AS type, severity,
    CASE stat_type
      WHEN 'summary' THEN 'Overview of 1 numeric columns'
      WHEN 'distribution' THEN format('Outliers make up {{:.1f}}% of value', mm['outlier_pct'] * 100)
      WHEN 'categorical_distribution' THEN format('Value {{}} holds {{:.1f}}% of event type', (SELECT top_value FROM cat), mm['top_pct'] * 100)
      WHEN 'anomaly' THEN format('{{:,}} extreme values in value', mm['n_anomalies']::BIGINT) END AS title,
    actionable, columns AS affected_columns, mm FROM facts)
"""


def evidence_sql(kind: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT id, '{m}' AS metric, mm['{m}'] AS num, NULL AS txt, affected_columns AS \"column\" FROM titled "
        f"WHERE stat_type = '{kind}'" for m in metrics)


FENCE = """
SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN (json_extract(props, '$.k'))::BIGINT END AS k FROM events
"""

HIST = f"""
WITH quartile AS (SELECT {ranked("events", "value", "floor(((SELECT count(*) FROM events) - 1) * 0.25 + 0.5)")} AS q1,
  {ranked("events", "value", "floor(((SELECT count(*) FROM events) - 1) * 0.75 + 0.5)")} AS q3),
marked AS (SELECT value, CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN 'normal' ELSE 'outlier' END AS series FROM events, quartile),
sized AS (
  SELECT series, min(value) AS low, (max(value) - min(value)) / any_value(CASE series WHEN 'normal' THEN 40 ELSE 10 END) AS width,
    any_value(CASE series WHEN 'normal' THEN 40 ELSE 10 END) AS bins FROM marked GROUP BY series)
SELECT series, bin, {rounded("any_value(low + bin * width)", 4)} AS start,
  {rounded("any_value(low + (bin + 1) * width)", 4)} AS "end", count(*) AS n
FROM (SELECT series, low, width, least(floor((value - low) / width)::BIGINT, bins - 1) AS bin FROM marked JOIN sized USING (series))
GROUP BY series, bin
"""

SAMPLE = "(SELECT * FROM events ORDER BY md5('42:' || event_id::VARCHAR) LIMIT {n})"

LINEITEM_TEXT = " || ".join(
    f"coalesce(length(lineitem.{c}::VARCHAR) || ':' || lineitem.{c}::VARCHAR, '~')" for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"))

SKIP = ("regexp_matches(lower({c}), 'id$|_id|_key|_uuid|_index|lat|lng|lon|zip|postal|timestamp|datetime|created_at|updated_at')")

PLANS = f"""
{INSIGHTS},
charts(type, chart_type, aggregation) AS (VALUES ('anomaly', 'histogram', 'count'), ('distribution', 'histogram', 'count'),
  ('trend', 'line', 'sum'), ('correlation', 'scatter', 'none')),
useful AS (
  SELECT id, type, severity, title, list_filter(['n_chars', missing], lambda c: c IS NOT NULL AND NOT {SKIP.format(c="c")}) AS cols,
    {word_list("title")} AS ws FROM insight),
plan AS (
  SELECT id AS insight_id, chart_type, array_to_string(ws[1:7], ' ') || CASE WHEN len(ws) > 7 THEN '…' ELSE '' END AS title,
    cols[1] AS x_column, CASE WHEN chart_type = 'scatter' THEN cols[2] END AS y_column, aggregation, severity,
    title AS full_title FROM useful JOIN charts USING (type) WHERE len(cols) > 0)
"""


def column_stats_sql(source: str, numbers: list[str], texts: list[str], with_top: bool = True) -> str:
    none = "NULL::BIGINT AS n_unique, NULL AS top_vals"
    parts = [
        f"SELECT '{c}' AS \"column\", 'numeric' AS kind, {rounded(f'avg({c})', 2)} AS mean, {rounded(f'min({c})', 2)} AS low, "
        f"{rounded(f'max({c})', 2)} AS high, {none} FROM {source}" for c in numbers]
    parts += [
        f"SELECT '{c}', 'categorical', NULL, NULL, NULL, (SELECT count(DISTINCT {c}) + (count(*) > count({c}))::INT FROM {source}), "
        f"(SELECT string_agg({c} || '=' || n, ',' ORDER BY n DESC, {c}) FROM (SELECT {c}, count(*) AS n FROM {source} "
        f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 5))" for c in texts]
    return " UNION ALL ".join(parts)


ORDER_COLUMNS = ["order_date", "quantity", "unit_price", "total_amount", "status", "payment_method", "region", "discount"]
ORDER_NUMBERS = ["quantity", "unit_price", "total_amount", "discount"]
ORDER_TEXTS = ["order_date", "status", "payment_method", "region"]
ORDER_PAIRS = [(a, b) for i, a in enumerate(ORDER_NUMBERS) for b in ORDER_NUMBERS[i + 1:]]


def place_sql(column: str, order: list[str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(order)) + " END"


def extremes_sql(place: int, c: str) -> str:
    """Count, share, the mean of the five largest extreme values and their plausibility for one column."""
    n = f"(SELECT count({c}) FROM clean)"
    source = f"(SELECT {c} FROM clean WHERE {c} IS NOT NULL)"
    return f"""
    SELECT {place} AS place, '{c}' AS columns, count(*) AS n, count(*) FILTER (WHERE z > 3) AS n_extreme,
      round_even(any_value(mean) * 100, 0) / 100 AS mean, any_value(mean) AS exact_mean, any_value(sds) AS sds, max(z) AS max_z,
      (SELECT avg(round_even(v * 100, 0) / 100) FROM (SELECT {c} AS v FROM clean, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM clean)
        WHERE abs(({c} - m) / s) > 3 ORDER BY v DESC LIMIT 5)) AS top_mean,
      {ranked(source, c, f"floor(({n} - 1) * 0.25 + 0.5)")} AS q1, {ranked(source, c, f"floor(({n} - 1) * 0.75 + 0.5)")} AS q3
    FROM (SELECT abs(({c} - mean) / sd) AS z, mean, sds FROM clean,
      (SELECT avg({c}) AS mean, stddev_pop({c}) AS sd, stddev_samp({c}) AS sds FROM clean) WHERE {c} IS NOT NULL)"""


ORDER_FINDINGS = f"""
WITH {CLEAN},
dist AS ({distribution_sql("clean", ORDER_NUMBERS)}),
cats AS ({category_sql([("clean", c) for c in ORDER_TEXTS])}),
extremes AS ({" UNION ALL ".join(extremes_sql(i, c) for i, c in enumerate(ORDER_NUMBERS))}),
monthly AS (SELECT date_trunc('month', order_date::DATE) AS month, count(*)::DOUBLE AS y FROM clean GROUP BY 1),
numbered AS (SELECT y, (row_number() OVER (ORDER BY month) - 1)::DOUBLE AS x FROM monthly),
trend AS (SELECT regr_slope(y, x) / (avg(y) + 1e-9) * 100 AS pct, count(*) AS n FROM numbered),
found AS (
  SELECT 0 AS seq, 'summary' AS stat_type, '{",".join(ORDER_NUMBERS)}' AS columns, 'info' AS severity, false AS actionable
  UNION ALL SELECT 100000 + place, 'high_nulls', columns, CASE WHEN share > 0.3 THEN 'critical' ELSE 'warning' END, share > 0.2
    FROM ({" UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS columns, (count(*) - count({c})) / count(*) AS share FROM clean"
                              for i, c in enumerate(ORDER_COLUMNS))}) WHERE share > 0.05
  UNION ALL SELECT 200000 + {place_sql("columns", ORDER_NUMBERS)}, 'distribution', columns, severity, actionable FROM dist
  UNION ALL SELECT 300000 + {place_sql("columns", ORDER_COLUMNS)}, 'categorical_distribution', columns, severity, actionable FROM cats
  UNION ALL SELECT 400000, 'time_trend', 'order_date,order_count', CASE WHEN abs(pct) > 20 THEN CASE WHEN pct < -20 THEN 'critical'
      ELSE 'warning' END WHEN abs(pct) > 10 THEN 'warning' ELSE 'info' END, abs(pct) > 20 FROM trend WHERE n >= 3
  UNION ALL SELECT 500000 + i, 'correlation', a || ',' || b, 'info', false
    FROM ({" UNION ALL ".join(f"SELECT {i} AS i, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM clean"
                              for i, (a, b) in enumerate(ORDER_PAIRS))}) WHERE abs(r) > 0.5
  UNION ALL SELECT 600000 + place, 'anomaly', columns, CASE WHEN n_extreme / n > 0.02 THEN 'critical' WHEN n_extreme >= 3 THEN 'warning'
      ELSE 'info' END, n_extreme / n > 0.01 FROM extremes WHERE n_extreme > 0)
"""

ORDER_DECISIONS = f"""
{ORDER_FINDINGS},
insight AS (
  SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, seq) AS place,
    CASE stat_type WHEN 'time_trend' THEN 'trend' WHEN 'high_nulls' THEN 'summary' WHEN 'categorical_distribution' THEN 'distribution'
      ELSE stat_type END AS type, CASE stat_type WHEN 'high_nulls' THEN 'null rate' ELSE stat_type END AS title FROM found),
odd AS (
  SELECT columns AS odd_column FROM extremes, (SELECT unnest(range(1, 4)) AS k)
  WHERE n_extreme > 0 AND NOT abs((CASE k WHEN 1 THEN n_extreme WHEN 2 THEN round_even(max_z * 100, 0) / 100 ELSE top_mean END) - exact_mean)
      / abs(exact_mean) < 0.05
    AND abs((CASE k WHEN 1 THEN n_extreme WHEN 2 THEN round_even(max_z * 100, 0) / 100 ELSE top_mean END) - exact_mean) / sds > 3
    AND ((CASE k WHEN 1 THEN n_extreme WHEN 2 THEN round_even(max_z * 100, 0) / 100 ELSE top_mean END) < q1 - 3 * (q3 - q1)
      OR (CASE k WHEN 1 THEN n_extreme WHEN 2 THEN round_even(max_z * 100, 0) / 100 ELSE top_mean END) > q3 + 3 * (q3 - q1))),
accepted AS (
  SELECT printf('INS-%03d', place) AS id, * FROM insight WHERE (actionable OR severity IN ('critical', 'warning'))
    AND NOT (type = 'anomaly' AND columns IN (SELECT odd_column FROM odd))),
{matched_sql("accepted")}
SELECT printf('DEC-%03d', row_number() OVER (ORDER BY place)) AS id, id AS insight_id, action_type, impact_level, effort_level, owner, kpi,
  {rounded("least(1.0, CASE severity WHEN 'critical' THEN 0.7::DOUBLE WHEN 'warning' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END + boost + 0.1::DOUBLE)", 3)}
    AS priority_score FROM matched
"""


DOMAIN_TABLES = {"dirty_orders": "dirty", "lineitem": "lineitem", "events": "events", "customer": "customer"}
DOMAINS = f"""
signatures AS (SELECT * FROM (VALUES {", ".join(
    f"('{d}', {i}, {len(names)}, '{n}')" for i, (d, names) in enumerate(DOMAIN_SIGNATURES.items()) for n in names)}
  ) s(domain, place, size, name)),
held AS (
  SELECT 'dirty_orders' AS source, lower(unnest({list(DIRTY_COLUMNS)})) AS name
  {" ".join(f"UNION ALL SELECT '{s}', lower(column_name) FROM (DESCRIBE {t})" for s, t in DOMAIN_TABLES.items() if t != "dirty")}),
scores AS (
  SELECT h.source, s.domain, any_value(place) AS place, count(*) FILTER (WHERE h.name = s.name) / any_value(size) AS score
  FROM held h, signatures s GROUP BY h.source, s.domain),
detected AS (
  SELECT source, (SELECT count(*) FROM held WHERE held.source = scores.source)::INT AS column_count,
    CASE WHEN max(score) > 0.3 THEN arg_max(domain, (score, -place)) ELSE 'unknown' END AS domain, max(score) AS score
  FROM scores GROUP BY source)
"""


def all_sql() -> dict[str, str]:
    """The SQL text per query name."""
    dirty = f"WITH {DIRTY}"
    names = ", ".join(quoted(c) for c in DIRTY_COLUMNS)
    context = f"""WITH {CLEAN}, {QUALITY}, {DOMAINS}, profile AS ({PROFILE})
            SELECT 'static_csv' AS source_type, (SELECT domain FROM detected WHERE source = 'dirty_orders') AS domain,
              count(*) AS row_count, {len(DIRTY_COLUMNS)}::BIGINT AS column_count,
              (SELECT sum(CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END) FROM profile)::BIGINT
                + (SELECT (NOT (overall_score >= 0.6 AND few_duplicates))::INT FROM quality) AS n_warnings FROM clean"""
    counts = " UNION ALL ".join(
        f"SELECT '{s}' AS source, count(*) AS row_count FROM {t}" for s, t in DOMAIN_TABLES.items())
    useful_summary = [
        f"SELECT '{c}' AS \"column\", {rounded(f'avg({c})', 2)} AS mean, {rounded(f'quantile_cont({c}::DOUBLE, 0.5)', 2)} AS median, "
        f"{rounded(f'stddev_samp({c})', 2)} AS std, {rounded(f'min({c})', 2)} AS min, {rounded(f'max({c})', 2)} AS max, "
        f"count({c}) AS count FROM lineitem" for c in LINEITEM_NUMBERS]
    return {
        "csv_scan": f"{dirty} SELECT {names} FROM dirty",
        "csv_text_scan": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "json_scan": "SELECT conv_id, turn, role, text FROM conversations",
        "json_array_scan": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "jsonl_scan": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, user_id, event_type, value, props FROM events",
        "parquet_scan": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45",
        "sampled_scan": f"SELECT event_id, user_id, event_type, value FROM {SAMPLE.format(n=1000)}",
        "sampled_scan_row_hash": f"SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem ORDER BY md5('42|' || {LINEITEM_TEXT}) LIMIT 1000",
        "column_profile": f"{dirty} {PROFILE}",
        "profile_warnings": f"""{dirty}, {QUALITY}, profile AS ({PROFILE})
            SELECT format('Quality score {{:.2f}} — review columns: {{}}', overall_score, columns_failing) AS warning FROM quality
            WHERE NOT (overall_score >= 0.6 AND few_duplicates)
            UNION ALL SELECT 'Column ''' || "column" || ''': ' || unnest(string_split(issues, ',')) FROM profile WHERE issues <> ''""",
        "null_fractions": dirty + " " + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({quoted(c)}) AS null_count, "
            f"{rounded(f'(count(*) - count({quoted(c)})) / count(*)', 6)} AS null_pct FROM dirty" for c in DIRTY_COLUMNS),
        "quality_report": f"""{dirty}, {QUALITY} SELECT total_rows, duplicate_rows, null_row_pct, columns_failing, overall_score,
            overall_score >= 0.6 AND few_duplicates AS passed FROM quality""",
        "duplicate_rows": f"""{dirty}, docs AS (SELECT text, lang, source FROM documents)
            SELECT 'dirty_orders' AS source, count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows,
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows FROM dirty
            UNION ALL SELECT 'documents', count(*), (SELECT count(*) FROM (SELECT DISTINCT * FROM docs)),
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM docs)) FROM docs""",
        "domain_detect": f"""{dirty}, {DOMAINS}, counts AS ({counts})
            SELECT source, row_count, column_count, domain, {rounded("score", 6)} AS score FROM counts JOIN detected USING (source)""",
        "domain_match_table": f"""WITH {DIRTY.strip()}, {DOMAINS},
            words AS (SELECT DISTINCT source, lower(unnest(string_split_regex(text, '[^A-Za-z_]+'))) AS name FROM documents),
            wanted AS (SELECT DISTINCT domain, name, place FROM signatures
              UNION SELECT 'first_' || lang, lower(string_split_regex(text, '[^A-Za-z_]+')[1]), 9 FROM documents
                WHERE string_split_regex(text, '[^A-Za-z_]+')[1] <> ''),
            sized AS (SELECT domain, place, name, count(*) OVER (PARTITION BY domain) AS size FROM wanted),
            score AS (SELECT source, domain, place, count(*) / any_value(size) AS score FROM words JOIN sized USING (name)
              GROUP BY source, domain, place)
            SELECT source, CASE WHEN coalesce(score, 0) > 0.3 THEN domain ELSE 'unknown' END AS domain,
              {rounded("coalesce(score, 0)", 6)} AS score
            FROM (SELECT DISTINCT source FROM documents) LEFT JOIN score USING (source)
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, place, domain) = 1""",
        "analytic_columns": choice_sql(CHOICE_TABLES, False),
        "useful_columns": choice_sql(CHOICE_TABLES, True),
        "distinct_values": dirty + " " + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(DISTINCT {quoted(c)}) + (count(*) > count({quoted(c)}))::INT AS n FROM dirty"
            for c in DIRTY_COLUMNS),
        "clean_orders": f"WITH {CLEAN} SELECT * REPLACE ({rounded('total_amount', 4)} AS total_amount) FROM clean",
        "ingest_context": context,
        "ingest_file": context,
        "json_replies": FENCE,
        "text_titles": f"""WITH {LINES}, worded AS (SELECT doc_id, {word_list("title")} AS ws, {word_list("rest")} AS rs FROM split)
            SELECT doc_id, array_to_string(ws[1:7], ' ') || CASE WHEN len(ws) > 7 THEN '…' ELSE '' END AS short_title,
              len(ws) AS title_words, len(rs) AS rest_words FROM worded""",
        "summary_stats": " UNION ALL ".join(useful_summary),
        "null_findings": dirty + " SELECT columns, severity, actionable, null_pct, null_count FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS columns, (count(*) - count({quoted(c)})) / count(*) AS share, "
            f"(count(*) - count({quoted(c)}))::DOUBLE AS null_count, CASE WHEN share > 0.3 THEN 'critical' ELSE 'warning' END AS severity, "
            f"share > 0.2 AS actionable, {rounded('share', 4)} AS null_pct FROM dirty" for c in DIRTY_COLUMNS) + ") WHERE share > 0.05",
        "distribution_events": distribution_sql("events", ["value"]),
        "distribution_lineitem": distribution_sql("lineitem", LINEITEM_NUMBERS),
        "categorical": dirty + category_sql([
            ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("events", "event_type"), ("events", "props"),
            *[("dirty", c) for c, k in DIRTY_COLUMNS.items() if k == "text"]]),
        "monthly_means": f"""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS order_count,
            {rounded("avg(o_totalprice)", 2)} AS o_totalprice_mean FROM orders GROUP BY 1""",
        "monthly_trend": f"""WITH {TREND}
            SELECT 'o_orderdate,order_count' AS columns, CASE WHEN abs(pct) > 20 THEN CASE WHEN pct < -20 THEN 'critical' ELSE 'warning' END
                WHEN abs(pct) > 10 THEN 'warning' ELSE 'info' END AS severity, abs(pct) > 20 AS actionable,
              {rounded("slope", 4)} AS slope, {rounded("pct", 2)} AS trend_pct_per_period, {rounded("r * r", 4)} AS r_squared,
              {rounded("p", 4)} AS p_value, n::DOUBLE AS n_periods, CASE WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction,
              CASE WHEN p < 0.05 THEN 'true' ELSE 'false' END AS significant,
              (SELECT string_agg(n::VARCHAR, ',' ORDER BY month) FROM months) AS monthly_counts
            FROM (SELECT *, slope / (mean + 1e-9) * 100 AS pct FROM fit) JOIN p_values USING (id)""",
        "correlation": f"""WITH {CORR} SELECT a || ',' || b AS columns, {rounded("r", 4)} AS pearson_r, {rounded("p", 6)} AS p_value, n,
            CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END
              AS direction FROM corrs JOIN p_values USING (id) WHERE abs(r) > 0.5 AND p < 0.05""",
        "pair_p_values": f"""WITH {CORR} SELECT a, b, n, {rounded("r", 6)} AS r, {rounded("p", 5)} AS p
            FROM corrs JOIN p_values USING (id)""",
        "zscore_anomaly": f"""WITH {EVENT_ANOMALY}
            SELECT 'value' AS columns, CASE WHEN n_anomalies / n > 0.02 THEN 'critical' WHEN n_anomalies >= 3 THEN 'warning' ELSE 'info' END
              AS severity, n_anomalies / n > 0.01 AS actionable, n_anomalies::DOUBLE AS n_anomalies,
              {rounded("n_anomalies / n", 4)} AS anomaly_pct, {rounded("max_z", 2)} AS max_z_score, {rounded("mean", 2)} AS column_mean,
              {rounded("sd", 2)} AS column_std, array_to_string(list_transform(tops, lambda v: {rounded("v", 2)}), ',') AS anomaly_values
            FROM anomaly WHERE n_anomalies > 0""",
        "full_analysis": f"""{EVENT_FINDINGS} SELECT seq, stat_type, columns, severity, actionable, e.m AS metric, e.v AS value
            FROM (SELECT *, unnest(ms) AS e FROM found)""",
        "stream_findings": f"""{EVENT_FINDINGS} SELECT stat_type, columns, severity, actionable, e.m AS metric, e.v AS value
            FROM (SELECT *, unnest(ms) AS e FROM found)""",
        "full_analysis_orders": f"{ORDER_FINDINGS} SELECT seq, stat_type, columns, severity, actionable FROM found",
        "analyze_orders": ORDER_DECISIONS,
        # a trend of row counts names a column that the table does not have, and is rejected
        "result_fields": ORDER_DECISIONS.replace("\nSELECT printf('DEC-%03d'", ", decided AS (SELECT printf('DEC-%03d'") + """)
            SELECT (SELECT count(*) FROM insight WHERE NOT (type = 'anomaly' AND columns IN (SELECT odd_column FROM odd))
                AND NOT (type = 'trend' AND contains(columns, 'order_count'))) AS total_insights,
              insight_id AS top_insight, priority_score AS top_score, false AS retry_was_used, true AS timed,
              (SELECT count(DISTINCT order_id) FROM dirty) AS order_ids, (SELECT count(*) FROM clean) AS clean_rows
            FROM decided ORDER BY priority_score DESC, id LIMIT 1""",
        "result_document": f"""{EVENT_INSIGHTS}, {ranges_sql("events", "value")},
            odd AS (SELECT count(*) > 0 AS hit FROM (
              SELECT unnest([n_anomalies, {rounded("max_z", 2)}, list_avg(list_transform(tops, lambda v: {rounded("v", 2)}))]) AS v FROM anomaly), ranges
              WHERE {ODD}),
            kept AS (SELECT * FROM titled, odd WHERE NOT (type = 'anomaly' AND hit))
            SELECT true AS success, 'unknown' AS domain, (SELECT count(*) FROM events) AS total_rows, count(*)::INT AS n_insights,
              count(*) AS passed_count, (SELECT count(*) FROM titled) - count(*) AS rejected_count,
              (count(*) FILTER (WHERE actionable OR severity IN ('critical', 'warning')))::INT AS n_decisions,
              (count(*) FILTER (WHERE type <> 'summary'))::INT AS n_plans,
              (SELECT 1.0::DOUBLE - least(3 * (count(*) - count(DISTINCT event_id)) / count(*), 0.3) FROM events) AS overall_score FROM kept""",
        "event_insights": f"""{EVENT_INSIGHTS}
            SELECT id, type, severity, title, CASE stat_type
              WHEN 'summary' THEN 'The table has 1 numeric columns, and their mean, median, spread and range were computed over all rows that hold a value.'
              WHEN 'distribution' THEN format('The middle half of value lies between {{:.2f}} and {{:.2f}}, and {{:,}} values fall outside the usual range around a mean of {{:.2f}}.',
                mm['q1'], mm['q3'], mm['outlier_count']::BIGINT, mm['mean'])
              WHEN 'categorical_distribution' THEN format('Among the {{:,}} values of event type, the most frequent one is {{}} with {{:.1f}}% of the rows, and the rarest one has {{:.1f}}%.',
                mm['n_unique']::BIGINT, (SELECT top_value FROM cat), mm['top_pct'] * 100, mm['bottom_pct'] * 100)
              ELSE format('In value there are {{:,}} values more than three standard deviations from the mean of {{:.2f}}, the furthest one by {{:.2f}} deviations.',
                mm['n_anomalies']::BIGINT, mm['column_mean'], mm['max_z_score']) END AS explanation, actionable, affected_columns FROM titled""",
        "insight_evidence": EVENT_INSIGHTS + " " + " UNION ALL ".join([
            "SELECT id, 'value' AS metric, mm['value.mean'] AS num, NULL AS txt, 'value' AS \"column\" FROM titled WHERE stat_type = 'summary'",
            evidence_sql("distribution", ["mean", "std", "skew", "kurtosis"]),
            evidence_sql("anomaly", ["n_anomalies", "anomaly_pct", "max_z_score"]),
            "SELECT id, 'anomaly_values', (SELECT list_avg(list_transform(tops, lambda v: " + rounded("v", 2) + ")) FROM anomaly), NULL, 'value' "
            "FROM titled WHERE stat_type = 'anomaly'",
            evidence_sql("categorical_distribution", ["n_unique"]),
            "SELECT id, 'top_value', NULL, (SELECT top_value FROM cat), affected_columns FROM titled WHERE stat_type = 'categorical_distribution'",
            evidence_sql("categorical_distribution", ["top_pct", "bottom_pct"])]),
        "executive_summary": f"""{EVENT_INSIGHTS}
            SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
              format('The unknown table with {{:,}} rows gave {{}} findings, {{}} critical and {{}} of warning level. Most important: {{}}. {{}}',
                (SELECT count(*) FROM events), count(*), critical, warning, arg_min(title, place),
                CASE WHEN critical + warning > 0 THEN 'Resolve this finding first.' ELSE 'No finding calls for immediate action.' END) AS summary
            FROM titled""",
        "claim_check": f"""WITH {ranges_sql("events", "value")},
            claims AS (SELECT event_id, event_type, CASE WHEN event_id % 50 = 1 THEN NULL ELSE value END AS v FROM events)
            SELECT 'EV' || event_id AS id, CASE WHEN event_type NOT IN ('error', 'click', 'signup') THEN ''
              WHEN v IS NULL THEN 'invalid_numeric_evidence: peak' WHEN {ODD} THEN 'evidence_value_implausible: peak=' || v ELSE '' END AS flags
            FROM claims, ranges""",
        "insight_score": f"""WITH {VERDICTS} SELECT id AS insight_id, passed, score AS confidence_score,
            CASE WHEN critical IS NOT NULL THEN 'Critical flag: ' || critical WHEN NOT passed THEN 'Score too low: ' || score END
              AS rejection_reason, array_to_string(flags, ';') AS flags FROM verdict""",
        "critic_report": f"""WITH {VERDICTS}, tally AS (
              SELECT count(*) FILTER (WHERE passed) AS passed_count, count(*) FILTER (WHERE NOT passed) AS rejected_count,
                count(*) FILTER (WHERE len(flags) > 0) AS flagged_count, coalesce(avg(score) FILTER (WHERE passed), 0) AS quality,
                bool_or(critical IS NOT NULL) AS critical, count(*) AS n FROM verdict)
            SELECT passed_count, rejected_count, flagged_count, {rounded("quality", 3)} AS overall_quality,
              critical OR flagged_count > 2 AS needs_human_review, rejected_count > passed_count OR (quality < 0.55 AND n > 2) AS retry_recommended,
              CASE WHEN rejected_count > passed_count OR (quality < 0.55 AND n > 2)
                THEN format('Only {{}}/{{}} insights passed with avg quality {{:.2f}}', passed_count, n, quality) END AS retry_reason FROM tally""",
        "validated_insights": f"WITH {VERDICTS} SELECT id, type, severity, score AS confidence, actionable FROM verdict WHERE passed",
        "rule_match": f"""WITH {INSIGHTS}, {matched_sql("insight")}
            SELECT id, type, severity, action_type, impact_level, effort_level, owner, kpi, boost FROM matched""",
        "rule_match_table": f"""WITH {INSIGHTS}, {RULES},
            all_rules AS (
              SELECT r_regionkey - 100 AS o, NULL AS r_type, CASE WHEN r_regionkey % 2 = 0 THEN 'info' END AS r_severity,
                lower(r_name[:2]) AS keyword, 'route' AS action_type, 'low' AS impact_level, 'low' AS effort_level,
                r_name AS owner, 'share_of_region' AS kpi, 0.05::DOUBLE AS boost FROM region
              UNION ALL SELECT * FROM rules)
            SELECT id, type, severity, action_type, impact_level, effort_level, owner, kpi, boost FROM insight JOIN all_rules
              ON coalesce(r_severity, severity) = severity AND coalesce(r_type, type) = type
                AND (keyword IS NULL OR contains(lower(title), keyword))
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1""",
        "ranked_decisions": f"""WITH {DECISIONS}
            SELECT id, insight_id, action_type, impact_level, effort_level, owner, kpi, priority_score FROM decision""",
        "quick_wins": f"""WITH {DECISIONS} SELECT id, insight_id, impact_level, priority_score FROM decision
            WHERE impact_level IN ('high', 'medium') AND effort_level = 'low'""",
        "action_summary": f"""WITH {DECISIONS}, top AS (
              SELECT '[' || upper(impact_level) || '] Address ' || title AS line,
                row_number() OVER (ORDER BY priority_score DESC, id) AS i FROM decision ORDER BY i LIMIT 3)
            SELECT count(*) AS n, 'For this unknown table, the first action is: ' || min(line) FILTER (WHERE i = 1)
              || '. The most urgent actions are ' || string_agg(line, '; ' ORDER BY i) || '.' AS summary FROM top""",
        "severity_breakdown": f"""WITH {INSIGHTS}, counts AS (
              SELECT s.severity, count(id) AS n FROM (VALUES ('critical'), ('warning'), ('info')) s(severity)
              LEFT JOIN insight USING (severity) GROUP BY s.severity)
            SELECT severity, n, repeat('█', floor(n / (SELECT count(*) FROM insight) * 20)::INT) AS bar FROM counts""",
        "effort_impact": f"""WITH {DECISIONS}, levels(level, points) AS (VALUES ('low', 1), ('medium', 2), ('high', 3))
            SELECT id, e.points AS effort, i.points AS impact, priority_score AS priority, action_type, owner
            FROM decision JOIN levels e ON e.level = effort_level JOIN levels i ON i.level = impact_level
            WHERE (SELECT count(*) FROM decision) >= 2""",
        "chart_bar": "SELECT label, value, share FROM (" + bar_sql(
            "lineitem", "strftime(l_shipdate, '%Y-%m')", "count(*)::DOUBLE", 12) + ")",
        "chart_bar_rest": f"""WITH g AS (SELECT strftime(l_shipdate, '%Y-%m') AS label, count(*)::DOUBLE AS value FROM lineitem
              WHERE l_shipdate IS NOT NULL GROUP BY 1),
            r AS (SELECT row_number() OVER (ORDER BY value DESC, label) AS place, label, value FROM g),
            x AS (SELECT least(place, 13) AS place, min(CASE WHEN place > 12 THEN 'other' ELSE label END) AS label, sum(value) AS value,
              count(*) AS n_labels FROM r GROUP BY 1)
            SELECT *, {rounded("value / sum(value) OVER () * 100", 1)} AS share FROM x""",
        "chart_bar_default": bar_sql("orders", "o_orderstatus", "count(*)::DOUBLE", 12),
        "chart_bar_mean": "SELECT label, value, share FROM (" + bar_sql(
            "orders", "o_orderpriority", rounded("avg(o_totalprice)", 2), 12, True) + ")",
        "chart_bar_sum": "SELECT label, value, share FROM (" + bar_sql(
            "orders", "o_orderpriority", rounded("sum(o_totalprice)", 2), 12, True) + ")",
        "chart_pie": bar_sql("part", "p_brand", "count(*)::DOUBLE", 6),
        "chart_hist": HIST,
        "chart_line": f"""WITH sums AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS value FROM orders GROUP BY 1),
            points AS (SELECT month, value, (row_number() OVER (ORDER BY month) - 1)::DOUBLE AS x FROM sums)
            SELECT month, {rounded("value", 2)} AS value, {rounded("(SELECT regr_slope(value, x) FROM points) * x + (SELECT regr_intercept(value, x) FROM points)", 2)}
              AS trend FROM points""",
        "chart_scatter": f"SELECT user_id::DOUBLE AS x, value AS y, event_type AS color FROM {SAMPLE.format(n=500)}",
        "chart_scatter_trend": f"""WITH s AS (SELECT user_id::DOUBLE AS x, value AS y FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
            f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, min(x) AS lo, max(x) AS hi FROM s)
            SELECT lo AS x, {rounded("a * lo + b", 4)} AS y FROM f UNION ALL SELECT hi, {rounded("a * hi + b", 4)} FROM f""",
        "chart_corr_matrix": f"WITH {PRICED} " + " UNION ALL ".join(
            f"SELECT '{a.replace('_', ' ')}' AS x, '{b.replace('_', ' ')}' AS y, {rounded(f'corr({a}, {b})', 6)} AS r FROM priced"
            for a in CORRELATED for b in CORRELATED),
        "chart_column_stats": column_stats_sql(
            "orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]),
        "text_top_values": " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", place, value, n FROM (SELECT {c} AS value, count(*) AS n, "
            f"row_number() OVER (ORDER BY count(*) DESC, {c})::INT - 1 AS place FROM documents WHERE {c} IS NOT NULL GROUP BY {c}) "
            "WHERE place < 25" for c in ("text", "lang", "source")),
        "chart_slim_stats": "SELECT \"column\", kind, mean, low, high FROM (" + column_stats_sql(
            "customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"])
            + ") WHERE \"column\" = 'c_acctbal' OR (kind = 'categorical' AND n_unique <= 15)",
        "chart_plans": f"WITH {PLANS} SELECT insight_id, chart_type, title, x_column, y_column, aggregation FROM plan",
        "plan_captions": f"""WITH {PLANS} SELECT insight_id, chart_type, x_column, severity,
            '▸ [' || upper(severity) || '] ' || full_title AS caption FROM plan""",
        "box_spread": f"""SELECT columns AS "column", mean, std, q1, q3, iqr, outlier_pct, skew
            FROM ({distribution_sql("orders", ["o_totalprice"])})""",
        "outlier_annotations": f"""WITH {EVENT_ANOMALY}
            SELECT 'value' AS "column", i - 1 AS place, {rounded("tops[i]", 2)} AS value, format('Outlier: {{:,}}', round_even(tops[i], 0)::BIGINT) AS label
            FROM anomaly, (SELECT unnest(range(1, 4)) AS i) WHERE n_anomalies >= i""",
        "spec_captions": f"""{EVENT_INSIGHTS}
            SELECT stat_type, CASE stat_type WHEN 'anomaly' THEN 'histogram' WHEN 'distribution' THEN 'box' ELSE 'bar' END AS chart_type,
              CASE stat_type WHEN 'anomaly' THEN 'Value: values far from the mean' WHEN 'distribution' THEN 'Value: quartiles and far values'
                ELSE 'Event Type by share of rows' END AS title,
              CASE stat_type WHEN 'anomaly' THEN format('Mean {{:.2f}} · {{:,}} outliers', mm['column_mean'], mm['n_anomalies']::BIGINT)
                WHEN 'distribution' THEN 'The box spans the middle half; the dots lie outside the fences'
                ELSE format('The most frequent value covers {{:.1f}}% of the rows', mm['top_pct'] * 100) END AS subtitle
            FROM titled WHERE stat_type <> 'summary'""",
        "stream_rows": f"""SELECT event_type, count(*) AS n, {rounded("sum(value)", 2)} AS total, count(DISTINCT event_id) AS ids,
            strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last_ts, (SELECT ceil(count(*) / 4)::BIGINT FROM events) AS largest_batch
            FROM events GROUP BY event_type""",
        "stream_backlog": """WITH sized AS (SELECT count(*) AS total, greatest(ceil(count(*) / 4)::BIGINT, 1) AS bound FROM events)
            SELECT batch, least(bound, total - batch * bound) AS rows, greatest(total - (batch + 1) * bound, 0) AS behind
            FROM sized, range(4) AS r(batch) WHERE batch * bound < total""",
        "stream_batches": f"""SELECT event_type, count(*) AS n, {rounded("sum(value)", 2)} AS total, count(DISTINCT event_id) AS ids
            FROM events GROUP BY event_type""",
    }
