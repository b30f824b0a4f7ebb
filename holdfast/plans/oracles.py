"""The same results as SQL over the given tables, for checking the queries."""

from __future__ import annotations

from holdfast.plans.queries import DRIFT_FEATURES, SEGMENTS

_CONTRACT = """CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Month-to-month' WHEN 'AUTOMOBILE' THEN 'One year'
    WHEN 'MACHINERY' THEN 'Two year' ELSE c.c_mktsegment END"""
_MONTHS = "CASE contract WHEN 'Month-to-month' THEN 1 WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 END"

BASE = f"""WITH last_orders AS (
  SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey
), base AS (
  SELECT c.c_name AS customer_id, CASE WHEN c.c_nationkey % 5 = 0 THEN 1 ELSE 0 END AS senior,
    {_CONTRACT} AS contract, c.c_mktsegment AS segment, n.n_name AS nation, c.c_acctbal AS monthly_charges,
    CASE WHEN c.c_acctbal < 0 THEN '  ' ELSE CAST(c.c_acctbal AS VARCHAR) END AS total_charges,
    CASE WHEN l.last_order >= TIMESTAMP '2001-02-01 00:00:00' THEN 'No' ELSE 'Yes' END AS churn
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN last_orders l ON c.c_custkey = l.o_custkey
), features AS (
  SELECT customer_id, senior = 1 AS senior, {_MONTHS} AS contract, segment, nation, monthly_charges,
    CASE WHEN length(trim(total_charges)) = 0 THEN CAST(0 AS DOUBLE)
      ELSE TRY_CAST(total_charges AS DOUBLE) END AS total_charges, churn
  FROM base
), order_features AS (
  SELECT c.c_name AS customer_id, count(*) AS orders_placed, max(o.o_totalprice) AS largest_order
  FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_name
), rules AS (
  SELECT customer_id, segment, contract, monthly_charges, churn,
    CASE WHEN contract = 1 THEN 'Yes' ELSE 'No' END AS prediction,
    least(greatest(monthly_charges / 10000, CAST(0.01 AS DOUBLE)), CAST(0.99 AS DOUBLE)) AS probability
  FROM features
), buckets AS (
  SELECT customer_id, CAST('0x' || substr(md5('42|' || length(customer_id) || ':' || customer_id), 1, 8) AS BIGINT) % 100 AS bucket FROM base
)"""

_SIDE = "CASE WHEN k.bucket < 20 THEN 'test' ELSE 'train' END"
_LOOKUP = """SELECT f.customer_id, f.senior, f.contract, f.segment, f.nation, f.monthly_charges, f.total_charges,
  o.orders_placed, o.largest_order {more} FROM features f LEFT JOIN order_features o USING (customer_id)"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# The numeric columns of the line items.
LINEITEM_NUMBERS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
)


def _describe(source: str, columns: tuple[str, ...]) -> str:
    statistics = {
        "count": "CAST(count({c}) AS DOUBLE)",
        "mean": "round(avg({c}), 6)",
        "std": "round(stddev_samp({c}), 6)",
        "min": "CAST(min({c}) AS DOUBLE)",
        "25%": "CAST(quantile_disc({c}, 0.25) AS DOUBLE)",
        "50%": "CAST(quantile_disc({c}, 0.5) AS DOUBLE)",
        "75%": "CAST(quantile_disc({c}, 0.75) AS DOUBLE)",
        "max": "CAST(max({c}) AS DOUBLE)",
    }
    return _union(
        [
            f"SELECT '{name}' AS statistic, "
            + ", ".join(f"{text.format(c=c)} AS {c}" for c in columns)
            + f" FROM {source}"
            for name, text in statistics.items()
        ]
    )


def _summary() -> str:
    parts = []
    for name in ("customer_id", "contract", "segment", "nation", "monthly_charges", "total_charges", "churn"):
        number = name in ("contract", "monthly_charges", "total_charges")
        value = f"CAST({name} AS DOUBLE)" if number else f"TRY_CAST({name} AS DOUBLE)"
        low, high = (f"min({value})", f"max({value})") if number else ("CAST(NULL AS DOUBLE)",) * 2
        first, last = ("CAST(NULL AS VARCHAR)",) * 2 if number else (f"min({name})", f"max({name})")
        parts.append(
            f"SELECT '{name}' AS column, count({name}) AS count, round(avg({value}), 6) AS mean, "
            f"round(stddev_samp({value}), 6) AS stddev, {low} AS min_number, quantile_disc({value}, 0.25) AS p25, "
            f"quantile_disc({value}, 0.5) AS p50, quantile_disc({value}, 0.75) AS p75, {high} AS max_number, "
            f"{first} AS min_text, {last} AS max_text FROM features"
        )
    return _union(parts)


def _profile(source: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        is_text = kind == "string"
        number = f"CAST({name} AS DOUBLE)" if kind in ("int", "bigint", "double") else "CAST(NULL AS DOUBLE)"
        text = name if is_text else "CAST(NULL AS VARCHAR)"
        top = (
            f"SELECT CAST({name} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {name} IS NOT NULL "
            "GROUP BY 1 ORDER BY n DESC, v LIMIT 1"
        )
        parts.append(
            f"SELECT '{name}' AS column, '{kind}' AS type, count(*) AS rows, "
            f"count(*) FILTER (WHERE {name} IS NULL) AS nulls, count(*) FILTER (WHERE coalesce(length(trim({text})) = 0, false)) AS blanks, "
            f"count(*) FILTER (WHERE coalesce({number} = 0, false)) AS zeros, count(DISTINCT {name}) AS distinct_values, "
            f"min({number}) AS min_number, max({number}) AS max_number, min({text}) AS min_text, "
            f"max({text}) AS max_text, (SELECT v FROM ({top})) AS top_value, (SELECT n FROM ({top})) AS top_count "
            f"FROM {source}"
        )
    return _union(parts)


def _histogram(source: str, columns: tuple[str, ...], bins: int) -> str:
    parts = [
        f"""SELECT '{c}' AS column, bin, round(low + bin * width, 6) AS lower,
  round(low + (bin + 1) * width, 6) AS upper, count(*) AS count
FROM (SELECT low, width, CAST(least(floor((v - low) / width), {bins - 1}) AS INTEGER) AS bin
  FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL),
    (SELECT min({c}) AS low, (max({c}) - min({c})) / {bins} AS width FROM {source}))
GROUP BY bin, low, width"""
        for c in columns
    ]
    return _union(parts)


def _cast_audit() -> str:
    return _union(
        [
            f"SELECT '{c}' AS column, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
            f"count(*) FILTER (WHERE coalesce(length(trim({c})) = 0, false)) AS blanks, "
            f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS uncastable FROM base"
            for c in ("customer_id", "contract", "segment", "nation", "total_charges", "churn")
        ]
    )


def _key_audit(source: str, keys: tuple[str, ...]) -> str:
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return f"""SELECT CAST(sum(n) AS BIGINT) AS rows,
  CAST(sum(CASE WHEN {whole} THEN 0 ELSE n END) AS BIGINT) AS null_key_rows,
  count(*) FILTER (WHERE {whole}) AS distinct_keys, count(*) FILTER (WHERE {whole} AND n > 1) AS duplicated_keys,
  CAST(sum(CASE WHEN {whole} THEN n - 1 ELSE 0 END) AS BIGINT) AS surplus_rows
FROM (SELECT {", ".join(keys)}, count(*) AS n FROM {source} GROUP BY ALL)"""


def _leakage() -> str:
    parts = []
    for c in ("senior", "contract", "monthly_charges", "total_charges"):
        x, y = f"CAST({c} AS DOUBLE)", "CASE WHEN churn = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) AS rows, round(corr({y}, {x}), 6) AS correlation, "
            f"coalesce(abs(corr({y}, {x})) >= 0.95, false) AS suspicious FROM features"
        )
    return _union(parts)


_SCORES = """, scores AS (
  SELECT monthly_charges AS score, sum(CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END) AS p,
    sum(CASE WHEN churn = 'Yes' THEN 0 ELSE 1 END) AS n FROM rules GROUP BY monthly_charges
), ranked AS (
  SELECT score, p, n, sum(p) OVER (ORDER BY score) - p AS p_below, sum(n) OVER (ORDER BY score) - n AS n_below,
    sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM scores
)"""


def _psi() -> str:
    parts = []
    for c in DRIFT_FEATURES:
        if c in ("senior", "segment", "nation"):
            place, source = f"CAST({c} AS VARCHAR)", "features"
        else:
            place = f"CASE WHEN {c} IS NOT NULL THEN greatest(least(floor(({c} - low) / width), 9), 0) END"
            place = f"CAST({place} AS VARCHAR)"
            source = (
                f"features, (SELECT min({c}) AS low, CAST(max({c}) - min({c}) AS DOUBLE) / 10 AS width "
                "FROM features WHERE churn = 'No')"
            )
        parts.append(
            f"SELECT '{c}' AS feature, {place} AS bin, count(*) FILTER (WHERE churn = 'No') AS e, count(*) FILTER (WHERE churn <> 'No') AS a "
            f"FROM {source} GROUP BY 2"
        )
    cells = _union(parts)
    return f"""SELECT feature, count(*) AS bins, round(sum((p - q) * ln(p / q)), 6) AS psi FROM (
  SELECT feature, greatest(e / (SELECT count(*) FILTER (WHERE churn = 'No') FROM features), 1e-6) AS p,
    greatest(a / (SELECT count(*) FILTER (WHERE churn <> 'No') FROM features), 1e-6) AS q FROM ({cells}))
GROUP BY feature"""


def _correlations(source: str, columns: dict[str, str]) -> str:
    names = list(columns)
    return _union(
        [
            f"SELECT '{a}' AS column, '{b}' AS other, regr_count({columns[b]}, {columns[a]})::BIGINT AS rows, "
            f"round(corr({columns[b]}, {columns[a]}), 6) AS correlation FROM {source}"
            for i, a in enumerate(names)
            for b in names[i + 1 :]
        ]
    )


def _report() -> str:
    def long(section: str, subject: str, rows: str, numbers: tuple[str, ...], texts: tuple[str, ...] = (), other: str = "CAST(NULL AS VARCHAR)") -> list[str]:
        head = f"SELECT '{section}' AS section, t.{subject} AS subject, {other} AS other"
        return [f"{head}, '{n}' AS measure, round(CAST(t.{n} AS DOUBLE), 6) AS number, CAST(NULL AS VARCHAR) AS text FROM ({rows}) AS t" for n in numbers] + [
            f"{head}, '{n}' AS measure, CAST(NULL AS DOUBLE) AS number, CAST(t.{n} AS VARCHAR) AS text FROM ({rows}) AS t" for n in texts
        ]

    kinds = {
        "customer_id": "string",
        "senior": "boolean",
        "contract": "int",
        "segment": "string",
        "nation": "string",
        "monthly_charges": "double",
        "total_charges": "double",
        "churn": "string",
    }
    counted = ("rows", "nulls", "blanks", "zeros", "distinct_values", "min_number", "max_number", "top_count")
    balance = "SELECT churn, count(*) AS count, count(*) / (SELECT count(*) FROM features) AS share FROM features GROUP BY churn"
    numbers = {"senior": "senior::INTEGER", **{c: c for c in ("contract", "monthly_charges", "total_charges")}, "churn": "(churn = 'Yes')::INTEGER"}
    related = _correlations("features", numbers)
    return _union(
        long("profile", "column", _profile("features", kinds), counted, ("type", "min_text", "max_text", "top_value"))
        + long("summary", "column", _summary(), ("count", "mean", "stddev", "p25", "p50", "p75"))
        + long("balance", "churn", balance, ("count", "share"))
        + long("correlation", "column", related, ("rows", "correlation"), other="t.other")
    )


def _decisions() -> str:
    found = _psi()
    return f"""WITH psi AS ({found}), worse AS (
  SELECT split || '/' || metric AS name
  FROM (SELECT split, metric, max(value) FILTER (WHERE run_id = 'train_run') AS reference,
    max(value) FILTER (WHERE run_id = 'test_run') AS current FROM ({_RULE_METRICS}) GROUP BY split, metric)
  WHERE CASE WHEN metric = 'log_loss' THEN current - reference ELSE reference - current END > 0
), second AS (
  SELECT coalesce((SELECT string_agg(feature, ', ' ORDER BY feature) FROM psi WHERE psi > 0.01), '') AS drifted,
    (SELECT max(psi) FROM psi) AS greatest_psi, coalesce((SELECT string_agg(name, ', ' ORDER BY name) FROM worse), '') AS decayed
), decided AS (
  SELECT *, drifted <> '' OR decayed <> '' AS retrain,
    CASE WHEN drifted <> '' AND decayed <> '' THEN 'drift, metrics' WHEN drifted <> '' THEN 'drift'
      WHEN decayed <> '' THEN 'metrics' ELSE 'nothing changed' END AS reason
  FROM second
)
SELECT 1 AS place, 'first' AS run_id, CAST(NULL AS VARCHAR) AS reference_run, '' AS drifted, CAST(NULL AS DOUBLE) AS greatest_psi,
  '' AS decayed, true AS retrain, 'first run' AS reason
UNION ALL SELECT 2, 'second', 'first', drifted, greatest_psi, decayed, retrain, reason FROM decided
UNION ALL SELECT 3, 'third', CASE WHEN retrain THEN 'second' ELSE 'first' END, CASE WHEN retrain THEN '' ELSE drifted END,
  CASE WHEN retrain THEN 0.0::DOUBLE ELSE greatest_psi END, CASE WHEN retrain THEN '' ELSE decayed END, false, 'nothing changed' FROM decided"""


def _trials() -> str:
    parts = [
        f"SELECT 'below_{p:03d}' AS trial_id, "
        f"round(avg(CASE WHEN (monthly_charges < {p * 100}) = (churn = 'Yes') THEN 1 ELSE 0 END), 6) AS metric FROM base"
        for p in range(0, 101, 5)
    ]
    return f"SELECT trial_id, metric FROM ({_union(parts)}) ORDER BY metric DESC, trial_id LIMIT 1"


def _one_hot() -> str:
    flags = [f"""CAST(segment = '{s}' AS INTEGER) AS "segment={s}\"""" for s in SEGMENTS]
    flags += [
        f"""CAST(contract = '{c}' AS INTEGER) AS "contract={c}\"""" for c in ("Month-to-month", "One year", "Two year")
    ]
    return f"SELECT customer_id, {', '.join(flags)} FROM base"


_RULE_METRICS = _union(
    [
        f"""SELECT {_SIDE} || '_run' AS run_id, 'all' AS split, '{metric}' AS metric, avg({value}) AS value
  FROM rules r JOIN buckets k USING (customer_id) GROUP BY 1"""
        for metric, value in (
            ("accuracy", "CASE WHEN r.churn = r.prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
            ("log_loss", "-ln(CASE WHEN r.churn = 'Yes' THEN r.probability ELSE 1 - r.probability END)"),
        )
    ]
)

_BLANKS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"

_ON_BASE = {
    "select_all": "SELECT * FROM base",
    "input_example": "SELECT * EXCLUDE (churn) FROM features ORDER BY customer_id LIMIT 100",
    "read_csv": "SELECT * FROM base",
    "save_table": "SELECT * REPLACE (monthly_charges * 2 AS monthly_charges) FROM base",
    "snapshot_table": "SELECT * FROM base",
    "feature_table": "SELECT * EXCLUDE (churn) FROM features",
    "feature_table_refresh": """SELECT * EXCLUDE (churn) REPLACE (monthly_charges * 2 AS monthly_charges), true AS same_metadata
FROM features""",
    "feature_table_metadata": """SELECT place, name, place = 0 AS is_key, 'customers by name' AS description,
  (SELECT count(*) FROM base) AS table_rows
FROM (VALUES (0, 'customer_id'), (1, 'senior'), (2, 'contract'), (3, 'segment'), (4, 'nation'), (5, 'monthly_charges'),
  (6, 'total_charges')) AS t(place, name)""",
    "read_csv_inferred": "SELECT * FROM base",
    "read_csv_pandas": "SELECT * FROM base",
    "gbt_predictions": f"""SELECT customer_id, {_SIDE} AS split, churn, true AS score_in_range, true AS prediction_agrees
FROM base JOIN buckets k USING (customer_id)""",
    "auto_trials": """SELECT trial_id, family, 'fitted' AS status, true AS metric_in_range FROM (VALUES
  ('logistic_regression_0', 'logistic_regression'), ('logistic_regression_1', 'logistic_regression'),
  ('decision_tree_0', 'decision_tree'), ('decision_tree_1', 'decision_tree'),
  ('random_forest_0', 'random_forest'), ('boosted_trees_0', 'boosted_trees')) AS t(trial_id, family)""",
    "score_batch": "SELECT customer_id, true AS known_label, true AS as_fitted FROM base",
    "score_stream": """SELECT customer_id, CAST(regexp_extract(customer_id, '[0-9]+') AS BIGINT) AS c_custkey,
  true AS known_label, true AS as_batch FROM base""",
    "score_arrivals": """SELECT customer_id, c_custkey, CAST(c_custkey % 2 AS INTEGER) AS run,
  monthly_charges + c_custkey % 2 AS monthly_charges, true AS as_batch
FROM (SELECT *, CAST(regexp_extract(customer_id, '[0-9]+') AS BIGINT) AS c_custkey FROM features)""",
    "label_frame": "SELECT customer_id, churn FROM base",
    "flag_to_boolean": "SELECT customer_id, senior = 1 AS senior FROM base",
    "map_category": f"SELECT customer_id, contract, {_MONTHS} AS months FROM base",
    "assign_where": """SELECT customer_id, contract,
  CASE WHEN contract = 'Month-to-month' THEN CAST(0 AS DOUBLE) ELSE monthly_charges END AS monthly_charges FROM base""",
    "clean_numeric": """SELECT customer_id, total_charges, CASE WHEN length(trim(total_charges)) = 0 THEN CAST(0 AS DOUBLE)
  ELSE TRY_CAST(total_charges AS DOUBLE) END AS amount FROM base""",
    "featurize": "SELECT * FROM features",
    "feature_lookup": _LOOKUP.format(more=""),
    "training_set": "SELECT * EXCLUDE (customer_id) FROM (" + _LOOKUP.format(more=", f.churn") + ")",
    "leakage_scan": _leakage(),
    "value_counts": "SELECT churn, count(*) AS count FROM base GROUP BY churn",
    "group_count": "SELECT churn, senior, count(*) AS customers FROM base GROUP BY churn, senior",
    "pivot_counts": """SELECT churn, count(*) FILTER (WHERE senior = 0) AS not_senior, count(*) FILTER (WHERE senior = 1) AS senior
FROM base GROUP BY churn""",
    "class_balance": """SELECT churn, count(*) AS count, round(count(*) / (SELECT count(*) FROM base), 6) AS share
FROM base GROUP BY churn""",
    "describe_numeric": _describe("features", ("contract", "monthly_charges", "total_charges")),
    "summary_typed": _summary(),
    "profile_columns": _profile(
        "base",
        {
            "customer_id": "string",
            "senior": "int",
            "contract": "string",
            "segment": "string",
            "nation": "string",
            "monthly_charges": "double",
            "total_charges": "string",
            "churn": "string",
        },
    ),
    "histogram": _histogram("features", ("contract", "monthly_charges", "total_charges"), 10),
    "cast_audit": _cast_audit(),
    "primary_key_audit": _key_audit("base", ("customer_id",)),
    "hash_split": f"SELECT k.customer_id, {_SIDE} AS split FROM buckets k",
    "exact_split": """SELECT customer_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || length(customer_id) || ':' || customer_id))
  <= ceil(0.2 * (SELECT count(*) FROM base)) THEN 'test' ELSE 'train' END AS split FROM base""",
    "one_hot_wide": _one_hot(),
    "accuracy": """SELECT count(*) AS rows, count(*) FILTER (WHERE churn = prediction) AS correct,
  round(count(*) FILTER (WHERE churn = prediction) / count(*), 6) AS accuracy FROM rules""",
    "confusion_matrix": "SELECT churn, prediction, count(*) AS count FROM rules GROUP BY churn, prediction",
    "precision_recall_f1": """SELECT class, support, round(hits / predicted, 6) AS precision,
  round(hits / support, 6) AS recall, round(2 * hits / (support + predicted), 6) AS f1
FROM (SELECT class, count(*) FILTER (WHERE churn = class) AS support, count(*) FILTER (WHERE prediction = class) AS predicted,
  count(*) FILTER (WHERE churn = class AND prediction = class) AS hits FROM rules, (SELECT unnest(['No', 'Yes']) AS class) GROUP BY class)""",
    "log_loss": """SELECT count(*) AS rows, round(avg(-ln(CASE WHEN churn = 'Yes' THEN probability ELSE 1 - probability END)), 6)
  AS log_loss FROM rules""",
    "roc_auc": _SCORES + "SELECT round(sum(p * (n_below + n / 2)) / (max(all_p) * max(all_n)), 6) AS roc_auc FROM ranked",
    "roc_curve": _SCORES + """SELECT score AS threshold, round((all_n - n_below) / all_n, 6) AS fpr,
  round((all_p - p_below) / all_p, 6) AS tpr FROM ranked""",
    "pr_curve": _SCORES + """SELECT score AS threshold,
  round((all_p - p_below) / ((all_p - p_below) + (all_n - n_below)), 6) AS precision,
  round((all_p - p_below) / all_p, 6) AS recall FROM ranked""",
    "metrics_table": f"SELECT run_id, split, metric, round(value, 6) AS value FROM ({_RULE_METRICS})",
    "majority_baseline": f""", sides AS (SELECT b.customer_id, b.segment, b.churn, {_SIDE} AS split
  FROM base b JOIN buckets k USING (customer_id)
), counts AS (SELECT segment, churn, count(*) AS n FROM sides WHERE split = 'train' GROUP BY segment, churn
), winners AS (SELECT segment, churn AS majority FROM counts
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, churn) = 1
) SELECT s.customer_id, s.segment, s.churn, s.split, coalesce(w.majority,
  (SELECT churn FROM counts GROUP BY churn ORDER BY sum(n) DESC, churn LIMIT 1)) AS prediction
FROM sides s LEFT JOIN winners w USING (segment)""",
    "best_trial": _trials(),
    "drift_psi": _psi(),
    "stored_profile_psi": _psi(),
    "retrain_decision": ", " + _decisions().removeprefix("WITH "),
    "exploration_report": _report(),
    "feature_table_drop": """SELECT *, 'customers, labels, orders' AS tables_left, true AS plain_table_refused
FROM (SELECT 'customers' AS "table", 'customer_id' AS primary_keys, 6 AS features, 'customers by name' AS description,
  count(*) AS rows, true AS keys_hold FROM features
UNION ALL SELECT 'orders', 'customer_id', 2, 'orders by customer', count(*), true FROM order_features)""",
    "metric_decay": f"""SELECT split, metric, round(reference, 6) AS reference, round(current, 6) AS current,
  round(worse, 6) AS loss, worse > 0.01 AS decayed
FROM (SELECT *, CASE WHEN metric = 'log_loss' THEN current - reference ELSE reference - current END AS worse
FROM (SELECT split, metric, max(value) FILTER (WHERE run_id = 'train_run') AS reference,
  max(value) FILTER (WHERE run_id = 'test_run') AS current FROM ({_RULE_METRICS}) GROUP BY split, metric))""",
    "score_rule": _LOOKUP.format(more=", CASE WHEN f.contract = 1 THEN 'Yes' ELSE 'No' END AS prediction"),
}

_ON_TABLES = {
    "strip_whitespace": f"""SELECT doc_id,
  regexp_replace(regexp_replace(text, '^{_BLANKS}+', ''), '{_BLANKS}+$', '') AS text FROM documents""",
    "sanitise_names": r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_]+', '_', 'g') AS name FROM pages",
    "scoring_input": """SELECT e.event_id, e.user_id, c.c_mktsegment AS segment, c.c_acctbal AS balance
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "profile_lineitem": _profile(
        "lineitem",
        {
            **dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey"), "bigint"),
            "l_linenumber": "int",
            **dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "double"),
            **dict.fromkeys(("l_returnflag", "l_linestatus"), "string"),
            "l_shipdate": "timestamp_ntz",
        },
    ),
    "correlation_matrix": _correlations("lineitem", {c: c for c in LINEITEM_NUMBERS}),
    "describe_lineitem": _describe("lineitem", LINEITEM_NUMBERS),
    "histogram_lineitem": _histogram("lineitem", LINEITEM_NUMBERS, 20),
    "primary_key_audit_lineitem": _key_audit("lineitem", ("l_orderkey", "l_linenumber")),
    "duplicate_keys": "SELECT o_custkey, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1",
}

ORACLES: dict[str, str] = {
    **{
        name: BASE + (text if text.startswith(",") else "\n" + text)
        for name, text in _ON_BASE.items()
    },
    **_ON_TABLES,
}
