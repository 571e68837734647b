"""Independent ANSI-SQL (DuckDB dialect) statements for the catalogue queries.

Each statement starts from the raw customer view over `customer` + `orders`
and recomputes the operator with plain SQL (window functions over all rows,
``quantile_cont``, ``md5``) - deliberately a different formulation from the
Spark code, so agreement is evidence of correctness.
"""

from __future__ import annotations

from churnspark import schema as S
from churnspark.functions.clean import NUMBER_PATTERN
from churnspark.operators.explain import SCORECARD
from churnspark.plans import catalog as C
from churnspark.sources.fixtures import TELCO_RAW_SQL

D = "DOUBLE"


def _dbl(x) -> str:
    return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else f"CAST({x} AS DOUBLE)"


def _sentinel(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{a}' THEN '{b}'" for a, b in S.SERVICE_SENTINELS.items())
    return f"(CASE {whens} ELSE {col} END)"


def _parse(col: str) -> str:
    return (f"(CASE WHEN regexp_matches({col}, '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST(trim({col}) AS DOUBLE) END)")


def _flag(col: str) -> str:
    x = f"lower({_sentinel(col)})"
    num = f"coalesce(TRY_CAST(trunc({_parse(col)}) AS INTEGER), 0)"
    return (f"(CASE WHEN {x} IN ('yes','true') THEN 1 WHEN {x} IN ('no','false') THEN 0 "
            f"ELSE {num} END)")


def _contract(col: str, lenient: bool) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.CONTRACT_ORDER.items())
    return f"(CASE {col} {whens} ELSE {'0' if lenient else 'NULL'} END)"


def _tenure_group(col: str = "tenure") -> str:
    whens = " ".join(f"WHEN {col} <= {u} THEN '{lab}'" for u, lab in S.TENURE_BINS)
    return f"(CASE {whens} ELSE '{S.LAST_TENURE_BIN}' END)"


STRING_FLAGS = [c for c in S.BOOLEAN_COLS if c not in ("SeniorCitizen",)]

BASE = f"""WITH raw AS ({TELCO_RAW_SQL}),
parsed AS (SELECT *, {_parse('TotalCharges')} AS tc FROM raw),
clean AS (
  SELECT customerID, gender, CAST(SeniorCitizen AS INTEGER) AS SeniorCitizen,
    {', '.join(f'{_flag(c)} AS {c}' for c in STRING_FLAGS)},
    tenure, InternetService, {_contract('Contract', True)} AS Contract,
    {_contract('Contract', False)} AS Contract_strict, Contract AS Contract_raw,
    PaymentMethod, MonthlyCharges,
    coalesce(tc, (SELECT quantile_cont(tc, 0.5) FROM parsed)) AS TotalCharges,
    {_flag('Churn')} AS label, score
  FROM parsed),
eng1 AS (
  SELECT *, {_tenure_group()} AS tenure_group,
    CASE WHEN tenure > {S.LONG_TERM_MONTHS} THEN 1 ELSE 0 END AS LongTerm,
    CASE WHEN tenure < {S.SHORT_TENURE_MONTHS} THEN 1 ELSE 0 END AS LessThan6Months,
    CASE WHEN InternetService = 'No' THEN 0 ELSE 1 END AS AvailingInternetService
  FROM clean),
eng2 AS (SELECT *, {' + '.join(S.SERVICE_COLS)} AS NumServices FROM eng1),
eng AS (SELECT *, MonthlyCharges / CASE WHEN NumServices = 0 THEN 1 ELSE NumServices END AS AvgCharge
        FROM eng2)"""


def q(body: str, extra: str = "") -> str:
    return BASE + (",\n" + extra if extra else "") + "\n" + body


CLEAN_SELECT = ", ".join(
    "round(TotalCharges, 6) AS TotalCharges" if c == "TotalCharges" else
    ("label AS Churn" if c == "Churn" else c) for c in C.CLEAN_COLS)

# ---------------------------------------------------------------- F, G

SQL: dict[str, str] = {}

SQL["clean_lenient"] = q(f"SELECT {CLEAN_SELECT} FROM clean")

SQL["clean_strict"] = q(
    "SELECT " + CLEAN_SELECT.replace("Contract,", "Contract_strict AS Contract,") +
    ", tenure_group, LongTerm, AvailingInternetService, NumServices, "
    "round(AvgCharge, 6) AS AvgCharge, LessThan6Months FROM eng")


def _mode_sql(col: str, src: str) -> str:
    return (f"SELECT '{col}' AS feature, (SELECT {col} FROM {src} WHERE {col} IS NOT NULL "
            f"GROUP BY {col} ORDER BY count(*) DESC, {col} ASC LIMIT 1) AS fill_value")


SQL["impute_mode"] = q(
    " UNION ALL ".join(_mode_sql(c, "rt") for c in C.MODE_COLS),
    f"rt AS (SELECT *, {_tenure_group()} AS tenure_group FROM raw)")

SQL["impute_numeric"] = q(
    """SELECT customerID, round(coalesce(tc, m), 6) AS TotalCharges_mean,
       round(coalesce(tc, med), 6) AS TotalCharges_median,
       round(coalesce(tc, mo), 6) AS TotalCharges_mode
FROM parsed, st""",
    """st AS (SELECT avg(tc) AS m, quantile_cont(tc, 0.5) AS med,
  (SELECT tc FROM parsed WHERE tc IS NOT NULL GROUP BY tc ORDER BY count(*) DESC, tc ASC LIMIT 1) AS mo
  FROM parsed)""")


def _rules() -> list[tuple[str, str]]:
    def enum(c, vals):
        return f"({c} IS NULL OR {c} NOT IN ({', '.join(repr(v) for v in vals)}))"
    out = [("gender", enum("gender", S.GENDERS))]
    out += [(c, f"({c} IS NULL OR {c} < 0 OR {c} > 1)") for c in S.UNIT_RANGE_COLS]
    out += [("InternetService", enum("InternetService", S.INTERNET_SERVICES)),
            ("Contract", enum("Contract", S.CONTRACTS)),
            ("PaymentMethod", "(PaymentMethod IS NULL)")]
    out += [(c, f"({c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR {c} < 0)")
            for c in S.NON_NEGATIVE_COLS]
    return out


VALIDATION_INPUT = "vin AS (SELECT * REPLACE (Contract_raw AS Contract) FROM clean)"

SQL["validate_rejects"] = q(
    "SELECT customerID, array_to_string(reasons, ',') AS reasons FROM rs WHERE len(reasons) > 0",
    VALIDATION_INPUT + ",\nrs AS (SELECT customerID, list_filter([" +
    ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _rules()) +
    "], lambda x: x IS NOT NULL) AS reasons FROM vin)")

# Rows with wrong values, which the rules must find.
_SPOILED = VALIDATION_INPUT + """,
bad AS (SELECT * REPLACE (
  CASE WHEN tenure % 7 = 0 THEN 'unknown' ELSE gender END AS gender,
  CASE WHEN tenure % 11 = 0 THEN -MonthlyCharges - 1 ELSE MonthlyCharges END AS MonthlyCharges,
  CASE WHEN tenure % 13 = 0 THEN NULL ELSE InternetService END AS InternetService,
  CASE WHEN tenure % 17 = 0 THEN 2 ELSE Partner END AS Partner) FROM vin)"""
SQL["validate_spoiled_rejects"] = q(
    "SELECT customerID, array_to_string(reasons, ',') AS reasons FROM rs WHERE len(reasons) > 0",
    _SPOILED + ",\nrs AS (SELECT customerID, list_filter([" +
    ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _rules()) +
    "], lambda x: x IS NOT NULL) AS reasons FROM bad)")
SQL["validate_spoiled_counts"] = q(
    " UNION ALL ".join(
        [f"SELECT '{name}' AS rule, CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM bad" for name, cond in _rules()] +
        ["SELECT 'rows_total' AS rule, CAST(count(*) AS BIGINT) AS n FROM bad",
         "SELECT 'rows_valid' AS rule, CAST(sum(CASE WHEN " + " OR ".join(cond for _, cond in _rules()) + " THEN 0 ELSE 1 END) AS BIGINT) AS n FROM bad"]),
    _SPOILED)

SQL["validate_counts"] = q(
    " UNION ALL ".join(
        [f"SELECT '{name}' AS rule, CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM vin"
         for name, cond in _rules()] +
        ["SELECT 'rows_total' AS rule, CAST(count(*) AS BIGINT) AS n FROM vin",
         "SELECT 'rows_valid' AS rule, CAST(sum(CASE WHEN " +
         " OR ".join(cond for _, cond in _rules()) + " THEN 0 ELSE 1 END) AS BIGINT) AS n FROM vin"]),
    VALIDATION_INPUT)

RAW_COLS = [f.name for f in S.RAW_SCHEMA.fields]
SQL["drop_nulls"] = q(
    "SELECT " + ", ".join("round(tc, 6) AS TotalCharges" if c == "TotalCharges" else c
                          for c in RAW_COLS) +
    " FROM parsed WHERE " + " AND ".join(
        ("tc IS NOT NULL AND NOT isnan(tc)" if c == "TotalCharges" else
         (f"{c} IS NOT NULL AND NOT isnan({c})" if c == "MonthlyCharges" else f"{c} IS NOT NULL"))
        for c in RAW_COLS))

SQL["label_codes"] = q(
    "SELECT customerID, " + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in C.CODE_COLS) +
    " FROM rt",
    f"rt AS (SELECT *, {_tenure_group()} AS tenure_group FROM raw)")

SQL["tenure_features"] = q(
    f"""SELECT customerID, tenure, {_tenure_group()} AS tenure_group,
  CASE WHEN tenure > {S.LONG_TERM_MONTHS} THEN 1 ELSE 0 END AS LongTerm,
  CASE WHEN tenure < {S.SHORT_TENURE_MONTHS} THEN 1 ELSE 0 END AS LessThan6Months FROM raw""")

SQL["service_features"] = q(
    "SELECT customerID, AvailingInternetService, NumServices, round(AvgCharge, 6) AS AvgCharge FROM eng")


def _yj(col: str, lam: float) -> str:
    x = f"CAST({col} AS DOUBLE)"
    pos = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {_dbl(lam)}) - 1) / {_dbl(lam)}"
    neg = (f"-ln(1 - {x})" if lam == 2 else
           f"-(pow(1 - {x}, {_dbl(2.0 - lam)}) - 1) / {_dbl(2.0 - lam)}")
    return f"round(CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END, 6) AS {col}_yj"


SQL["yeo_johnson_fixed"] = q(
    "SELECT customerID, " + ", ".join(_yj(c, lam) for c, lam in C.YJ_LAMBDAS.items()) + " FROM eng")

# levels of the fixture's categorical columns, sorted; the first one is dropped
ONE_HOT_LEVELS = {
    "gender": ["Female", "Male"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)",
                      "Electronic check", "Mailed check"],
    "tenure_group": ["0-12 Months", "13-24 Months", "25-48 Months", "49-60 Months",
                     "61-72 Months"],
}
SQL["one_hot"] = q(
    "SELECT customerID, " + ", ".join(
        f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{v}\""
        for c, vals in ONE_HOT_LEVELS.items() for v in vals[1:]) + " FROM eng")

SQL["one_hot_sparse"] = q(
    "SELECT c || '_' || v AS name, n FROM rk WHERE rn > 1",
    "lv AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, {c} AS v, count(*) AS n FROM eng WHERE {c} IS NOT NULL GROUP BY {c}" for c in S.CATEGORICAL) + "),\n"
    "rk AS (SELECT c, v, n, row_number() OVER (PARTITION BY c ORDER BY v) AS rn FROM lv)")

_fixed_names = list(S.NUMERIC + S.EXTRA_NUMERIC) + list(S.APP_BOOL)
SQL["feature_names"] = q(
    "SELECT CAST(row_number() OVER (ORDER BY g1, g2) - 1 AS INTEGER) AS idx, name FROM nm",
    "lv AS (" + " UNION ALL ".join(
        f"SELECT {i} AS g, '{c}' AS c, {c} AS v FROM eng GROUP BY {c}"
        for i, c in enumerate(S.CATEGORICAL)) + "),\n"
    "rk AS (SELECT g, c, v, row_number() OVER (PARTITION BY g ORDER BY v) AS rn FROM lv),\n"
    "nm AS (SELECT g AS g1, rn AS g2, c || '_' || v AS name FROM rk WHERE rn > 1 UNION ALL "
    "SELECT 100 AS g1, i AS g2, name FROM (VALUES " +
    ", ".join(f"({i}, '{n}')" for i, n in enumerate(_fixed_names)) + ") t(i, name))")

# ---------------------------------------------------------------- X

_HASH = f"md5('{S.SEED}:' || customerID)"
_QUOTA = f"""cnt AS (SELECT label, count(*) AS n_c FROM clean GROUP BY label),
qtot AS (SELECT sum(n_c) AS n, CAST(ceil({_dbl(C.SPLIT_FRAC)} * sum(n_c)) AS BIGINT) AS n_test FROM cnt),
qa AS (SELECT label, floor(CAST(n_c * n_test AS DOUBLE) / n) AS fl,
         CAST(n_c * n_test AS DOUBLE) / n - floor(CAST(n_c * n_test AS DOUBLE) / n) AS rem, n_test
       FROM cnt, qtot),
qb AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label ASC)
                              <= n_test - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM qa),
rk AS (SELECT customerID, label, score,
         row_number() OVER (PARTITION BY label ORDER BY {_HASH}, customerID) AS rn FROM clean),
sp AS (SELECT rk.customerID, rk.label, rk.score,
         CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM rk JOIN qb USING (label))"""

SQL["stratified_split"] = q("SELECT customerID, label, split FROM sp", _QUOTA)

SQL["plain_split"] = q(
    f"""SELECT customerID, CASE WHEN row_number() OVER (ORDER BY {_HASH}, customerID)
        <= (SELECT CAST(ceil({_dbl(C.SPLIT_FRAC)} * count(*)) AS BIGINT) FROM clean)
        THEN 'test' ELSE 'train' END AS split FROM clean""")

SQL["folds"] = q(
    f"""SELECT customerID, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_HASH}, customerID) - 1)
        % {C.N_FOLDS} AS INTEGER) AS fold FROM clean""")

SQL["range_folds"] = q(
    f"""SELECT customerID, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY {_HASH}, customerID) - 1 AS INTEGER) AS fold
        FROM clean""")

SQL["capped_sample"] = q(
    f"SELECT customerID, score FROM clean ORDER BY {_HASH}, customerID LIMIT {C.SAMPLE_CAP}")

SQL["class_weights"] = q(
    """SELECT customerID, clean.label, round(CAST(t.n AS DOUBLE) / (t.k * c.n_c), 6) AS weight
FROM clean JOIN (SELECT label, count(*) AS n_c FROM clean GROUP BY label) c USING (label),
     (SELECT count(*) AS n, count(DISTINCT label) AS k FROM clean) t""")

# ---------------------------------------------------------------- V, M15

SQL["minmax_score"] = q(
    """SELECT customerID, round(CASE WHEN hi > lo THEN (margin - lo) / (hi - lo) ELSE 0 END, 6)
  AS score_minmax FROM mg, (SELECT min(margin) AS lo, max(margin) AS hi FROM mg)""",
    "mg AS (SELECT customerID, score * 4 - 2 AS margin FROM clean)")

SQL["threshold_label"] = q(
    f"SELECT customerID, score, CAST(score >= {S.DEFAULT_THRESHOLD} AS INTEGER) AS prediction FROM clean")

MEMBERS_CTE = """mb AS (
  SELECT customerID, label, score,
         1.0 - CAST(tenure AS DOUBLE) / CAST(72 AS DOUBLE) AS tenure_score,
         CASE WHEN hi > lo THEN (MonthlyCharges - lo) / (hi - lo) ELSE 0 END AS charge_score
  FROM clean, (SELECT min(MonthlyCharges) AS lo, max(MonthlyCharges) AS hi FROM clean)),
ml AS (SELECT customerID, label, 'score' AS model, score FROM mb
       UNION ALL SELECT customerID, label, 'tenure_score', tenure_score FROM mb
       UNION ALL SELECT customerID, label, 'charge_score', charge_score FROM mb)"""

SQL["soft_vote"] = q(
    f"""SELECT customerID, round(v, 6) AS vote_score, CAST(v >= {S.DEFAULT_THRESHOLD} AS INTEGER) AS vote_label
FROM (SELECT customerID, (score + tenure_score + charge_score) / CAST(3 AS DOUBLE) AS v FROM mb)""",
    MEMBERS_CTE)

# ---------------------------------------------------------------- E

T5 = S.DEFAULT_THRESHOLD


def _cells(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""SELECT {g}
  CAST(sum(CASE WHEN label = 0 AND score < {T5} THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label = 0 AND score >= {T5} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND score < {T5} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 1 AND score >= {T5} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  avg((score - label) * (score - label)) AS brier
FROM {src}{gb}"""


def _div0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


RATES = {
    "accuracy": _div0("tp + tn", "tn + fp + fn + tp"),
    "precision": _div0("tp", "tp + fp"),
    "recall": _div0("tp", "tp + fn"),
    "f1": _div0("2 * tp", "2 * tp + fp + fn"),
}


def _curves(src: str, group: str = "") -> str:
    """CTE text: lvl/cum/tot per group, and crv with roc_auc / pr_auc."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    join = f" JOIN tot USING ({group})" if group else ", tot"
    return f"""lvl AS (SELECT {g}score AS threshold, CAST(sum(label) AS DOUBLE) AS tp_s,
                CAST(sum(1 - label) AS DOUBLE) AS fp_s FROM {src} GROUP BY {g}score),
cum AS (SELECT *, sum(tp_s) OVER ({part}ORDER BY threshold DESC) AS tp_cum,
               sum(fp_s) OVER ({part}ORDER BY threshold DESC) AS fp_cum FROM lvl),
tot AS (SELECT {g}sum(tp_s) AS P, sum(fp_s) AS N FROM lvl{gb}),
cj AS (SELECT * FROM cum{join}),
crv AS (SELECT {g}CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(fp_s * (tp_cum - tp_s / 2.0)) / (max(P) * max(N)) END AS roc_auc,
               CASE WHEN max(P) > 0 THEN sum(tp_s * (tp_cum / (tp_cum + fp_cum))) / max(P) END AS pr_auc
        FROM cj{gb})"""


SQL["confusion"] = q("SELECT tn, fp, fn, tp FROM (" + _cells("clean") + ")")
SQL["basic_metrics"] = q(
    "SELECT tn, fp, fn, tp, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in RATES.items()) +
    " FROM (" + _cells("clean") + ")")
SQL["roc_auc"] = q("SELECT round(roc_auc, 6) AS roc_auc FROM crv", _curves("clean"))
SQL["avg_precision"] = q("SELECT round(pr_auc, 6) AS pr_auc FROM crv", _curves("clean"))
SQL["brier"] = q("SELECT round(avg((score - label) * (score - label)), 6) AS brier FROM clean")
SQL["roc_curve"] = q(
    """SELECT threshold, round(CASE WHEN N = 0 THEN 0 ELSE fp_cum / N END, 6) AS fpr,
       round(CASE WHEN P = 0 THEN 0 ELSE tp_cum / P END, 6) AS tpr FROM cj
UNION ALL SELECT NULL, 0.0, 0.0""", _curves("clean"))
SQL["pr_curve"] = q(
    """SELECT threshold, round(tp_cum / (tp_cum + fp_cum), 6) AS precision,
       round(CASE WHEN P = 0 THEN 1.0 ELSE tp_cum / P END, 6) AS recall FROM cj
UNION ALL SELECT NULL, 1.0, 0.0""", _curves("clean"))

_STEP = f"(CAST(1 AS DOUBLE) / {S.SWEEP_POINTS - 1})"
_TOP = S.SWEEP_POINTS - 1


def _thr(i: str) -> str:
    return f"(CASE WHEN {i} = {_TOP} THEN CAST(1 AS DOUBLE) ELSE CAST({i} AS DOUBLE) * {_STEP} END)"


SWEEP_CTE = f"""b0 AS (SELECT label, score, greatest(least(CAST(floor(score * {_TOP}.0) AS INTEGER), {_TOP}), -1) AS i0 FROM clean),
b1 AS (SELECT label, score, CASE WHEN i0 >= 0 AND score < {_thr('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT label, score, CASE WHEN i1 < {_TOP} AND score >= {_thr('i1 + 1')} THEN i1 + 1 ELSE i1 END AS b FROM b1),
swh AS (SELECT b, sum(label) AS pos, sum(1 - label) AS neg FROM b2 GROUP BY b),
gi AS (SELECT CAST(i AS INTEGER) AS i FROM range(-1, {S.SWEEP_POINTS}) t(i)),
pi AS (SELECT i, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM gi LEFT JOIN swh ON swh.b = gi.i),
cm AS (SELECT i, sum(pos) OVER (ORDER BY i DESC) AS tp, sum(neg) OVER (ORDER BY i DESC) AS fp,
              sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM pi),
sw AS (SELECT i, {_thr('i')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
              CAST(N - fp AS BIGINT) AS tn, CAST(P - tp AS BIGINT) AS fn,
              CASE WHEN 2 * tp + fp + (P - tp) = 0 THEN 0.0
                   ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + (P - tp)) END AS f1
       FROM cm WHERE i >= 0),
bf AS (SELECT threshold AS best_f1_threshold, f1 AS best_f1_score FROM sw ORDER BY f1 DESC, i ASC LIMIT 1)"""

SQL["f1_sweep"] = q("SELECT i, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM sw", SWEEP_CTE)
SQL["cm_sweep"] = q("SELECT i, round(threshold, 6) AS threshold, tp, fp, tn, fn FROM sw", SWEEP_CTE)
SQL["best_f1"] = q("SELECT round(best_f1_threshold, 6) AS best_f1_threshold, "
                   "round(best_f1_score, 6) AS best_f1_score FROM bf", SWEEP_CTE)

SQL["best_pr_threshold"] = q(
    f"""SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT threshold, (2 * pr * rc) / (pr + rc + {S.PR_F1_EPS!r}) AS f1 FROM (
    SELECT threshold, tp_cum / (tp_cum + fp_cum) AS pr,
           CASE WHEN P = 0 THEN 1.0 ELSE tp_cum / P END AS rc FROM cj))
ORDER BY f1 DESC, threshold ASC LIMIT 1""", _curves("clean"))

SQL["class_report"] = q(
    f"""SELECT '0' AS class, round({_div0('tn', 'tn + fn')}, 6) AS precision,
       round({_div0('tn', 'tn + fp')}, 6) AS recall, round({_div0('2 * tn', '2 * tn + fn + fp')}, 6) AS f1,
       CAST(tn + fp AS BIGINT) AS support FROM ce
UNION ALL SELECT '1', round({_div0('tp', 'tp + fp')}, 6), round({_div0('tp', 'tp + fn')}, 6),
       round({_div0('2 * tp', '2 * tp + fp + fn')}, 6), CAST(tp + fn AS BIGINT) FROM ce
UNION ALL SELECT 'accuracy', NULL, NULL, round({_div0('tp + tn', 'tn + fp + fn + tp')}, 6),
       CAST(tn + fp + fn + tp AS BIGINT) FROM ce
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM pc
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
       round((f0 * s0 + f1 * s1) / n, 6), n FROM pc""",
    "ce AS (" + _cells("clean") + "),\n" +
    f"""pc AS (SELECT {_div0('tn', 'tn + fn')} AS p0, {_div0('tp', 'tp + fp')} AS p1,
  {_div0('tn', 'tn + fp')} AS r0, {_div0('tp', 'tp + fn')} AS r1,
  {_div0('2 * tn', '2 * tn + fn + fp')} AS f0, {_div0('2 * tp', '2 * tp + fp + fn')} AS f1,
  CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fn AS DOUBLE) AS s1,
  CAST(tn + fp + fn + tp AS BIGINT) AS n FROM ce)""")


def _hist(src: str, group: str, bins: int) -> str:
    """numpy-compatible histogram CTEs over (group, score) rows of ``src``."""
    edge = (lambda j: f"(CASE WHEN {j} >= {bins} THEN hi ELSE CAST({j} AS DOUBLE) * step + lo END)")
    return f"""hs0 AS (SELECT {group}, min(score) AS lo0, max(score) AS hi0, count(*) AS total FROM {src}
        WHERE score IS NOT NULL GROUP BY {group}),
hs AS (SELECT {group}, total, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM hs0),
hst AS (SELECT *, (hi - lo) / CAST({bins} AS DOUBLE) AS step FROM hs),
hj0 AS (SELECT s.{group}, s.score, hst.lo, hst.hi, hst.step,
          CAST(trunc((s.score - hst.lo) / (hst.hi - hst.lo) * CAST({bins} AS DOUBLE)) AS BIGINT) AS j
        FROM {src} s JOIN hst USING ({group}) WHERE s.score IS NOT NULL),
hj1 AS (SELECT *, CASE WHEN j = {bins} THEN j - 1 ELSE j END AS j1 FROM hj0),
hj2 AS (SELECT *, CASE WHEN score < {edge('j1')} THEN j1 - 1 ELSE j1 END AS j2 FROM hj1),
hj3 AS (SELECT {group}, CASE WHEN score >= {edge('j2 + 1')} AND j2 <> {bins - 1} THEN j2 + 1 ELSE j2 END AS bin
        FROM hj2),
hc AS (SELECT {group}, bin, count(*) AS cnt FROM hj3 GROUP BY {group}, bin),
hg AS (SELECT hst.*, CAST(b AS INTEGER) AS bin FROM hst, range(0, {bins}) t(b)),
hout AS (SELECT hg.{group}, hg.bin, round({edge('hg.bin')}, 6) AS bin_left,
           round({edge('hg.bin + 1')}, 6) AS bin_right, CAST(coalesce(cnt, 0) AS BIGINT) AS count,
           {edge('hg.bin')} AS bl, {edge('hg.bin + 1')} AS br, total
         FROM hg LEFT JOIN hc ON hc.{group} = hg.{group} AND hc.bin = hg.bin)"""


SQL["hist_by_class"] = q(
    "SELECT label, bin, bin_left, bin_right, count, "
    "round(CAST(count AS DOUBLE) / (br - bl) / total, 6) AS density FROM hout",
    _hist("clean", "label", S.CLASS_HIST_BINS))

SQL["hist_by_outcome"] = q(
    "SELECT outcome, bin, bin_left, bin_right, count FROM hout",
    SWEEP_CTE + ",\n" +
    """oc AS (SELECT CASE WHEN label = 1 AND score >= t THEN 'TP' WHEN label = 0 AND score < t THEN 'TN'
                   WHEN label = 0 AND score >= t THEN 'FP' ELSE 'FN' END AS outcome, score
       FROM clean, (SELECT best_f1_threshold AS t FROM bf)),\n""" +
    _hist("oc", "outcome", S.OUTCOME_HIST_BINS))


def _metric_select(group: str) -> str:
    return (f"SELECT pt.{group}, tn, fp, fn, tp, " +
            ", ".join(f"round({e}, 6) AS {k}" for k, e in RATES.items()) +
            ", round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier "
            f"FROM pt LEFT JOIN crv USING ({group})")


SQL["compare_models"] = q(
    _metric_select("model"),
    MEMBERS_CTE + ",\npt AS (" + _cells("ml", "model") + "),\n" + _curves("ml", "model"))

SQL["pick_best"] = q(
    "SELECT model, round(pr_auc, 6) AS pr_auc FROM crv WHERE pr_auc IS NOT NULL "
    "ORDER BY pr_auc DESC, model ASC LIMIT 1",
    MEMBERS_CTE + ",\n" + _curves("ml", "model"))

SQL["train_test_metrics"] = q(
    _metric_select("split"),
    _QUOTA + ",\npt AS (" + _cells("sp", "split") + "),\n" + _curves("sp", "split"))

SQL["registry_best"] = q(
    """SELECT name, version, round(pr_auc, 6) AS pr_auc FROM (
  SELECT model AS name, 'v' || CAST(row_number() OVER (ORDER BY model) AS VARCHAR) AS version,
         1.7e9 + row_number() OVER (ORDER BY model) AS created_at, pr_auc FROM crv)
ORDER BY coalesce(pr_auc, 0) DESC, created_at DESC LIMIT 1""",
    MEMBERS_CTE + ",\n" + _curves("ml", "model"))

# ---------------------------------------------------------------- R, H, K

_LEVELS = S.RISK_LEVELS


def _segment(cut_cols) -> str:
    whens = " ".join(f"WHEN score >= {c} THEN '{name}'" for (name, _), c in zip(_LEVELS, cut_cols))
    return f"(CASE {whens} ELSE '{S.LOWEST_RISK}' END)"


SEG_CTE = ("qs AS (SELECT " + ", ".join(
    f"quantile_cont(score, {q_}) AS q{i}" for i, (_, q_) in enumerate(_LEVELS)) + " FROM clean),\n"
    "seg AS (SELECT customerID, label, score, " + _segment([f"q{i}" for i in range(len(_LEVELS))]) +
    " AS risk_segment FROM clean, qs)")

SQL["risk_quantile"] = q("SELECT customerID, score, risk_segment FROM seg", SEG_CTE)
SQL["risk_bands"] = q(
    "SELECT customerID, score, " + _segment([repr(q_) for _, q_ in _LEVELS]) +
    " AS risk_segment FROM clean")
SQL["risk_summary"] = q(
    """SELECT risk_segment, count(score) AS customer_count, round(avg(score), 6) AS avg_churn_probability,
       CAST(sum(label) AS BIGINT) AS actual_churned, round(avg(CAST(label AS DOUBLE)), 6) AS churn_rate,
       round_even(CAST(count(score) AS DOUBLE) / (SELECT count(*) FROM seg) * 100, 2) AS percentage
FROM seg WHERE risk_segment IS NOT NULL GROUP BY risk_segment""", SEG_CTE)

SQL["risk_actions"] = q(
    "SELECT customerID, risk_segment, " + ", ".join(
        "CASE risk_segment " + " ".join(f"WHEN '{seg}' THEN '{vals[i]}'"
                                        for seg, vals in S.INTERVENTIONS.items()) + f" END AS {name}"
        for i, name in enumerate(["discount", "contact", "priority"])) + " FROM seg", SEG_CTE)

SQL["high_risk_list"] = q(
    "SELECT customerID, score, risk_segment FROM seg WHERE risk_segment = 'Very High Risk'", SEG_CTE)

_FEATS = list(SCORECARD)
CONTRIB_CTE = ("mu AS (SELECT " + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in _FEATS) +
               " FROM eng),\n"
               "lg AS (" + " UNION ALL ".join(
                   f"SELECT customerID, '{f}' AS feature, {i} AS pos, CAST({f} AS DOUBLE) AS feature_value, "
                   f"{_dbl(float(w))} * (CAST({f} AS DOUBLE) - m_{f}) AS contribution FROM eng, mu"
                   for i, (f, w) in enumerate(SCORECARD.items())) + "),\n"
               "tk AS (SELECT customerID, feature, contribution, row_number() OVER "
               "(PARTITION BY customerID ORDER BY abs(contribution) DESC, pos ASC) AS rank FROM lg),\n"
               "imp AS (SELECT feature, avg(abs(contribution)) AS importance FROM lg GROUP BY feature),\n"
               "top2 AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature ASC) AS r "
               "FROM imp)")

SQL["top_factors"] = q(f"SELECT customerID, rank, feature FROM tk WHERE rank <= {C.TOP_K}", CONTRIB_CTE)
SQL["row_contributors"] = q(
    f"SELECT customerID, rank, feature, round(contribution, 6) AS contribution FROM tk "
    f"WHERE rank <= {C.TOP_K}", CONTRIB_CTE)
SQL["importance"] = q(
    "SELECT feature, round(importance, 6) AS importance FROM imp "
    "ORDER BY importance DESC, feature ASC LIMIT 20", CONTRIB_CTE)
SQL["dependence"] = q(
    """SELECT a.customerID, a.feature, round(a.feature_value, 6) AS feature_value,
       round(a.contribution, 6) AS contribution, b.feature AS color_feature,
       round(b.feature_value, 6) AS color_value
FROM lg a JOIN lg b ON a.customerID = b.customerID
WHERE a.feature = (SELECT feature FROM top2 WHERE r = 1) AND b.feature = (SELECT feature FROM top2 WHERE r = 2)""",
    CONTRIB_CTE)

SQL["kpis"] = q(
    f"""SELECT count(*) AS customers, round(avg(CAST(label AS DOUBLE)), 6) AS churn_rate,
       round(avg(CASE WHEN CAST(score >= {T5} AS INTEGER) = label THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy,
       CAST(sum(CASE WHEN risk_segment IN ('Very High Risk', 'High Risk') THEN 1 ELSE 0 END) AS BIGINT)
         AS high_risk_count FROM seg""", SEG_CTE)

SQL["category_counts"] = q(" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM eng GROUP BY {c}"
    for c in C.KPI_CATEGORIES))

_pairs = [(a, b) for i, a in enumerate(C.CORR_COLS) for b in C.CORR_COLS[i + 1:]]
SQL["correlations"] = q(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM eng"
    for a, b in _pairs))


# ---------------------------------------------------------------- model checks

for _name in ("tree_shap_additivity", "forest_shap_additivity", "boost_shap_additivity", "grown_shap_additivity", "vote_is_mean", "shapley_rows",
              "tree_prediction_rows", "forest_prediction_rows", "boost_prediction_rows", "xgb_prediction_rows", "lgbm_prediction_rows", "cat_prediction_rows",
              "logreg_prediction_rows", "voting_probabilities", "calibration_probabilities"):
    SQL[_name] = q("SELECT count(*) AS n_rows, 0 AS n_bad FROM sp WHERE split = 'test'", _QUOTA)
SQL["predict_batch_rows"] = q("SELECT count(*) AS n_rows, 0 AS n_bad FROM sp", _QUOTA)
for _name in ("smote_rows", "adasyn_rows"):
    SQL[_name] = q("SELECT count(*) FILTER (label = 0) AS n_larger, count(*) AS n_original, 0 AS n_bad FROM sp WHERE split = 'train'", _QUOTA)
SQL["smote_classes"] = q("SELECT unnest([0, 1]) AS label, count(*) FILTER (label = 0) AS n FROM sp WHERE split = 'train'", _QUOTA)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
