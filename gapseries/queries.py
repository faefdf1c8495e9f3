"""Registered queries over the driver's tables, each with a DuckDB twin.

Every query reads whole tables (the role mapping is in
:mod:`gapseries.sources.testdata`).  Computed doubles are rounded on both
sides -- 6 decimals, 4 for standardised values and summed likelihoods --
because the engines' ``pow``, ``exp`` and summation order differ in the last
bits; SQL twins add ``+ 0.0`` where a rounded value can be a negative zero.
Queries without an SQL twin are checked in ``tests/`` against brute-force
NumPy instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapseries.functions.columns import binary_label
from gapseries.operators import cohort as co
from gapseries.operators import matrix as mx
from gapseries.operators import metrics as me
from gapseries.operators import sampling as sa
from gapseries.operators import series as se
from gapseries.operators.features import standardize
from gapseries.plans.cohort import build_cohort
from gapseries.plans.matrix import code_item_matrix
from gapseries.sources import testdata as td

# Fixed parameters of the registered queries.
CODE1, CODE2 = "1F", "2O"
ITEM_CODE = "CLICK"
ALL_ITEM_CODES = ["CLICK", "VIEW", "PURCHASE", "SIGNUP", "ERROR"]
SEED = 74565
R = 6  # rounding of computed doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rnd(c: str, r: int = R):
    return F.round(F.col(c), r).alias(c)


def hash_sql(cols: list[str], seed) -> str:
    """DuckDB twin of :func:`gapseries.functions.columns.key_hash`."""
    return ("('0x' || substr(md5(concat_ws('|', '{s}', {c})), 1, 8))::BIGINT"
            .format(s=seed, c=", ".join(f"CAST({c} AS VARCHAR)" for c in cols)))


# ---------------------------------------------------------------- cohort ---

EXCL_SQL = f"""
SELECT entity, num_code1, num_code2 FROM (
  SELECT entity,
         CAST(sum(CASE WHEN category = '{CODE1}' THEN 1 ELSE 0 END) AS BIGINT) AS num_code1,
         CAST(sum(CASE WHEN category = '{CODE2}' THEN 1 ELSE 0 END) AS BIGINT) AS num_code2
  FROM ({td.SQL_DIAGNOSES}) d WHERE category IN ('{CODE1}', '{CODE2}') GROUP BY entity) s
WHERE (num_code1 > 0) <> (num_code2 > 0)"""

LABELS_SQL = f"""
SELECT entity, CASE WHEN num_code1 > 0 THEN '{CODE1}' WHEN num_code2 > 0 THEN '{CODE2}' END AS category
FROM ({EXCL_SQL}) c"""


def _cohort(spark, sf):
    return co.exclusive_cohort(td.diagnoses(spark, sf), "entity", "category", CODE1, CODE2)


@register("exclusive_cohort", EXCL_SQL)
def q_exclusive_cohort(spark, sf):
    return _cohort(spark, sf)


@register("cohort_labels", LABELS_SQL)
def q_cohort_labels(spark, sf):
    return co.cohort_labels(_cohort(spark, sf), "entity", CODE1, CODE2, out="category")


@register("code_category", f"SELECT entity, code, substring(code, 1, 3) AS category3 FROM ({td.SQL_DIAGNOSES}) d")
def q_code_category(spark, sf):
    from gapseries.functions.columns import code_category
    d = td.diagnoses(spark, sf)
    return d.select("entity", "code", code_category("code", 3).alias("category3"))


@register("binary_label", f"SELECT entity, CAST(category = '{CODE1}' AS INTEGER) AS label FROM ({LABELS_SQL}) l")
def q_binary_label(spark, sf):
    lab = q_cohort_labels(spark, sf)
    return lab.select("entity", binary_label("category", CODE1).alias("label"))


ORDER_PAIRS_SQL = f"SELECT entity, item FROM ({td.SQL_ORDER_EVENTS}) e GROUP BY entity, item HAVING count(*) >= 3"


@register("min_length_pairs", ORDER_PAIRS_SQL)
def q_min_length_pairs(spark, sf):
    return co.min_length_pairs(td.order_events(spark, sf), "entity", "item", 3)


@register("min_length_events", f"""
SELECT e.entity, e.item, e.event_id, e.value FROM ({td.SQL_ORDER_EVENTS}) e
JOIN ({ORDER_PAIRS_SQL}) p ON e.entity = p.entity AND e.item = p.item""")
def q_min_length_events(spark, sf):
    ev = co.min_length_events(td.order_events(spark, sf), "entity", "item", 3)
    return ev.select("entity", "item", "event_id", "value")


@register("select_item_events", f"""
SELECT e.entity, e.item, e.event_id, e.value, d.item_code FROM ({td.SQL_EVENTS}) e
JOIN ({td.SQL_EVENT_ITEMS}) d ON e.item = d.item WHERE d.item_code IN ('{ITEM_CODE}')""")
def q_select_item_events(spark, sf):
    ev = co.select_item_events(td.events(spark, sf), td.event_items(spark, sf), "item",
                               "item_code", ITEM_CODE)
    return ev.select("entity", "item", "event_id", "value", "item_code")


# ---------------------------------------------------------------- matrix ---

BRAND_PAIRS_SQL = f"SELECT entity, item FROM ({td.SQL_BRAND_EVENTS}) e GROUP BY entity, item HAVING count(*) >= 3"
SUPPORT_SQL = f"SELECT item, count(*) AS count FROM ({BRAND_PAIRS_SQL}) p GROUP BY item HAVING count(*) >= 30"
SUPPORTED_SQL = f"""SELECT entity, item FROM ({BRAND_PAIRS_SQL}) p
WHERE entity IS NOT NULL AND item IN (SELECT item FROM ({SUPPORT_SQL}) s)"""


def _top_sql(k: int) -> str:
    return f"""SELECT s.item, s.count, d.item_code FROM
(SELECT * FROM ({SUPPORT_SQL}) s0 ORDER BY count DESC, item LIMIT {k}) s
JOIN ({td.SQL_BRAND_ITEMS}) d ON s.item = d.item"""


def _cells_sql(k: int) -> str:
    return f"""SELECT d.category, t.item_code, count(*) AS n
FROM ({_top_sql(k)}) t JOIN ({SUPPORTED_SQL}) p ON t.item = p.item
JOIN ({td.SQL_DIAGNOSES}) d ON p.entity = d.entity
WHERE t.item_code IS NOT NULL GROUP BY d.category, t.item_code"""


def _brand_support(spark, sf):
    pairs = co.min_length_pairs(td.brand_events(spark, sf), "entity", "item", 3)
    return pairs, co.item_support(pairs, "item", 30)


@register("item_support", SUPPORT_SQL)
def q_item_support(spark, sf):
    return _brand_support(spark, sf)[1]


@register("supported_pairs", SUPPORTED_SQL)
def q_supported_pairs(spark, sf):
    pairs, support = _brand_support(spark, sf)
    return co.supported_pairs(pairs, support, "entity", "item")


@register("top_items", _top_sql(10))
def q_top_items(spark, sf):
    _, support = _brand_support(spark, sf)
    return mx.top_items(support, td.brand_items(spark, sf), "item", 10)


@register("cooccurrence_cells", _cells_sql(100))
def q_cooccurrence_cells(spark, sf):
    return code_item_matrix(td.brand_events(spark, sf), td.brand_items(spark, sf),
                            td.diagnoses(spark, sf), entity="entity", item="item",
                            item_code="item_code", category="category", wide=False)


# The item codes of the brand dimension.
BRAND_CODES = [str(n) for n in range(1, 26)]
_MATRIX_COLS = ", ".join(f"count(*) FILTER (WHERE item_code = '{c}') AS \"{c}\"" for c in BRAND_CODES)


@register("code_item_matrix", f"""
SELECT category, {_MATRIX_COLS}, count(*) AS sum FROM (
  SELECT d.category, t.item_code FROM ({_top_sql(100)}) t JOIN ({SUPPORTED_SQL}) p ON t.item = p.item
  JOIN ({td.SQL_DIAGNOSES}) d ON p.entity = d.entity WHERE t.item_code IS NOT NULL) x
GROUP BY category ORDER BY sum DESC, category LIMIT 125""")
def q_code_item_matrix(spark, sf):
    return code_item_matrix(td.brand_events(spark, sf), td.brand_items(spark, sf),
                            td.diagnoses(spark, sf), entity="entity", item="item",
                            item_code="item_code", category="category", codes=BRAND_CODES)


# ---------------------------------------------------------------- series ---

T_DAYS_SQL = "CAST(epoch_us(ts) // 1000 AS DOUBLE) / 86400000.0::DOUBLE"


def _warp_sql(src: str, part: str, a: float = 3.0, b: float = 0.0) -> str:
    """Relative time and warp over ``src`` (needs ts, value, event_id)."""
    w = f"PARTITION BY {part} ORDER BY t_days, event_id"
    return f"""
SELECT *, sum(inc) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t_warped FROM (
  SELECT *, CASE WHEN t_rel - lag(t_rel) OVER ({w}) IS NULL THEN 0.0::DOUBLE
            ELSE pow(t_rel - lag(t_rel) OVER ({w}), 1.0::DOUBLE / {a}::DOUBLE) + {b}::DOUBLE END AS inc
  FROM (SELECT *, t_days - first_value(t_days) OVER ({w}) AS t_rel FROM (
    SELECT *, {T_DAYS_SQL} AS t_days FROM ({src}) s0
    WHERE ts IS NOT NULL AND value IS NOT NULL) s1) s2) s3"""


def _event_points(spark, sf):
    return se.to_points(td.events(spark, sf), td.ROLES)


KEYS = ["entity", "item", "unit"]


@register("relative_time", f"""
SELECT entity, item, event_id, round(t_rel, {R}) AS t_rel FROM ({_warp_sql(td.SQL_EVENTS, 'entity, item, unit')}) w""")
def q_relative_time(spark, sf):
    pts = se.relative_time(_event_points(spark, sf), KEYS)
    return pts.select("entity", "item", "event_id", rnd("t_rel"))


@register("time_deltas", f"""
SELECT entity, item, event_id, round(t_rel - lag(t_rel) OVER (PARTITION BY entity, item, unit
  ORDER BY t_days, event_id), {R}) AS dt FROM ({_warp_sql(td.SQL_EVENTS, 'entity, item, unit')}) w""")
def q_time_deltas(spark, sf):
    pts = se.relative_time(_event_points(spark, sf), KEYS)
    pts = se.time_deltas(pts, KEYS, t="t_rel", tie="event_id")
    return pts.select("entity", "item", "event_id", rnd("dt"))


def _warped_events(spark, sf):
    return se.time_warp(_event_points(spark, sf), KEYS, tie="event_id")


WARPED_EVENTS_SQL = _warp_sql(td.SQL_EVENTS, "entity, item, unit")


@register("time_warp", f"""
SELECT entity, item, event_id, round(t_rel, {R}) AS t_rel, round(t_warped, {R}) AS t_warped
FROM ({WARPED_EVENTS_SQL}) w""")
def q_time_warp(spark, sf):
    return _warped_events(spark, sf).select("entity", "item", "event_id", rnd("t_rel"), rnd("t_warped"))


@register("time_warp_sparse", f"""
SELECT entity, item, event_id, round(t_rel, {R}) AS t_rel, round(t_warped, {R}) AS t_warped
FROM ({_warp_sql(td.SQL_ORDER_EVENTS, 'entity, item, unit', 2.0, 0.5)}) w""")
def q_time_warp_sparse(spark, sf):
    pts = se.to_points(td.order_events(spark, sf), td.ROLES)
    w = se.time_warp(pts, KEYS, tie="event_id", a=2.0, b=0.5)
    return w.select("entity", "item", "event_id", rnd("t_rel"), rnd("t_warped"))


@register("series_stats", f"""
SELECT entity, item, count(*) AS n, round(min(t_days), {R}) AS t_min, round(max(t_days), {R}) AS t_max,
  round(max(t_days) - min(t_days), {R}) AS span, round(avg(value), {R}) AS mean,
  round(stddev_pop(value) * sqrt(count(*)), {R}) AS l2_dev
FROM (SELECT *, {T_DAYS_SQL} AS t_days FROM ({td.SQL_EVENTS}) e WHERE ts IS NOT NULL AND value IS NOT NULL) p
GROUP BY entity, item""")
def q_series_stats(spark, sf):
    st = se.series_stats(_event_points(spark, sf), ["entity", "item"], "t_days", "value")
    return st.select("entity", "item", "n", *[rnd(c) for c in ("t_min", "t_max", "span", "mean", "l2_dev")])


@register("regular_grid", f"""
SELECT entity, item, CAST(i AS INTEGER) AS i, round(lo - 2.5 + i * 0.25, {R}) AS t_warped FROM (
  SELECT entity, item, lo, CAST(floor(round((hi - lo + 5.0) / 0.25, 9)) AS INTEGER) + 1 AS n FROM (
    SELECT entity, item, min(t_warped) AS lo, max(t_warped) AS hi FROM ({WARPED_EVENTS_SQL}) w
    GROUP BY entity, item) g) g2, unnest(generate_series(0, n - 1)) AS u(i)""")
def q_regular_grid(spark, sf):
    g = se.regular_grid(_warped_events(spark, sf), ["entity", "item"], step=0.25, padding_length=20)
    return g.select("entity", "item", "i", rnd("t_warped"))


@register("sample_series", f"""
SELECT e.entity, e.item, e.event_id, e.value FROM ({td.SQL_EVENTS}) e JOIN (
  SELECT entity, item FROM (SELECT DISTINCT entity, item, {hash_sql(['entity', 'item'], 7)} AS h
    FROM ({td.SQL_EVENTS}) e0) s ORDER BY h, entity, item LIMIT 20) k
ON e.entity = k.entity AND e.item = k.item""")
def q_sample_series(spark, sf):
    ev = td.events(spark, sf)
    return sa.sample_series(ev, ["entity", "item"], 20, seed=7).select("entity", "item", "event_id", "value")


@register("standardize", f"""
SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), {R}) + 0.0 AS value
FROM ({td.SQL_EVENTS}) e""")
def q_standardize(spark, sf):
    ev = td.events(spark, sf).select("event_id", "value")
    return standardize(ev, ["value"]).select("event_id", rnd("value"))


# ---------------------------------------------------------- cohort series ---

def _cohort_sql(codes: list[str], rounded: bool = True) -> str:
    code_list = ", ".join(f"'{c}'" for c in codes)
    src = f"""SELECT * FROM (
  SELECT e.*, c.category, count(*) OVER (PARTITION BY e.entity, e.item) AS pair_n
  FROM ({td.SQL_EVENTS}) e JOIN ({td.SQL_EVENT_ITEMS}) d ON e.item = d.item
  JOIN ({LABELS_SQL}) c ON e.entity = c.entity WHERE d.item_code IN ({code_list})) x WHERE pair_n >= 3"""
    rt, rw = ((f"round(t_rel, {R})", f"round(t_warped, {R})") if rounded else ("t_rel", "t_warped"))
    return f"""SELECT entity, item, unit, category, event_id, {rt} AS t_rel,
  {rw} AS t_warped, value,
  CASE WHEN {hash_sql(['entity', 'item', 'unit'], SEED)}::DOUBLE / 4294967296.0::DOUBLE < 0.7
       THEN 'train' ELSE 'test' END AS split
FROM ({_warp_sql(src, 'entity, item, unit, category')}) w"""


def _cohort_df(spark, sf, codes, balance=None):
    return build_cohort(td.events(spark, sf), td.event_items(spark, sf), td.diagnoses(spark, sf),
                        roles=td.ROLES, item_codes=codes, code1=CODE1, code2=CODE2,
                        balance=balance, seed=SEED)


def _cohort_out(df):
    return df.select("entity", "item", "unit", "category", "event_id", rnd("t_rel"),
                     rnd("t_warped"), "value", "split")


COHORT_SQL = _cohort_sql([ITEM_CODE])
COHORT_ALL_SQL = _cohort_sql(ALL_ITEM_CODES)


@register("cohort_series", COHORT_SQL)
def q_cohort_series(spark, sf):
    return _cohort_out(_cohort_df(spark, sf, ITEM_CODE))


@register("cohort_series_all_items", COHORT_ALL_SQL)
def q_cohort_series_all_items(spark, sf):
    return _cohort_out(_cohort_df(spark, sf, ALL_ITEM_CODES))


def _mixed_sql() -> str:
    src = f"""SELECT * FROM (
  SELECT e.entity, e.item, e.subject, coalesce(e.unit, '') AS unit, e.event_id, e.ts,
         CASE WHEN isnan(e.value) THEN NULL ELSE e.value END AS value, c.category,
         count(*) OVER (PARTITION BY e.entity, e.item) AS pair_n
  FROM ({td.SQL_MIXED_EVENTS}) e JOIN ({td.SQL_PRIORITY_ITEMS}) d ON e.item = d.item
  JOIN ({LABELS_SQL}) c ON e.entity = c.entity WHERE d.item_code IN ('2', 'U')) x WHERE pair_n >= 3"""
    key = "entity, item, subject, unit, category"
    return f"""SELECT {key}, event_id, round(t_rel, {R}) AS t_rel, round(t_warped, {R}) AS t_warped, value,
  CASE WHEN {hash_sql(['entity', 'item', 'unit'], SEED)}::DOUBLE / 4294967296.0::DOUBLE < 0.7
       THEN 'train' ELSE 'test' END AS split
FROM ({_warp_sql(src, key)}) w"""


@register("cohort_mixed_units", _mixed_sql())
def q_cohort_mixed_units(spark, sf):
    """Nulls and NaN in values, null units and subjects, several units and
    subjects per pair, an item with two dimension rows."""
    df = build_cohort(td.mixed_events(spark, sf), td.priority_items(spark, sf), td.diagnoses(spark, sf),
                      roles=td.MIXED_ROLES, item_codes=["2", "U"], code1=CODE1, code2=CODE2, seed=SEED)
    return df.select(*td.MIXED_ROLES.series_key, "event_id", rnd("t_rel"), rnd("t_warped"), "value", "split")


@register("balanced_cohort", f"""
WITH c AS ({COHORT_ALL_SQL}),
s AS (SELECT DISTINCT entity, item, unit, category,
        {hash_sql(['entity', 'item', 'unit', 'category'], SEED)} AS h FROM c),
m AS (SELECT min(n) AS m FROM (SELECT category, count(*) AS n FROM s GROUP BY category) q),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, entity, item, unit)
        AS rn FROM s) r WHERE rn <= (SELECT m FROM m))
SELECT c.* FROM c JOIN k ON c.entity = k.entity AND c.item = k.item AND c.unit = k.unit
  AND c.category = k.category""")
def q_balanced_cohort(spark, sf):
    return _cohort_out(_cohort_df(spark, sf, ALL_ITEM_CODES, balance="hash"))


@register("balanced_cohort_bernoulli", f"""
WITH c AS ({COHORT_ALL_SQL}),
s AS (SELECT DISTINCT entity, item, unit, category,
        {hash_sql(['entity', 'item', 'unit', 'category'], f'bernoulli:{SEED}')}::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM c),
n AS (SELECT category, count(*) AS n, min(count(*)) OVER () AS least FROM s GROUP BY category)
SELECT c.* FROM c JOIN s USING (entity, item, unit, category) JOIN n USING (category) WHERE u < least / n""")
def q_balanced_cohort_bernoulli(spark, sf):
    """Each series of the larger class kept with the probability that levels the classes."""
    return _cohort_out(_cohort_df(spark, sf, ALL_ITEM_CODES, balance="bernoulli"))


@register("class_counts", f"""
SELECT category, count(*) AS n_series FROM (SELECT DISTINCT entity, item, unit, category
FROM ({COHORT_ALL_SQL}) c) s GROUP BY category""")
def q_class_counts(spark, sf):
    return sa.class_counts(_cohort_df(spark, sf, ALL_ITEM_CODES), td.ROLES.series_key, "category")


@register("label_histogram", f"""
SELECT category, count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_points FROM (
  SELECT entity, item, unit, category, count(*) AS n FROM ({COHORT_ALL_SQL}) c
  WHERE split = 'train' GROUP BY entity, item, unit, category) s GROUP BY category""")
def q_label_histogram(spark, sf):
    df = _cohort_df(spark, sf, ALL_ITEM_CODES).where(F.col("split") == "train")
    return me.label_histogram(df, td.ROLES.series_key, "category")


@register("distinct_labels", f"SELECT DISTINCT category FROM ({COHORT_ALL_SQL}) c")
def q_distinct_labels(spark, sf):
    return me.distinct_labels(_cohort_df(spark, sf, ALL_ITEM_CODES), "category")


# ------------------------------------------------------- Gaussian process ---
# The optimum recorded for the original 428 vs 571 cohort,
# used as the fixed hyperparameters of the GP queries.
GP_SIGMA2, GP_ALPHA, GP_TAU = 0.05, 3.5, 1.25
GP_STEP, GP_PADDING = 0.25, 20.0
GP_KEYS = ["entity", "item", "unit", "category", "split"]
_Y = 1000000          # index of the y row/column in the bordered matrix
_G = 2000000          # first index of the grid rows/columns


def _gp_points_sql() -> str:
    """Standardised points with 1-based index per series and series id."""
    return f"""
pts AS (SELECT entity, item, unit, category, split, t_warped AS tw, value AS v,
          row_number() OVER (PARTITION BY entity, item, unit, category, split
                             ORDER BY t_rel, event_id) AS i,
          dense_rank() OVER (ORDER BY entity, item, unit, category, split) AS s
        FROM ({COHORT_ALL_RAW_SQL}) c),
st AS (SELECT s, count(*) AS n, avg(v) AS mu FROM pts GROUP BY s),
sd AS (SELECT p.s, CASE WHEN sqrt(sum((p.v - st.mu) * (p.v - st.mu))) > 1e-8
                        THEN sqrt(sum((p.v - st.mu) * (p.v - st.mu))) ELSE 1.0 END AS scale
       FROM pts p JOIN st ON p.s = st.s GROUP BY p.s),
y AS (SELECT p.*, (p.v - st.mu) / sd.scale AS yv FROM pts p JOIN st ON p.s = st.s JOIN sd ON p.s = sd.s)"""


def _rq_sql(a: str, b: str) -> str:
    return (f"{GP_SIGMA2}::DOUBLE * pow(1.0::DOUBLE + ({a} - {b}) * ({a} - {b}) / "
            f"(2.0::DOUBLE * {GP_ALPHA}::DOUBLE * {GP_TAU}::DOUBLE * {GP_TAU}::DOUBLE), "
            f"-{GP_ALPHA}::DOUBLE)")


_ELIM_SQL = """
elim(k, s, i, j, x) AS (
  SELECT 0, s, i, j, x FROM cells
  UNION ALL
  SELECT e.k + 1, e.s, e.i, e.j, e.x - a.x * b.x / p.x
  FROM elim e
  JOIN elim p ON p.s = e.s AND p.i = e.k + 1 AND p.j = e.k + 1
  JOIN elim a ON a.s = e.s AND a.i = e.i AND a.j = e.k + 1
  JOIN elim b ON b.s = e.s AND b.i = e.k + 1 AND b.j = e.j
  WHERE e.i > e.k + 1 AND e.j > e.k + 1)"""

def _se_sql(a: str, b: str) -> str:
    return (f"{GP_SIGMA2}::DOUBLE * exp(-({a} - {b}) * ({a} - {b}) / "
            f"(2.0::DOUBLE * {GP_TAU}::DOUBLE * {GP_TAU}::DOUBLE))")


def _k_cells(kernel=_rq_sql) -> str:
    return f"""
  SELECT a.s, a.i, b.i AS j, {kernel('a.tw', 'b.tw')}
         + CASE WHEN a.i = b.i THEN {GP_SIGMA2}::DOUBLE ELSE 0.0::DOUBLE END AS x
  FROM y a JOIN y b ON a.s = b.s
  UNION ALL SELECT s, i, {_Y}, yv FROM y
  UNION ALL SELECT s, {_Y}, i, yv FROM y
  UNION ALL SELECT s, {_Y}, {_Y}, 0.0::DOUBLE FROM st"""


COHORT_ALL_RAW_SQL = _cohort_sql(ALL_ITEM_CODES, rounded=False)


def _gp_ll_sql(kernel=_rq_sql) -> str:
    return f"""
WITH RECURSIVE {_gp_points_sql().strip()},
cells AS ({_k_cells(kernel)}),
{_ELIM_SQL.strip()},
piv AS (SELECT s, sum(ln(x)) AS logdet FROM elim WHERE i = k + 1 AND j = k + 1 GROUP BY s),
fin AS (SELECT s, arg_max(x, k) AS schur FROM elim WHERE i = {_Y} AND j = {_Y} GROUP BY s),
keys AS (SELECT DISTINCT s, entity, item, unit, category, split FROM pts)
SELECT keys.entity, keys.item, keys.unit, keys.category, keys.split, CAST(st.n AS INTEGER) AS n,
  round(st.mu, {R}) AS mean, round(sd.scale, {R}) AS l2_dev,
  round(fin.schur / 2.0 - piv.logdet / 2.0 - st.n * ln(2.0 * pi()) / 2.0, {R}) AS log_likelihood
FROM keys JOIN st ON keys.s = st.s JOIN sd ON keys.s = sd.s JOIN piv ON keys.s = piv.s
JOIN fin ON keys.s = fin.s"""


GP_LL_SQL = _gp_ll_sql()

_PAD = GP_PADDING * GP_STEP / 2.0
def _gp_resample_sql(rounded: bool = True) -> str:
    rd = (lambda e: f"round({e}, {R})") if rounded else (lambda e: e)
    return f"""
WITH RECURSIVE {_gp_points_sql().strip()},
ext AS (SELECT s, min(tw) AS lo,
          CAST(floor(round((max(tw) - min(tw) + {2 * _PAD}::DOUBLE) / {GP_STEP}::DOUBLE, 9)) AS INTEGER) + 1 AS m
        FROM y GROUP BY s),
grid AS (SELECT s, gi, lo - {_PAD}::DOUBLE + gi * {GP_STEP}::DOUBLE AS xg
         FROM ext, unnest(generate_series(0, m - 1)) AS u(gi)),
cells AS ({_k_cells()}
  UNION ALL SELECT y.s, y.i, {_G} + g.gi, {_rq_sql('y.tw', 'g.xg')} FROM y JOIN grid g ON y.s = g.s
  UNION ALL SELECT y.s, {_G} + g.gi, y.i, {_rq_sql('y.tw', 'g.xg')} FROM y JOIN grid g ON y.s = g.s
  UNION ALL SELECT s, {_G} + gi, {_Y}, 0.0::DOUBLE FROM grid
  UNION ALL SELECT s, {_G} + gi, {_G} + gi, {GP_SIGMA2}::DOUBLE FROM grid),
{_ELIM_SQL.strip()},
fm AS (SELECT s, i - {_G} AS gi, arg_max(x, k) AS x FROM elim
       WHERE i >= {_G} AND j = {_Y} GROUP BY s, i),
fv AS (SELECT s, i - {_G} AS gi, arg_max(x, k) AS x FROM elim
       WHERE i >= {_G} AND j = i GROUP BY s, i),
keys AS (SELECT DISTINCT s, entity, item, unit, category, split FROM pts)
SELECT keys.entity, keys.item, keys.unit, keys.category, keys.split, CAST(g.gi AS INTEGER) AS i,
  {rd('g.xg')} AS t_warped, {rd('-fm.x * sd.scale + st.mu')} AS mean,
  {rd('fv.x * sd.scale * sd.scale')} AS variance
FROM grid g JOIN keys ON g.s = keys.s JOIN st ON g.s = st.s JOIN sd ON g.s = sd.s
JOIN fm ON g.s = fm.s AND g.gi = fm.gi JOIN fv ON g.s = fv.s AND g.gi = fv.gi"""


GP_RESAMPLE_SQL = _gp_resample_sql(True)
GP_RESAMPLE_RAW_SQL = _gp_resample_sql(False)


def _gp_arrays(spark, sf):
    coh = _cohort_df(spark, sf, ALL_ITEM_CODES)
    return se.build_series(coh, GP_KEYS, "value", tie="event_id")


@register("gp_log_likelihood", GP_LL_SQL)
def q_gp_log_likelihood(spark, sf):
    from gapseries.operators import gp
    ll = gp.gp_log_likelihood(_gp_arrays(spark, sf), GP_KEYS, GP_SIGMA2, GP_ALPHA, GP_TAU)
    return ll.select(*GP_KEYS, "n", rnd("mean"), rnd("l2_dev"), rnd("log_likelihood"))


@register("gp_log_likelihood_se", _gp_ll_sql(_se_sql))
def q_gp_log_likelihood_se(spark, sf):
    """The same with the squared-exponential kernel."""
    from gapseries.operators import gp
    ll = gp.gp_log_likelihood(_gp_arrays(spark, sf), GP_KEYS, GP_SIGMA2, GP_ALPHA, GP_TAU, kernel="se")
    return ll.select(*GP_KEYS, "n", rnd("mean"), rnd("l2_dev"), rnd("log_likelihood"))


@register("gp_resample", GP_RESAMPLE_SQL)
def q_gp_resample(spark, sf):
    from gapseries.plans.gp import resample_cohort
    coh = _cohort_df(spark, sf, ALL_ITEM_CODES)
    res = resample_cohort(coh, td.ROLES, GP_SIGMA2, GP_ALPHA, GP_TAU, step=GP_STEP,
                          padding_length=GP_PADDING)
    return res.select(*GP_KEYS, "i", rnd("t_warped"), rnd("mean"), rnd("variance"))


# ----------------------------------------------------- patches & features ---
@register("gp_log_likelihood_tiled", GP_LL_SQL)
def q_gp_log_likelihood_tiled(spark, sf):
    """The likelihoods by the tiled factorisation; small tiles, so that every series has several."""
    from gapseries.operators.gp_tiles import tiled_log_likelihood
    out = tiled_log_likelihood(_gp_arrays(spark, sf), GP_KEYS, GP_SIGMA2, GP_ALPHA, GP_TAU, tile=GP_TILE)
    return out.select(*GP_KEYS, "n", rnd("mean"), rnd("l2_dev"), rnd("log_likelihood"))


@register("gp_resample_tiled", GP_RESAMPLE_SQL)
def q_gp_resample_tiled(spark, sf):
    """Every series resampled by the tiled factorisation."""
    from gapseries.operators.gp import flatten_resampled
    from gapseries.operators.gp_tiles import tiled_resample_arrays
    arrays = tiled_resample_arrays(_gp_arrays(spark, sf), GP_KEYS, GP_SIGMA2, GP_ALPHA, GP_TAU,
                                   GP_STEP, GP_PADDING, tile=GP_TILE)
    return flatten_resampled(arrays, GP_KEYS, GP_STEP).select(
        *GP_KEYS, "i", rnd("t_warped"), rnd("mean"), rnd("variance"))


GP_TILE = 8
PATCH_LEN = 20
_PKEYS = ", ".join(GP_KEYS)


def _gp_pred_arrays(spark, sf, cohort=None):
    from gapseries.plans.gp import resample_cohort_arrays
    coh = _cohort_df(spark, sf, ALL_ITEM_CODES) if cohort is None else cohort
    return resample_cohort_arrays(coh, td.ROLES, GP_SIGMA2, GP_ALPHA, GP_TAU, step=GP_STEP,
                                  padding_length=GP_PADDING)


def _gp_pred(spark, sf):
    from gapseries.operators.gp import flatten_resampled
    return flatten_resampled(_gp_pred_arrays(spark, sf), GP_KEYS, GP_STEP)


def _patch_cols_sql(n: int) -> str:
    return ", ".join([f"a[{k + 1}] AS f{k}" for k in range(n)]
                     + [f"b[{k + 1}] AS f{n + k}" for k in range(n)])


def _patches_sql(gp_sql: str) -> str:
    return f"""
SELECT {_PKEYS}, start, {_patch_cols_sql(PATCH_LEN)} FROM (
  SELECT {_PKEYS}, CAST(i AS INTEGER) AS start,
    list(mean) OVER w AS a, list(variance) OVER w AS b,
    count(*) OVER (PARTITION BY {_PKEYS}) AS m
  FROM ({gp_sql}) g
  WINDOW w AS (PARTITION BY {_PKEYS} ORDER BY i ROWS BETWEEN CURRENT ROW AND {PATCH_LEN - 1} FOLLOWING)
) x WHERE start <= m - {PATCH_LEN} - 1"""


PATCHES_SQL = _patches_sql(GP_RESAMPLE_SQL)


def _patches(spark, sf):
    from gapseries.operators.patches import extract_patches
    return extract_patches(_gp_pred_arrays(spark, sf), GP_KEYS, PATCH_LEN)


@register("extract_patches", PATCHES_SQL)
def q_extract_patches(spark, sf):
    from gapseries.operators.patches import feature_columns
    wide = feature_columns(_patches(spark, sf), PATCH_LEN)
    return wide.select(*GP_KEYS, "start", *[rnd(f"f{k}") for k in range(2 * PATCH_LEN)])


SAMPLED_SQL = f"""
SELECT {_PKEYS}, start FROM (
  SELECT {_PKEYS}, start, row_number() OVER (ORDER BY
    {hash_sql(GP_KEYS + ['start'], 'sample:0')}, {_PKEYS}, start) AS rn
  FROM ({PATCHES_SQL}) p) r
WHERE rn <= 3 * (SELECT count(*) FROM (SELECT DISTINCT {_PKEYS} FROM ({PATCHES_SQL}) p2) s)"""


def _chosen(spark, sf, cohort):
    """The sampled (series, start) rows, from the series' extents alone."""
    from gapseries.operators.patches import choose_patches, patch_count
    from gapseries.session import cut_lineage
    # read by the quota jobs and the result: one row per series, written once
    counts = cut_lineage(patch_count(cohort, GP_KEYS, PATCH_LEN, step=GP_STEP, padding_length=GP_PADDING))
    return choose_patches(counts, GP_KEYS, 3, 0)


def _sampled(spark, sf):
    from gapseries.operators.patches import cut_patches
    from gapseries.session import cut_lineage
    # read for the series' extents and by the GP: built once
    coh = cut_lineage(_cohort_df(spark, sf, ALL_ITEM_CODES))
    return cut_patches(_gp_pred_arrays(spark, sf, coh), _chosen(spark, sf, coh), GP_KEYS, PATCH_LEN)


@register("sample_patches", SAMPLED_SQL)
def q_sample_patches(spark, sf):
    return _chosen(spark, sf, _cohort_df(spark, sf, ALL_ITEM_CODES)).select(*GP_KEYS, "start")


DRAWN_SQL = f"""
WITH n AS (SELECT {_PKEYS}, n_patches,
             sum(n_patches) OVER (ORDER BY {', '.join(f'{k} NULLS FIRST' for k in GP_KEYS)}) - n_patches AS below
           FROM (SELECT {_PKEYS}, count(*) - {PATCH_LEN} AS n_patches FROM ({GP_RESAMPLE_RAW_SQL}) g
                 GROUP BY {_PKEYS}) c WHERE n_patches > 0),
t AS (SELECT sum(n_patches)::BIGINT AS line, 3 * count(*) AS draws FROM n),
d AS (SELECT draw, ('0x' || substr(md5('draw:0|' || draw), 1, 15))::BIGINT % line AS x
      FROM (SELECT line, unnest(range(draws)) AS draw FROM t) r)
SELECT {_PKEYS}, CAST(x - below AS INTEGER) AS start, draw
FROM d JOIN n ON x >= below AND x < below + n_patches"""


def _counts(spark, sf):
    from gapseries.operators.patches import patch_count
    from gapseries.session import cut_lineage
    coh = _cohort_df(spark, sf, ALL_ITEM_CODES)
    return cut_lineage(patch_count(coh, GP_KEYS, PATCH_LEN, step=GP_STEP, padding_length=GP_PADDING))


@register("sample_patches_replacement", DRAWN_SQL)
def q_sample_patches_replacement(spark, sf):
    """Exactly three draws for each series, with replacement, every patch equally likely."""
    from gapseries.operators.patches import draw_patches
    return draw_patches(_counts(spark, sf), GP_KEYS, 3, 0)


@register("cut_drawn_patches", f"""
SELECT {_PKEYS}, start, count(*) AS times, {', '.join(f'any_value(f{k}) AS f{k}' for k in range(2 * PATCH_LEN))}
FROM ({DRAWN_SQL}) d JOIN ({PATCHES_SQL}) p USING ({_PKEYS}, start) GROUP BY {_PKEYS}, start""")
def q_cut_drawn_patches(spark, sf):
    """The drawn patches with their features, and how often each was drawn."""
    from gapseries.operators.patches import cut_patches, draw_patches, feature_columns
    drawn = draw_patches(_counts(spark, sf), GP_KEYS, 3, 0)
    wide = feature_columns(cut_patches(_gp_pred_arrays(spark, sf), drawn, GP_KEYS, PATCH_LEN), PATCH_LEN)
    fs = [f"f{k}" for k in range(2 * PATCH_LEN)]
    return wide.groupBy(*GP_KEYS, "start").agg(
        F.count(F.lit(1)).alias("times"), *[F.round(F.first(f), R).alias(f) for f in fs])


@register("validation_split", f"""
SELECT {_PKEYS}, start, CASE WHEN {hash_sql(GP_KEYS + ['start'], 'validation:0')}::DOUBLE
  / 4294967296.0::DOUBLE < 0.2 THEN 'validation' ELSE 'train' END AS fit_split
FROM ({SAMPLED_SQL}) s WHERE split = 'train'""")
def q_validation_split(spark, sf):
    from gapseries.operators.patches import validation_split
    s = _chosen(spark, sf, _cohort_df(spark, sf, ALL_ITEM_CODES)).where(F.col("split") == "train")
    return validation_split(s, GP_KEYS, 0.2, 0).select(*GP_KEYS, "start", "fit_split")


@register("csv_predictions", GP_RESAMPLE_SQL)
def q_csv_predictions(spark, sf):
    """The predictions written as CSV part files by split, and read back."""
    from gapseries.session import scratch_path
    from gapseries.sources.io import save_table
    pred = _gp_pred(spark, sf)
    path = scratch_path(spark, "predictions-csv")
    save_table(pred, path, "csv", partition_by=["split"])
    back = spark.read.option("header", True).option("emptyValue", "").schema(pred.schema).csv(path)
    return back.select(*[F.coalesce(k, F.lit("")).alias(k) if k == "unit" else k for k in GP_KEYS],
                       "i", rnd("t_warped"), rnd("mean"), rnd("variance"))


@register("uncertainty_band", f"""
SELECT {_PKEYS}, CAST(i AS INTEGER) AS i, round(mean - sqrt(greatest(variance, 0.0)), {R}) + 0.0 AS lower,
  round(mean + sqrt(greatest(variance, 0.0)), {R}) AS upper
FROM ({GP_RESAMPLE_RAW_SQL}) g""")
def q_uncertainty_band(spark, sf):
    from gapseries.functions.columns import uncertainty_band
    pred = _gp_pred(spark, sf)
    lo, hi = uncertainty_band("mean", "variance")
    return pred.select(*GP_KEYS, "i", F.round(lo, R).alias("lower"), F.round(hi, R).alias("upper"))


@register("standardized_predictions", f"""
WITH g AS ({GP_RESAMPLE_RAW_SQL}),
m AS (SELECT avg(mean) AS mm, stddev_samp(mean) AS sm, avg(variance) AS mv,
             stddev_samp(variance) AS sv FROM g WHERE split = 'train')
SELECT {_PKEYS}, CAST(i AS INTEGER) AS i, round((mean - mm) / sm, 4) + 0.0 AS mean,
  round((variance - mv) / sv, 4) + 0.0 AS variance FROM g, m""")
def q_standardized_predictions(spark, sf):
    from gapseries.plans.features import standardize_predictions
    from gapseries.session import cut_lineage
    # read for the moments and again for the rows
    std = standardize_predictions(cut_lineage(_gp_pred(spark, sf)))
    return std.select(*GP_KEYS, "i", rnd("mean", 4), rnd("variance", 4))


@register("series_overlay", f"""
WITH g AS ({GP_RESAMPLE_RAW_SQL}), c AS ({COHORT_ALL_SQL})
SELECT entity, item, unit, category, split, 'raw' AS kind, t_rel AS t, round(value, {R}) AS y FROM c
UNION ALL SELECT entity, item, unit, category, split, 'warped', t_warped, round(value, {R}) FROM c
UNION ALL SELECT {_PKEYS}, 'mean', round(t_warped, {R}) + 0.0, round(mean, {R}) + 0.0 FROM g
UNION ALL SELECT {_PKEYS}, 'lower', round(t_warped, {R}) + 0.0,
  round(mean - sqrt(greatest(variance, 0.0)), {R}) + 0.0 FROM g
UNION ALL SELECT {_PKEYS}, 'upper', round(t_warped, {R}) + 0.0,
  round(mean + sqrt(greatest(variance, 0.0)), {R}) FROM g""")
def q_series_overlay(spark, sf):
    from gapseries.operators.overlay import series_overlay
    from gapseries.plans.gp import cohort_series_arrays
    from gapseries.session import cut_lineage
    # the nested series feed the GP and stand beside its result
    nested = cut_lineage(cohort_series_arrays(_cohort_df(spark, sf, ALL_ITEM_CODES), td.ROLES,
                                              extra_keys=("split",)))
    from gapseries.operators.gp import gp_resample_arrays
    pred = gp_resample_arrays(nested, GP_KEYS, GP_SIGMA2, GP_ALPHA, GP_TAU, GP_STEP, GP_PADDING)
    ov = series_overlay(nested, pred, GP_KEYS, GP_STEP)
    return ov.select(*GP_KEYS, "kind", rnd("t"), rnd("y"))


@register("overlay_missing", f"""
WITH c AS (SELECT DISTINCT {_PKEYS} FROM ({COHORT_ALL_SQL}) x),
n AS (SELECT *, (SELECT count(*) FROM ({COHORT_ALL_SQL}) y WHERE y.entity = c.entity AND y.item = c.item) AS n FROM c),
l AS (SELECT * FROM n WHERE n >= 8), r AS (SELECT * FROM n WHERE split = 'train')
SELECT {_PKEYS}, 'resampled' AS missing_from FROM l WHERE split <> 'train'
UNION ALL SELECT {_PKEYS}, 'series' FROM r WHERE n < 8""")
def q_overlay_missing(spark, sf):
    """Series of eight points or more beside the resampled training series: who lacks what."""
    from gapseries.operators.overlay import overlay_missing
    from gapseries.plans.gp import cohort_series_arrays
    from gapseries.session import cut_lineage
    nested = cut_lineage(cohort_series_arrays(_cohort_df(spark, sf, ALL_ITEM_CODES), td.ROLES,
                                              extra_keys=("split",)))
    from gapseries.operators.gp import gp_resample_arrays
    pred = gp_resample_arrays(nested.where("split = 'train'"), GP_KEYS, GP_SIGMA2, GP_ALPHA, GP_TAU,
                              GP_STEP, GP_PADDING)
    return overlay_missing(nested.where(F.size("v") >= 8), pred, GP_KEYS)


@register("series_order", f"""
SELECT {_PKEYS}, row_number() OVER (ORDER BY {', '.join(f'{k} NULLS FIRST' for k in GP_KEYS)}) AS position
FROM (SELECT DISTINCT {_PKEYS} FROM ({COHORT_ALL_SQL}) c) k""")
def q_series_order(spark, sf):
    """The place of every cohort series in the order of its key."""
    from gapseries.operators.ordering import order_series
    return order_series(_cohort_df(spark, sf, ALL_ITEM_CODES), GP_KEYS)


@register("gp_grid_search")  # twin below: the full grid
def q_gp_grid_search(spark, sf):
    from gapseries.operators import gp
    from gapseries.plans.gp import cohort_series_arrays
    train = _cohort_df(spark, sf, ITEM_CODE).where(F.col("split") == "train")
    lls = gp.gp_grid_search(cohort_series_arrays(train, td.ROLES))
    return lls.select("sigma2", "alpha", "tau", rnd("log_likelihood", 4), "n_series", "n_points")


@register("gp_hyperparameters")  # twin below
def q_gp_hyperparameters(spark, sf):
    from gapseries.plans.gp import optimize_hyperparameters
    train = _cohort_df(spark, sf, ITEM_CODE).where(F.col("split") == "train")
    best = optimize_hyperparameters(train, td.ROLES, item_code=ITEM_CODE)
    return best.select("sigma2", "alpha", "tau", rnd("log_likelihood", 4), "item_code", "at_grid_edge")


@register("phenotype_features")
def q_phenotype_features(spark, sf):
    from gapseries.plans.features import phenotype_features
    keys = ["entity", "item", "unit", "category"]
    return phenotype_features(_gp_pred_arrays(spark, sf), keys, "category", CODE1)[0]


@register("series_round_trip", COHORT_SQL)
def q_series_round_trip(spark, sf):
    """Cohort series saved partitioned by split and loaded again."""
    from gapseries.session import scratch_path
    from gapseries.sources.io import load_series, save_series
    path = scratch_path(spark, "series")
    save_series(_cohort_df(spark, sf, ITEM_CODE), path, partition_by=["split"])
    return _cohort_out(load_series(spark, path))


@register("csv_series", COHORT_SQL)
def q_csv_series(spark, sf):
    """Cohort series as CSV part files by split, read back."""
    from gapseries.session import scratch_path
    from gapseries.sources.io import save_table
    df = _cohort_df(spark, sf, ITEM_CODE)
    path = scratch_path(spark, "series-csv")
    save_table(df, path, "csv", partition_by=["split"])
    back = spark.read.option("header", True).schema(df.schema).csv(path)
    return _cohort_out(back.withColumn("unit", F.coalesce("unit", F.lit(""))))


@register("flatten_series", f"""
SELECT entity, item, unit, category, t_rel, t_warped, value FROM ({COHORT_ALL_SQL}) c""")
def q_flatten_series(spark, sf):
    keys = td.ROLES.series_key
    coh = _cohort_df(spark, sf, ALL_ITEM_CODES)
    nested = se.build_series(coh, keys, "value", tie="event_id")
    flat = se.flatten_series(nested, keys, value="value")
    return flat.select(*keys, rnd("t_rel"), rnd("t_warped"), "value")


@register("flatten_series_chunks", f"""
SELECT entity, item, unit, category, t_rel, t_warped, value FROM ({COHORT_ALL_SQL}) c""")
def q_flatten_series_chunks(spark, sf):
    """Every cohort series in chunks of five points and back to rows."""
    keys = td.ROLES.series_key
    columns = ["t_rel", "t_warped", "value"]
    placed = se.series_positions(_cohort_df(spark, sf, ALL_ITEM_CODES), keys, tie="event_id")
    flat = se.flatten_chunks(se.chunk_series(placed, keys, columns, 5, 2), keys, columns, 5)
    return flat.select(*keys, rnd("t_rel"), rnd("t_warped"), "value")


@register("series_chunks", f"""
SELECT entity, item, unit, category, p // 6 AS chunk, p // 6 * 6 AS at, least(m - p // 6 * 6, 8) AS n_points,
  min(t_rel) AS t_first, max(t_rel) AS t_last
FROM (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY entity, item, unit, category) AS m
  FROM ({COHORT_ALL_SQL}) c WINDOW w AS (PARTITION BY entity, item, unit, category ORDER BY t_rel, event_id)) x
GROUP BY ALL""")
def q_series_chunks(spark, sf):
    """Every cohort series in chunks of six points and the next two: extent of each chunk's own points."""
    keys = td.ROLES.series_key
    placed = se.series_positions(_cohort_df(spark, sf, ALL_ITEM_CODES), keys, tie="event_id")
    chunks = se.chunk_series(placed, keys, ["t_rel"], 6, 2)
    own = F.slice("t_rel", 1, 6)
    return chunks.select(*keys, "chunk", "at", F.size("t_rel").cast("long").alias("n_points"),
                         F.round(F.array_min(own), R).alias("t_first"), F.round(F.array_max(own), R).alias("t_last"))


@register("extract_patches_chunks", PATCHES_SQL)
def q_extract_patches_chunks(spark, sf):
    """The patches of every resampled series, cut from chunks of five grid points and a patch length."""
    from gapseries.operators.patches import extract_chunk_patches, feature_columns
    chunks = se.chunk_series(_gp_pred(spark, sf), GP_KEYS, ["mean", "variance"], 5, PATCH_LEN, pos="i")
    wide = feature_columns(extract_chunk_patches(chunks, GP_KEYS, PATCH_LEN, 5), PATCH_LEN)
    return wide.select(*GP_KEYS, "start", *[rnd(f"f{k}") for k in range(2 * PATCH_LEN)])


@register("patch_counts", f"""
SELECT {_PKEYS}, CAST(greatest(count(*) - {PATCH_LEN}, 0) AS INTEGER) AS n_patches,
  CAST(greatest(count(*) - {PATCH_LEN} + 1, 0) AS INTEGER) AS n_patches_with_last
FROM ({GP_RESAMPLE_RAW_SQL}) g GROUP BY {_PKEYS}""")
def q_patch_counts(spark, sf):
    from gapseries.operators.patches import patch_count
    coh = _cohort_df(spark, sf, ALL_ITEM_CODES)
    m = patch_count(coh, GP_KEYS, PATCH_LEN, step=GP_STEP, padding_length=GP_PADDING, include_last=True)
    return m.select(*GP_KEYS, F.greatest(F.col("n_patches") - 1, F.lit(0)).alias("n_patches"),
                    F.col("n_patches").alias("n_patches_with_last"))


@register("csv_landing", f"""
SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms FROM events""")
def q_csv_landing(spark, sf):
    """Events written as CSV part files and landed back through the validating
    reader (declared schema, malformed rows decided on all columns)."""
    from pyspark.sql import types as T

    from gapseries.session import scratch_path
    from gapseries.sources.io import read_table_csv, save_table
    schema = T.StructType([T.StructField("event_id", T.LongType()),
                           T.StructField("ts", T.TimestampNTZType()),
                           T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType()),
                           T.StructField("props", T.StringType())])
    path = scratch_path(spark, "events-csv")
    save_table(td.table(spark, sf, "events").select(*schema.fieldNames()), path, "csv")
    back = read_table_csv(spark, path, schema)
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return back.select("event_id", "user_id", "event_type", "value", ms.alias("ts_ms"))


@register("clinical_tables", """
SELECT 'LABEVENTS' AS name, event_id AS row_id, user_id AS subject, event_type || ':' || length(event_type) || ':'
  || CASE WHEN length(event_type) % 2 = 0 THEN 'mg, dL' ELSE '-' END AS said, value AS num, epoch_us(ts) // 1000 AS ms
FROM events
UNION ALL SELECT 'D_LABITEMS', min(event_id), -1, event_type || ':' || upper(event_type), -1, -1
FROM events GROUP BY event_type
UNION ALL SELECT 'PATIENTS', c_custkey, c_custkey, substring(c_mktsegment, 1, 1) || ':0', -1, -1 FROM customer
UNION ALL SELECT 'DIAGNOSES_ICD', o_orderkey, o_custkey, (o_orderkey % 7) || ':' || o_orderstatus
  || substring(o_orderpriority, 1, 1), -1, -1 FROM orders
UNION ALL SELECT 'D_ICD_DIAGNOSES', n_nationkey, -1, n_regionkey || ':' || n_name || ':-', -1, -1 FROM nation""")
def q_clinical_tables(spark, sf):
    """The five declared tables written as gzipped CSV parts and loaded with their schemas."""
    from gapseries.schemas import TABLES
    from gapseries.session import scratch_path
    from gapseries.sources.io import load_tables, save_table
    folder = scratch_path(spark, "clinical")
    for name, df in td.clinical(spark, sf).items():
        save_table(df, f"{folder}/{name}.csv.gz", "csv", compression="gzip")
    t = load_tables(spark, folder, TABLES)
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(CHARTTIME AS timestamp_ntz))")
    none = {"subject": F.lit(-1), "num": F.lit(-1), "ms": F.lit(-1)}
    said = {
        "LABEVENTS": (F.concat_ws(":", "VALUE", "ITEMID", F.coalesce("VALUEUOM", F.lit("-"))),
                      {"subject": F.col("SUBJECT_ID"), "num": F.col("VALUENUM"), "ms": ms}),
        "D_LABITEMS": (F.concat_ws(":", "LABEL", "LOINC_CODE"), {}),
        "PATIENTS": (F.concat_ws(":", "GENDER", "EXPIRE_FLAG"), {"subject": F.col("SUBJECT_ID")}),
        "DIAGNOSES_ICD": (F.concat_ws(":", "SEQ_NUM", "ICD9_CODE"), {"subject": F.col("HADM_ID")}),
        "D_ICD_DIAGNOSES": (F.concat_ws(":", "ICD9_CODE", "SHORT_TITLE", F.coalesce("LONG_TITLE", F.lit("-"))), {})}
    parts = [t[name].select(F.lit(name).alias("name"), F.col("ROW_ID").cast("long").alias("row_id"), text.alias("said"),
                            *[c.cast(kind).alias(n) for (n, c), kind in zip((none | own).items(), ("long", "double", "long"))])
             for name, (text, own) in said.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scaler_sql() -> str:
    n = 2 * PATCH_LEN
    fs = [f"f{k}" for k in range(n)]
    moments = ", ".join(f"avg({f}) AS m{k}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) "
                        f"ELSE 1.0 END AS s{k}" for k, f in enumerate(fs))
    # "+ 0.0" turns a rounded negative zero into 0.0
    scaled = ", ".join(f"round((p.{f} - m.m{k}) / m.s{k}, 4) + 0.0 AS {f}" for k, f in enumerate(fs))
    keys = ", ".join(f"p.{k}" for k in GP_KEYS)
    return f"""
WITH p AS (SELECT q.* FROM ({_patches_sql(GP_RESAMPLE_RAW_SQL)}) q
           JOIN ({SAMPLED_SQL}) s USING ({_PKEYS}, start)),
m AS (SELECT {moments} FROM p WHERE split = 'train')
SELECT {keys}, p.start, {scaled} FROM p, m WHERE p.split = 'test'"""


@register("feature_scaler", _scaler_sql())
def q_feature_scaler(spark, sf):
    """Scaler fitted on the sampled training patches, applied to the test ones."""
    from gapseries.operators.classifier import apply_scaler, fit_scaler
    from gapseries.operators.patches import feature_columns
    from gapseries.session import cut_lineage
    # read for the moments and again for the rows: the GP runs once
    s = cut_lineage(_sampled(spark, sf))
    scaler = fit_scaler(s.where(F.col("split") == "train"), "features")
    test = apply_scaler(s.where(F.col("split") == "test"), scaler, "features")
    wide = feature_columns(test, PATCH_LEN)
    return wide.select(*GP_KEYS, "start", *[rnd(f"f{k}", 4) for k in range(2 * PATCH_LEN)])


# Coarse grid for an SQL-checked search: sigma2 {0.05, 0.5, 0.95},
# alpha {0.5, 2.0, 3.5}, tau {0.5, 1.25, 2.0}.
COARSE = dict(sigma2=(0.05, 0.95, 0.45), alpha=(0.5, 3.5, 1.5), tau=(0.5, 2.0, 0.75))


def _coarse_grid_sql() -> str:
    from gapseries.functions.columns import grid_values
    vals = {k: grid_values(*v) for k, v in COARSE.items()}
    rows = ", ".join(f"({s!r}::DOUBLE, {a!r}::DOUBLE, {t!r}::DOUBLE)"
                     for s in vals["sigma2"] for a in vals["alpha"] for t in vals["tau"])
    return f"SELECT * FROM (VALUES {rows}) g(sigma2, alpha, tau)"


def _grid_ll_sql() -> str:
    """Summed log likelihood per grid point over the CLICK training series,
    each (series, grid point) by exact elimination with K = sigma2 (R + I)."""
    rq = ("p.sigma2 * pow(1.0::DOUBLE + (a.tw - b.tw) * (a.tw - b.tw) / "
          "(2.0::DOUBLE * p.alpha * p.tau * p.tau), -p.alpha)")
    return f"""
WITH RECURSIVE
pts AS (SELECT t_warped AS tw, value AS v,
          row_number() OVER (PARTITION BY entity, item, unit, category ORDER BY t_rel, event_id) AS i,
          dense_rank() OVER (ORDER BY entity, item, unit, category) AS sid
        FROM ({_cohort_sql([ITEM_CODE], rounded=False)}) c WHERE split = 'train'),
st AS (SELECT sid, count(*) AS n, avg(v) AS mu FROM pts GROUP BY sid),
sd AS (SELECT p.sid, CASE WHEN sqrt(sum((p.v - st.mu) * (p.v - st.mu))) > 1e-8
                          THEN sqrt(sum((p.v - st.mu) * (p.v - st.mu))) ELSE 1.0 END AS scale
       FROM pts p JOIN st ON p.sid = st.sid GROUP BY p.sid),
y AS (SELECT p.*, (p.v - st.mu) / sd.scale AS yv FROM pts p JOIN st ON p.sid = st.sid
      JOIN sd ON p.sid = sd.sid),
grid AS (SELECT row_number() OVER (ORDER BY sigma2, alpha, tau) AS gid, * FROM ({_coarse_grid_sql()}) g0),
ser AS (SELECT sid, gid FROM st, grid),
cells AS (
  SELECT (a.sid * 1000 + p.gid) AS s, a.i, b.i AS j,
         {rq} + CASE WHEN a.i = b.i THEN p.sigma2 ELSE 0.0::DOUBLE END AS x
  FROM y a JOIN y b ON a.sid = b.sid, grid p
  UNION ALL SELECT sid * 1000 + gid, i, {_Y}, yv FROM y, grid
  UNION ALL SELECT sid * 1000 + gid, {_Y}, i, yv FROM y, grid
  UNION ALL SELECT sid * 1000 + gid, {_Y}, {_Y}, 0.0::DOUBLE FROM ser),
{_ELIM_SQL.strip()},
piv AS (SELECT s, sum(ln(x)) AS logdet FROM elim WHERE i = k + 1 AND j = k + 1 GROUP BY s),
fin AS (SELECT s, arg_max(x, k) AS schur FROM elim WHERE i = {_Y} AND j = {_Y} GROUP BY s),
ll AS (SELECT ser.gid, fin.schur / 2.0 - piv.logdet / 2.0 - st.n * ln(2.0 * pi()) / 2.0 AS ll, st.n
       FROM ser JOIN st ON ser.sid = st.sid JOIN piv ON piv.s = ser.sid * 1000 + ser.gid
       JOIN fin ON fin.s = ser.sid * 1000 + ser.gid)
SELECT grid.sigma2, grid.alpha, grid.tau, sum(ll.ll) AS log_likelihood,
       CAST(count(*) AS BIGINT) AS n_series, CAST(sum(ll.n) AS BIGINT) AS n_points
FROM ll JOIN grid ON ll.gid = grid.gid GROUP BY grid.sigma2, grid.alpha, grid.tau"""


GRID_LL_SQL = _grid_ll_sql()


def _coarse_search(spark, sf):
    from gapseries.operators import gp
    from gapseries.plans.gp import cohort_series_arrays
    train = _cohort_df(spark, sf, ITEM_CODE).where(F.col("split") == "train")
    return gp.gp_grid_search(cohort_series_arrays(train, td.ROLES), **COARSE)


@register("gp_grid_search_coarse", f"""
SELECT sigma2, alpha, tau, round(log_likelihood, 4) AS log_likelihood, n_series, n_points
FROM ({GRID_LL_SQL}) g""")
def q_gp_grid_search_coarse(spark, sf):
    return _coarse_search(spark, sf).select("sigma2", "alpha", "tau", rnd("log_likelihood", 4),
                                            "n_series", "n_points")


@register("gp_hyperparameters_coarse", f"""
SELECT sigma2, alpha, tau, round(log_likelihood, 4) AS log_likelihood FROM ({GRID_LL_SQL}) g
ORDER BY log_likelihood DESC, sigma2, alpha, tau LIMIT 1""")
def q_gp_hyperparameters_coarse(spark, sf):
    from gapseries.operators import gp
    best = gp.grid_argmax(_coarse_search(spark, sf), **COARSE)
    return best.select("sigma2", "alpha", "tau", rnd("log_likelihood", 4))


@register("hyperparameter_table", f"""
SELECT sigma2, alpha, tau, round(log_likelihood, 4) AS log_likelihood, '{ITEM_CODE}' AS item_code
FROM ({GRID_LL_SQL}) g ORDER BY log_likelihood DESC, sigma2, alpha, tau LIMIT 1""")
def q_hyperparameter_table(spark, sf):
    """The searched grid saved as a hyperparameter table, and the first row for the item loaded from it."""
    from gapseries.session import scratch_path
    from gapseries.sources.io import HYPERPARAMS_SCHEMA, load_hyperparams, save_hyperparams
    path = scratch_path(spark, "hyperparameters")
    save_hyperparams(_coarse_search(spark, sf).withColumn("item_code", F.lit(ITEM_CODE)), path)
    row = load_hyperparams(spark, path, ITEM_CODE)
    return spark.createDataFrame([row], HYPERPARAMS_SCHEMA).select(
        "sigma2", "alpha", "tau", rnd("log_likelihood", 4), "item_code")


def _values_sql(name: str, values) -> str:
    return f"(VALUES {', '.join(f'({v!r}::DOUBLE)' for v in values)}) {name[0]}0({name})"


def _full_grid_sql() -> str:
    """Summed log likelihood over the full grid: R + I is eliminated once for each
    series and (alpha, tau), and sigma2 enters by the formula."""
    from gapseries.functions.columns import grid_values
    from gapseries.operators import gp
    sigma2, alpha, tau = (grid_values(*g) for g in (gp.DEFAULT_SIGMA2, gp.DEFAULT_ALPHA, gp.DEFAULT_TAU))
    r = "pow(1.0::DOUBLE + (a.tw - b.tw) * (a.tw - b.tw) / (2.0::DOUBLE * p.alpha * p.tau * p.tau), -p.alpha)"
    return f"""
WITH RECURSIVE
pts AS (SELECT t_warped AS tw, value AS v,
          row_number() OVER (PARTITION BY entity, item, unit, category ORDER BY t_rel, event_id) AS i,
          dense_rank() OVER (ORDER BY entity, item, unit, category) AS sid
        FROM ({_cohort_sql([ITEM_CODE], rounded=False)}) c WHERE split = 'train'),
st AS (SELECT sid, count(*) AS n, avg(v) AS mu FROM pts GROUP BY sid),
sd AS (SELECT p.sid, CASE WHEN sqrt(sum((p.v - st.mu) * (p.v - st.mu))) > 1e-8
                          THEN sqrt(sum((p.v - st.mu) * (p.v - st.mu))) ELSE 1.0 END AS scale
       FROM pts p JOIN st ON p.sid = st.sid GROUP BY p.sid),
y AS (SELECT p.*, (p.v - st.mu) / sd.scale AS yv FROM pts p JOIN st ON p.sid = st.sid
      JOIN sd ON p.sid = sd.sid),
grid AS (SELECT row_number() OVER (ORDER BY alpha, tau) AS gid, alpha, tau
         FROM {_values_sql('alpha', alpha)}, {_values_sql('tau', tau)}),
cells AS (
  SELECT (a.sid * 10000 + p.gid) AS s, a.i, b.i AS j,
         {r} + CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x
  FROM y a JOIN y b ON a.sid = b.sid, grid p
  UNION ALL SELECT sid * 10000 + gid, i, {_Y}, yv FROM y, grid
  UNION ALL SELECT sid * 10000 + gid, {_Y}, i, yv FROM y, grid
  UNION ALL SELECT sid * 10000 + gid, {_Y}, {_Y}, 0.0::DOUBLE FROM st, grid),
{_ELIM_SQL.strip()},
piv AS (SELECT s, sum(ln(x)) AS logdet FROM elim WHERE i = k + 1 AND j = k + 1 GROUP BY s),
fin AS (SELECT s, -arg_max(x, k) AS q FROM elim WHERE i = {_Y} AND j = {_Y} GROUP BY s),
terms AS (SELECT grid.alpha, grid.tau, sum(fin.q) AS q, sum(piv.logdet) AS logdet,
                 CAST(count(*) AS BIGINT) AS n_series, CAST(sum(st.n) AS BIGINT) AS n_points
          FROM fin JOIN piv ON fin.s = piv.s JOIN grid ON grid.gid = fin.s % 10000
          JOIN st ON st.sid = fin.s // 10000 GROUP BY grid.alpha, grid.tau)
SELECT sigma2, alpha, tau, n_series, n_points,
       -q / (2.0 * sigma2) - n_points / 2.0 * ln(sigma2) - logdet / 2.0
         - n_points / 2.0 * ln(2.0 * pi()) AS log_likelihood
FROM terms, {_values_sql('sigma2', sigma2)}"""


FULL_GRID_SQL = _full_grid_sql()
SQL["gp_grid_search"] = f"""
SELECT sigma2, alpha, tau, round(log_likelihood, 4) AS log_likelihood, n_series, n_points FROM ({FULL_GRID_SQL}) g"""
SQL["gp_hyperparameters"] = f"""
SELECT sigma2, alpha, tau, round(log_likelihood, 4) AS log_likelihood, '{ITEM_CODE}' AS item_code,
  abs(sigma2 - 0.05) < 1e-9 OR abs(sigma2 - 2.0) < 1e-9 OR abs(alpha - 0.05) < 1e-9 OR abs(alpha - 3.95) < 1e-9
  OR abs(tau - 0.2) < 1e-9 OR abs(tau - 2.0) < 1e-9 AS at_grid_edge
FROM ({FULL_GRID_SQL}) g ORDER BY log_likelihood DESC, sigma2, alpha, tau LIMIT 1"""


# Layer-1 weights from a closed-form rule, so SQL can rebuild them:
# W1[i, j] = 0.3 sin(0.37 i + 0.11 j + 0.5), b1[j] = 0.1 cos(0.05 j).
RULE_HIDDEN = 100


def _rule_weights():
    import numpy as np
    i = np.arange(2 * PATCH_LEN)[:, None]
    j = np.arange(RULE_HIDDEN)[None, :]
    return {"W1": 0.3 * np.sin(0.37 * i + 0.11 * j + 0.5),
            "b1": 0.1 * np.cos(0.05 * np.arange(RULE_HIDDEN))}


# Layer 2: W2[j, l] = 0.2 cos(0.13 j + 0.29 l), b2[l] = 0.05 sin(0.1 l).
RULE_HIDDEN_2 = 20


def _rule_weights_2():
    import numpy as np
    j, l = np.arange(RULE_HIDDEN)[:, None], np.arange(RULE_HIDDEN_2)[None, :]  # noqa: E741
    return _rule_weights() | {"W2": 0.2 * np.cos(0.13 * j + 0.29 * l),
                              "b2": 0.05 * np.sin(0.1 * np.arange(RULE_HIDDEN_2))}


def _encoded_sql(rounded: bool = True) -> str:
    fs = ", ".join(f"f{k}" for k in range(2 * PATCH_LEN))
    h = "1.0 / (1.0 + exp(-(sum(u.x * w.w) + 0.1 * cos(0.05 * w.j))))"
    return f"""
WITH p AS (SELECT q.* FROM ({_patches_sql(GP_RESAMPLE_RAW_SQL)}) q
           JOIN ({SAMPLED_SQL}) s USING ({_PKEYS}, start)),
u AS (SELECT {_PKEYS}, start, CAST(substr(fname, 2) AS INTEGER) AS i, x
      FROM (UNPIVOT p ON {fs} INTO NAME fname VALUE x) v),
w AS (SELECT i, j, 0.3 * sin(0.37 * i + 0.11 * j + 0.5) AS w
      FROM range(0, {2 * PATCH_LEN}) a(i), range(0, {RULE_HIDDEN}) b(j))
SELECT {_PKEYS}, start, CAST(w.j AS INTEGER) AS j, {f"round({h}, {R})" if rounded else h} AS h
FROM u JOIN w ON u.i = w.i
GROUP BY {_PKEYS}, start, w.j"""


@register("encode_patches_rule", _encoded_sql())
def q_encode_patches_rule(spark, sf):
    """Layer-1 encoding of the sampled patches with rule-built weights."""
    from gapseries.operators import autoencoder as ae
    enc = ae.encode(_sampled(spark, sf), _rule_weights(), layer=1, out="h")
    return enc.select(*GP_KEYS, "start", F.posexplode("h").alias("j", "h")).select(
        *GP_KEYS, "start", "j", rnd("h"))


_RULE_2_SQL = f"""
WITH h AS ({_encoded_sql(False)}),
w AS (SELECT j, l, 0.2 * cos(0.13 * j + 0.29 * l) AS w
      FROM range(0, {RULE_HIDDEN}) a(j), range(0, {RULE_HIDDEN_2}) b(l))
SELECT {_PKEYS}, start, CAST(w.l AS INTEGER) AS j,
  round(1.0 / (1.0 + exp(-(sum(h.h * w.w) + 0.05 * sin(0.1 * w.l)))), {R}) AS h
FROM h JOIN w ON h.j = w.j GROUP BY {_PKEYS}, start, w.l"""


def _encoded_2(spark, sf, weights):
    from gapseries.operators import autoencoder as ae
    enc = ae.encode(_sampled(spark, sf), weights, layer=2, out="h")
    return enc.select(*GP_KEYS, "start", F.posexplode("h").alias("j", "h")).select(
        *GP_KEYS, "start", "j", rnd("h"))


@register("encode_patches_rule_2", _RULE_2_SQL)
def q_encode_patches_rule_2(spark, sf):
    """Layer-2 encoding of the sampled patches with rule-built weights."""
    return _encoded_2(spark, sf, _rule_weights_2())


@register("encode_saved_weights", _RULE_2_SQL)
def q_encode_saved_weights(spark, sf):
    """The same encoding with the weights saved as a table and loaded again."""
    from gapseries.operators import autoencoder as ae
    from gapseries.session import scratch_path
    path = scratch_path(spark, "weights")
    ae.save_weights(spark, _rule_weights_2(), path)
    return _encoded_2(spark, sf, ae.load_weights(spark, path))


# One gradient step on standardised series statistics (4 inputs, 3 hidden units),
# with W1[i, j] = 0.3 sin(0.37 i + 0.11 j + 0.5), V1[j, i] = 0.2 cos(0.21 j + 0.17 i).
GRAD_IN, GRAD_HIDDEN, GRAD_L1 = 4, 3, 0.01

_STATS_SQL = f"""
SELECT entity, item, n::DOUBLE / 10.0 AS x0, span / 100.0 AS x1, mean / 100.0 AS x2, l2_dev / 100.0 AS x3 FROM (
  SELECT entity, item, count(*) AS n, max(t_days) - min(t_days) AS span, avg(value) AS mean,
    stddev_pop(value) * sqrt(count(*)) AS l2_dev
  FROM (SELECT *, {T_DAYS_SQL} AS t_days FROM ({td.SQL_EVENTS}) e WHERE ts IS NOT NULL AND value IS NOT NULL) p
  GROUP BY entity, item) s"""


def _gradient_sql() -> str:
    d = GRAD_IN
    unpivot = " UNION ALL ".join(f"SELECT entity, item, {i} AS i, x{i} AS x FROM s" for i in range(d))
    return f"""
WITH s AS ({_STATS_SQL}), x AS ({unpivot}),
w AS (SELECT i, j, 0.3 * sin(0.37 * i + 0.11 * j + 0.5) AS w, 0.2 * cos(0.21 * j + 0.17 * i) AS v
      FROM range(0, {d}) a(i), range(0, {GRAD_HIDDEN}) b(j)),
h AS (SELECT entity, item, j, 1.0 / (1.0 + exp(-sum(x * w))) AS h FROM x JOIN w USING (i) GROUP BY ALL),
y AS (SELECT entity, item, i, 2.0 * (sum(h * v) - any_value(x.x)) / {d} AS dy
      FROM h JOIN w USING (j) JOIN x USING (entity, item, i) GROUP BY ALL),
z AS (SELECT entity, item, j, (sum(dy * v) + {GRAD_L1}) * any_value(h) * (1.0 - any_value(h)) AS dz
      FROM y JOIN w USING (i) JOIN h USING (entity, item, j) GROUP BY ALL),
g AS (SELECT 'W1' AS name, i, j, sum(x * dz) AS g FROM x JOIN z USING (entity, item) GROUP BY i, j
      UNION ALL SELECT 'V1', j, i, sum(h * dy) FROM h JOIN y USING (entity, item) GROUP BY i, j
      UNION ALL SELECT 'b1', j, 0, sum(dz) FROM z GROUP BY j
      UNION ALL SELECT 'c1', i, 0, sum(dy) FROM y GROUP BY i)
SELECT name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(g, 4) + 0.0 AS g FROM g"""


@register("autoencoder_gradient", _gradient_sql())
def q_autoencoder_gradient(spark, sf):
    """Phase-1 gradient sums over all series, from rule-built weights."""
    import numpy as np

    from gapseries.operators import autoencoder as ae
    st = se.series_stats(_event_points(spark, sf), ["entity", "item"], "t_days", "value")
    x = F.array(F.col("n") / 10.0, F.col("span") / 100.0, F.col("mean") / 100.0, F.col("l2_dev") / 100.0)
    i, j = np.arange(GRAD_IN)[:, None], np.arange(GRAD_HIDDEN)[None, :]
    p = {"W1": 0.3 * np.sin(0.37 * i + 0.11 * j + 0.5), "b1": np.zeros(GRAD_HIDDEN),
         "V1": 0.2 * np.cos(0.21 * j + 0.17 * i).T, "c1": np.zeros(GRAD_IN)}
    g, _, _ = ae.distributed_gradient(st.select(x.alias("features")), "features", p, 1, GRAD_L1)
    return ae.weights_frame(spark, g).select("name", "i", "j", rnd("w", 4).alias("g"))


def _series_features(spark, sf):
    """Standardised statistics of every series, and whether its item is a purchase or error."""
    st = se.series_stats(_event_points(spark, sf), ["entity", "item"], "t_days", "value")
    x = F.array(F.col("n") / 10.0, F.col("span") / 100.0, F.col("mean") / 100.0, F.col("l2_dev") / 100.0)
    return st.select("entity", "item", x.alias("h"), F.col("item").isin("purchase", "error").cast("int").alias("y"))


NEWTON_STEPS = 12


def _newton_sql() -> str:
    """Weights of the penalised logistic regression after Newton steps from zero.

    A step sums the gradient and the 5 x 5 Hessian over the rows, eliminates the
    system (symmetric and positive definite, so without pivoting) a column to a
    subquery, and substitutes back.
    """
    d = 5
    w = [f"w{i}" for i in range(d)]
    x = [*(f"x{i}" for i in range(d - 1)), "1.0::DOUBLE"]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    score = " + ".join(f"{a} * {b}" for a, b in zip(w, x))
    steps = [f"n0 AS (SELECT {', '.join(f'0.0::DOUBLE AS {a}' for a in w)})"]
    for k in range(NEWTON_STEPS):
        p = f"SELECT *, 1.0 / (1.0 + exp(-({score}))) AS p FROM s, n{k}"
        sums = [f"any_value({w[i]}) AS {w[i]}" for i in range(d)]
        sums += [f"any_value({w[i]}) + sum((p - y) * {x[i]}) AS b{i}" for i in range(d)]
        sums += [f"{1.0 if i == j else 0.0} + sum(p * (1.0 - p) * {x[i]} * {x[j]}) AS a{i}{j}" for i, j in upper]
        sql = f"SELECT {', '.join(sums)} FROM ({p}) t"
        for c in range(d - 1):
            cells = [*w, *(f"b{i}" for i in range(c + 1)), *(f"a{i}{j}" for i, j in upper if i <= c)]
            cells += [f"b{i} - a{c}{i} / a{c}{c} * b{c} AS b{i}" for i in range(c + 1, d)]
            cells += [f"a{i}{j} - a{c}{i} / a{c}{c} * a{c}{j} AS a{i}{j}" for i, j in upper if i > c]
            sql = f"SELECT {', '.join(cells)} FROM ({sql}) e{c}"
        for i in range(d - 1, -1, -1):
            known = "".join(f" - a{i}{j} * z{j}" for j in range(i + 1, d))
            sql = f"SELECT *, (b{i}{known}) / a{i}{i} AS z{i} FROM ({sql}) r{i}"
        steps.append(f"n{k + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i} - z{i} AS w{i}' for i in range(d))} "
                     f"FROM ({sql}) q)")
    return f"""
WITH s AS MATERIALIZED (
  SELECT *, CASE WHEN item IN ('purchase', 'error') THEN 1.0 ELSE 0.0 END AS y FROM ({_STATS_SQL}) t),
{', '.join(steps)}
SELECT * FROM n{NEWTON_STEPS}"""


@register("classifier_optimum", " UNION ALL ".join(
    f"SELECT {j}::BIGINT AS j, round(w{j}, 4) + 0.0 AS coefficient FROM ({_newton_sql()}) f" for j in range(5)))
def q_classifier_optimum(spark, sf):
    """The fitted logistic regression's coefficients, the intercept last."""
    from gapseries.operators.classifier import fit_classifier
    model = fit_classifier(_series_features(spark, sf), "h", "y")
    rows = [(j, float(c)) for j, c in enumerate([*model.coefficients, model.intercept])]
    return spark.createDataFrame(rows, "j long, c double").select("j", F.round("c", 4).alias("coefficient"))


@register("classifier_predictions", f"""
SELECT s.entity, s.item, round(1.0 / (1.0 + exp(-(w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 + w4))), 4) AS score,
  CAST(w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 > 0 AS INTEGER) AS prediction
FROM ({_STATS_SQL}) s, ({_newton_sql()}) f""")
def q_classifier_predictions(spark, sf):
    """Every series scored by the model fitted on all of them."""
    from gapseries.operators.classifier import fit_classifier, predict
    rows = _series_features(spark, sf)
    scored = predict(fit_classifier(rows, "h", "y"), rows, "h", probability="p")
    return scored.select("entity", "item", F.round("p", 4).alias("score"), "prediction")


def _score_sql() -> str:
    """A fixed linear score of each series, its hard prediction and its truth."""
    return f"""SELECT 0.8 * x2 - 0.3 * x0 AS s, CASE WHEN item IN ('purchase', 'error') THEN 1 ELSE 0 END AS y
FROM ({_STATS_SQL}) t"""


@register("classification_metrics", f"""
SELECT round(CASE WHEN tp + tn + fp + fn = 0 THEN 0 ELSE (tp + tn) / (tp + tn + fp + fn) END, 6) AS accuracy,
  round((CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END
       + CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END) / 2, 6) AS auc,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM (SELECT sum(CASE WHEN s > 0 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
             sum(CASE WHEN s > 0 AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
             sum(CASE WHEN s <= 0 AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn,
             sum(CASE WHEN s <= 0 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM ({_score_sql()}) t) c""")
def q_classification_metrics(spark, sf):
    """Metrics of the hard predictions of the same score."""
    scored = _scored_series(spark, sf).select((F.col("s") > 0).cast("int").alias("p"), "y")
    m = me.classification_metrics(scored, "p", "y")
    return m.select(*[rnd(c) for c in m.columns])


def _scored_series(spark, sf):
    return _series_features(spark, sf).select((0.8 * F.col("h")[2] - 0.3 * F.col("h")[0]).alias("s"), "y")


@register("ranking_auc", f"""
WITH t AS ({_score_sql()}), c AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM t GROUP BY s),
r AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n / 2.0 AS below FROM c)
SELECT round(sum(p * below) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 6) AS auc FROM r""")
def q_ranking_auc(spark, sf):
    """Area under the ROC curve of a fixed score of every series."""
    return me.ranking_auc(_scored_series(spark, sf), "s", "y").select(rnd("auc"))
