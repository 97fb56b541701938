"""Registered queries over the panels, each with the SQL that gives the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelgrid.operators import audit, calibration, folds, grid, hac, ic, inference, labels, normalize, pit, portfolio, risk, selection, tensor, universe
from panelgrid.sources import config, store, synthetic

from .panels import A_SQL, B_SQL, E_SQL, announcements, order_days, read, supplier_month, user_day, user_day_rows
from .registry import QUERIES, SQL, Query, r6, query, rounded

MIN_OBS = 5

# ---- normalizers -------------------------------------------------------------------------------

_Z = "(x - avg(x) OVER {w}) / nullif(stddev_samp(x) OVER {w}, 0)"


def _norm(name: str, panel: str, col: str, sql: str, **kwargs) -> None:
    source, cte = {"a": (supplier_month, A_SQL), "b": (user_day, B_SQL)}[panel]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = normalize.PROCESSORS[kwargs.get("processor", name)](source(spark, sf_dir), col, "z", **{k: v for k, v in kwargs.items() if k != "processor"})
        return rounded(out.select("datetime", "instrument", "z"), "z")

    run.__name__ = name
    query(f"WITH {cte}, p AS (SELECT datetime, pos, instrument, {col} AS x FROM {panel}) SELECT datetime, instrument, round(z, 6) + 0.0 AS z FROM ({sql})")(run)


_BACK = "(PARTITION BY instrument ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_norm("roll_z", "a", "qty", "SELECT datetime, instrument, CASE WHEN count(x) OVER w >= 6 THEN (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS z FROM p WINDOW w AS " + _BACK.format(n=12), length=12, min_periods=6)
_norm("roll_z_sparse", "b", "val", "SELECT datetime, instrument, CASE WHEN count(x) OVER w >= 4 THEN (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS z FROM p WINDOW w AS " + _BACK.format(n=10), processor="roll_z", length=10, min_periods=4)
_norm("expanding_z", "a", "qty", "SELECT datetime, instrument, CASE WHEN count(x) OVER w >= 20 THEN (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS z FROM p WINDOW w AS " + _BACK.format(n="UNBOUNDED"))
_ROBUST = """
SELECT datetime, instrument, CASE WHEN x IS NOT NULL AND mad IS NOT NULL AND mad <> 0 THEN greatest(-5.0, least(5.0, (x - med) / (1.4826022 * mad))) END AS z FROM (
  SELECT *, CASE WHEN count(dev) OVER w >= 6 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM (
    SELECT *, abs(past - med) AS dev FROM (
      SELECT *, CASE WHEN count(past) OVER w >= 6 THEN quantile_cont(past, 0.5) OVER w END AS med FROM (
        SELECT *, lag(x) OVER (PARTITION BY instrument ORDER BY pos) AS past FROM p)
      WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)))
  WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
"""
_norm("roll_robust_z", "a", "qty", _ROBUST, length=12, min_periods=6)
_RANK = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY datetime, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0::DOUBLE END"
_norm("cs_rank", "b", "n_events", f"SELECT datetime, instrument, ({_RANK.format(x='x')}) / (count(x) OVER (PARTITION BY datetime) + 1.0::DOUBLE) AS z FROM p")
_norm("cs_z", "b", "val", "SELECT datetime, instrument, " + _Z.format(w="(PARTITION BY datetime)") + " AS z FROM p")
_norm("cs_robust_z", "b", "val", "SELECT datetime, instrument, CASE WHEN x IS NOT NULL AND mad <> 0 THEN greatest(-5.0, least(5.0, (x - med) / (1.4826022 * mad))) END AS z FROM (SELECT *, median(abs(x - med)) OVER (PARTITION BY datetime) AS mad FROM (SELECT *, median(x) OVER (PARTITION BY datetime) AS med FROM p))")
_norm("global_z", "a", "qty", "SELECT datetime, instrument, " + _Z.format(w="(PARTITION BY instrument)") + " AS z FROM p", allow_leaky=True)


@query(f"WITH {B_SQL} SELECT datetime, instrument, round((val - avg(val) OVER w) / CASE WHEN stddev_pop(val) OVER w = 0 THEN 1 ELSE stddev_pop(val) OVER w END, 6) + 0.0 AS z FROM b WINDOW w AS (PARTITION BY datetime)")
def cs_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.cs_standardize(user_day(spark, sf_dir), "val", "z").select("datetime", "instrument", "z"), "z")


@query(f"WITH {B_SQL} SELECT datetime, instrument, round(CASE WHEN val IS NOT NULL THEN greatest(quantile_cont(val, 0.05) OVER w, least(quantile_cont(val, 0.95) OVER w, val)) END, 6) + 0.0 AS z FROM b WINDOW w AS (PARTITION BY datetime)")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.winsorize(user_day(spark, sf_dir), "val", "z", 0.05).select("datetime", "instrument", "z"), "z")


# ---- labels ------------------------------------------------------------------------------------


def _lab(h: int, lag: int = 1) -> str:
    w = "OVER (PARTITION BY instrument ORDER BY pos)"
    entry = f"lead(qty, {lag}) {w}" if lag else "qty"
    return f"lead(qty, {lag + h}) {w} / nullif({entry}, 0) - 1"


def _forward(h: int) -> None:
    spec = labels.LabelSpec(horizon=h, field="qty")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(labels.forward_return(supplier_month(spark, sf_dir), spec, "label").select("datetime", "instrument", "label"), "label")

    run.__name__ = f"forward_return_h{h}"
    query(f"WITH {A_SQL} SELECT datetime, instrument, round({_lab(h)}, 6) + 0.0 AS label FROM a")(run)


_forward(1)
_forward(5)


def _variant(kind: str, sql: str) -> None:
    spec = labels.LabelSpec(field="qty", variant=kind, winsorize=0.01)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = labels.apply_variant(labels.forward_return(supplier_month(spark, sf_dir), spec, "raw"), "raw", "label", spec)
        return rounded(made.select("datetime", "instrument", "label"), "label")

    run.__name__ = f"label_{kind}"
    wins = "CASE WHEN y IS NOT NULL THEN greatest(quantile_cont(y, 0.01) OVER (PARTITION BY datetime), least(quantile_cont(y, 0.99) OVER (PARTITION BY datetime), y)) END"
    query(f"WITH {A_SQL}, l AS (SELECT datetime, instrument, {_lab(1)} AS y FROM a), v AS (SELECT datetime, instrument, {wins} AS x FROM l) SELECT datetime, instrument, round({sql}, 6) + 0.0 AS label FROM v")(run)


_variant("raw", "x")
_variant("rank", f"({_RANK.format(x='x')}) / (count(x) OVER (PARTITION BY datetime) + 1.0::DOUBLE)")
_variant("zscore", _Z.format(w="(PARTITION BY datetime)"))

_TRADABLE = """
m AS (SELECT datetime, pos, instrument, qty AS close, n_lines AS volume, lag(qty) OVER (PARTITION BY instrument ORDER BY pos) AS prev, count(qty) OVER (PARTITION BY instrument ORDER BY pos) AS seen FROM a),
t AS (SELECT datetime, pos, instrument, close, coalesce(close IS NOT NULL AND volume > 0 AND seen >= 6 AND NOT coalesce(CASE WHEN prev = 0 THEN close <> 0 ELSE abs(close / nullif(prev, 0) - 1) >= 0.5 END, false), false) AS tradable FROM m)
"""
_RULES = universe.TradabilityRules(min_listed=6, limit=0.5)


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_month(spark, sf_dir).withColumnsRenamed({"qty": "close", "n_lines": "volume"})


@query(f"WITH {A_SQL}, {_TRADABLE} SELECT datetime, instrument, tradable FROM t")
def tradability_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.tradability_mask(_market(spark, sf_dir), rules=_RULES).select("datetime", "instrument", "tradable")


@query(f"WITH {A_SQL}, {_TRADABLE} SELECT datetime, instrument, lead(close, 2) OVER w / nullif(lead(close, 1) OVER w, 0) - 1 IS NOT NULL AND coalesce(lead(tradable, 1) OVER w, false) AS available FROM t WINDOW w AS (PARTITION BY instrument ORDER BY pos)")
def label_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = labels.LabelSpec(field="close")
    made = labels.forward_return(universe.tradability_mask(_market(spark, sf_dir), rules=_RULES), spec, "label")
    return labels.label_availability(made, "label", "available", spec, tradable="tradable").select("datetime", "instrument", "available")


@query(f"WITH {A_SQL} SELECT datetime, pos FROM cal WHERE abs(pos - 20) <= 5")
def purge_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = grid.calendar(read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("datetime")))
    return labels.purge_positions(days, 20, labels.LabelSpec(horizon=5).purge_radius)


# ---- intervals ---------------------------------------------------------------------------------

_INTERVALS = "iv AS (SELECT user_id AS instrument, CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e FROM events GROUP BY user_id, event_type)"


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("instrument"), "event_type").agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end")).drop("event_type")


@query(f"WITH {B_SQL}, {_INTERVALS} SELECT datetime, instrument, EXISTS (SELECT 1 FROM iv WHERE iv.instrument = b.instrument AND b.datetime BETWEEN s AND e) AS member FROM b")
def membership_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.membership_mask(user_day(spark, sf_dir), _intervals(spark, sf_dir)).select("datetime", "instrument", "member")


@query(f"WITH {_INTERVALS} SELECT instrument, min(s) AS listed FROM iv GROUP BY 1")
def listing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.listing_dates(_intervals(spark, sf_dir))


@query(f"WITH {_INTERVALS}, r AS (SELECT min(CAST(ts AS DATE)) AS d FROM events) SELECT DISTINCT instrument FROM iv, r WHERE s <= DATE '2024-01-10' AND e >= DATE '2024-01-05'")
def list_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_instruments(_intervals(spark, sf_dir), "2024-01-05", "2024-01-10")


# ---- as-of -------------------------------------------------------------------------------------

_SPEC = pit.LagSpec(values=("amount",))
_START = "ranked AS (SELECT *, (SELECT count(*) FROM days WHERE datetime < announce_date) AS start FROM ok), spans AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY instrument ORDER BY announce_date, report_date, amount), (SELECT count(*) FROM days)) AS stop0 FROM ranked)"


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(spark, sf_dir).where("announce_date >= report_date")


def _rows(spark: SparkSession, sf_dir: str) -> int:
    """About how many rows announcements and their publication have at most: one for each line, and for each customer and day."""
    names, days = read(spark, sf_dir, "orders").agg(F.approx_count_distinct("o_custkey"), F.approx_count_distinct(F.trunc("o_orderdate", "month"))).first()
    return read(spark, sf_dir, "lineitem").count() + names * days


def _published(name: str, stop: str, **kwargs) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pit.publish(_late(spark, sf_dir), order_days(spark, sf_dir), _SPEC, rows=_rows(spark, sf_dir), **kwargs).select("datetime", "instrument", "amount")

    run.__name__ = name
    query(f"WITH {E_SQL}, {_START}, cut AS (SELECT *, {stop} AS stop FROM spans) SELECT datetime, instrument, amount FROM cut JOIN days ON pos >= start AND pos < stop")(run)


_published("pit_publish", "stop0")
_published("pit_publish_stale_periods", "least(stop0, start + 3)", max_periods=3)
_published("pit_publish_stale_days", "least(stop0, (SELECT count(*) FROM days WHERE datetime <= announce_date + 40))", max_days=40)


@query(f"WITH {E_SQL}, {_START}, pub AS (SELECT datetime, instrument, amount FROM spans JOIN days ON pos >= start AND pos < stop0) SELECT d.datetime, i.instrument, p.amount FROM days d CROSS JOIN (SELECT DISTINCT instrument FROM ok) i LEFT JOIN pub p ON p.datetime = d.datetime AND p.instrument = i.instrument")
def pit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, late = order_days(spark, sf_dir), _late(spark, sf_dir)
    names = late.select("instrument").distinct()
    return grid.densify(pit.publish(late, days, _SPEC, rows=_rows(spark, sf_dir)), ["amount"], days=days, names=names).select("datetime", "instrument", "amount")


_AS_OF = """
{p} AS (SELECT datetime, instrument, amount FROM {spans} JOIN days ON pos >= start AND pos < stop0),
{p}_bad AS (
  SELECT count(*) AS n FROM {p} LEFT JOIN (
    SELECT d.datetime, o.instrument, max({{'a': announce_date, 'r': report_date, 'v': amount}}) AS x FROM days d JOIN ok o ON announce_date <= d.datetime GROUP BY 1, 2) l USING (datetime, instrument)
  WHERE l.x IS NULL OR abs({p}.amount - l.x.v) > 1e-8 + 1e-5 * abs(l.x.v))"""
_EARLY = _START.replace("ranked", "early").replace("spans", "early_spans").replace("announce_date", "report_date").replace("report_date, report_date", "report_date")


@query(f"WITH {E_SQL}, {_START}, {_EARLY}, {_AS_OF.format(p='pub', spans='spans')}, {_AS_OF.format(p='leak', spans='early_spans')} SELECT pub_bad.n AS violations, leak_bad.n AS leaky_violations FROM pub_bad, leak_bad")
def pit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published values that aren't the latest announced: of the publication by announcement, and of its negative control by report date."""
    late, days, rows = _late(spark, sf_dir), order_days(spark, sf_dir), _rows(spark, sf_dir)
    bad = lambda name, **kwargs: pit.verify(pit.publish(late, days, _SPEC, rows=rows, **kwargs), late, _SPEC, rows=rows).agg(F.count(F.lit(1)).alias(name))
    return bad("violations").crossJoin(F.broadcast(bad("leaky_violations", mode="report_date", allow_leaky=True)))  # one row each


@query(f"WITH {E_SQL} SELECT instrument, (SELECT min(datetime) FROM days WHERE datetime >= seen) AS first_date FROM (SELECT instrument, min(announce_date) AS seen FROM ev GROUP BY 1)")
def first_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.first_visible(announcements(spark, sf_dir), order_days(spark, sf_dir), _SPEC)


@query(f"WITH {E_SQL} SELECT instrument, count(*) AS n FROM ev WHERE announce_date < report_date GROUP BY 1")
def negative_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.negative_lags(announcements(spark, sf_dir), _SPEC).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


# ---- information coefficients and inference ----------------------------------------------------

_PAIRS = f"pairs AS (SELECT datetime, instrument, score, label FROM (SELECT datetime, instrument, CASE WHEN count(qty) OVER w >= 6 THEN (qty - avg(qty) OVER w) / nullif(stddev_samp(qty) OVER w, 0) END AS score, {_lab(1)} AS label FROM a WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)))"
_KEPT = f"kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY datetime) AS c FROM pairs WHERE score IS NOT NULL AND label IS NOT NULL) WHERE c >= {MIN_OBS}), ranks AS (SELECT datetime, {_RANK.format(x='score')} AS rs, {_RANK.format(x='label')} AS rl, score, label FROM kept)"


def _corr(x: str, y: str, frm: str) -> str:
    return f"SELECT datetime, count(*) AS n, sum(cx * cy) / nullif(sqrt(sum(cx * cx) * sum(cy * cy)), 0) AS ic FROM (SELECT datetime, {x} - avg({x}) OVER (PARTITION BY datetime) AS cx, {y} - avg({y}) OVER (PARTITION BY datetime) AS cy FROM {frm}) GROUP BY 1"


_IC = f"{A_SQL}, {_PAIRS}, {_KEPT}, ic0 AS ({_corr('rs', 'rl', 'ranks')}), ic AS (SELECT * FROM ic0 WHERE ic IS NOT NULL)"


def _pairs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    panel = supplier_month(spark, sf_dir)
    panel = normalize.roll_z(panel.repartition(parts, "instrument") if parts else panel, "qty", "score", length=12, min_periods=6)
    return labels.forward_return(panel, labels.LabelSpec(field="qty"), "label").select("datetime", "pos", "instrument", "score", "label")


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ic.rank_ic(_pairs(spark, sf_dir), min_obs=MIN_OBS)


@query(f"WITH {_IC} SELECT datetime, n, round(ic, 6) + 0.0 AS ic FROM ic")
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ic(spark, sf_dir), "ic")


@query(f"WITH {A_SQL}, {_PAIRS}, {_KEPT} SELECT datetime, n, round(ic, 6) + 0.0 AS ic FROM ({_corr('score', 'label', 'ranks')}) WHERE ic IS NOT NULL")
def pearson_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ic.pearson_ic(_pairs(spark, sf_dir), min_obs=MIN_OBS), "ic")


@query(f"WITH {B_SQL} SELECT datetime, n, round(ic, 6) + 0.0 AS ic FROM ({_corr('val', 'n_events', '(SELECT * FROM b WHERE val IS NOT NULL AND n_events IS NOT NULL)')})")
def per_date_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ic.per_date_correlation(user_day(spark, sf_dir), "val", "n_events"), "ic")


@query(f"WITH {B_SQL} SELECT datetime, round(CASE WHEN count(val) >= 4 THEN kurtosis_pop(val) END, 6) + 0.0 AS kurt FROM b GROUP BY 1")
def cs_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_day(spark, sf_dir).groupBy("datetime").agg(r6(F.when(F.count("val") >= 4, F.kurtosis("val"))).alias("kurt"))


@query(f"WITH {_IC}, o AS (SELECT count(ic) AS n_obs, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic) SELECT n_obs, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(mean / std, 6) + 0.0 AS icir, round(mean / std * sqrt(12), 6) + 0.0 AS icir_annual, round(mean / std * sqrt(n_obs), 6) + 0.0 AS t_iid FROM o")
def ic_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ic.moments(_ic(spark, sf_dir), periods_per_year=12), "mean", "std", "icir", "icir_annual", "t_iid")


_U_IC = f"{_IC}, s AS (SELECT row_number() OVER (ORDER BY datetime) AS i, ic - avg(ic) OVER () AS u, avg(ic) OVER () AS mean, count(*) OVER () AS n FROM ic)"
_G = "bw AS (SELECT least(floor(4 * pow(max(n) / 100.0, 2.0 / 9.0)), max(n) - 1) AS bw FROM {s}), g AS (SELECT x.i - y.i AS l, sum(x.u * y.u) / max(x.n) AS gamma FROM {s} x JOIN {s} y ON x.i - y.i BETWEEN 0 AND (SELECT bw FROM bw) GROUP BY 1), v AS (SELECT sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / (bw + 1.0)) * gamma END) AS variance, max(bw) AS bw FROM g, bw)"
_NW = "SELECT n AS n_obs, CAST(bw AS BIGINT) AS bandwidth, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance, round(se, 6) + 0.0 AS standard_error, round(mean / se, 6) + 0.0 AS t_stat FROM (SELECT n, bw, mean, {var} AS variance, sqrt({var} / n) * sqrt(n / (n - 2.0::DOUBLE)) AS se FROM v, (SELECT max(n) AS n, max(mean) AS mean{more} FROM {s}))"


def _nw(df: DataFrame) -> DataFrame:
    return rounded(df.select("n_obs", "bandwidth", "mean", "variance", "standard_error", "t_stat"), "mean", "variance", "standard_error", "t_stat")


@query(f"WITH {_U_IC}, {_G.format(s='s')} {_NW.format(s='s', var='variance', more='')}")
def newey_west_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nw(hac.newey_west(_ic(spark, sf_dir), p_value=False))


_RHO = "r AS (SELECT greatest(-0.99, least(0.99, sum(u * p) / sum(p * p))) AS rho FROM (SELECT u, lag(u) OVER (ORDER BY i) AS p FROM s) WHERE p IS NOT NULL)"
_E = f"{_RHO}, e0 AS (SELECT i, e, mean, rho FROM (SELECT i, u - rho * lag(u) OVER (ORDER BY i) AS e, mean, rho FROM s, r) WHERE e IS NOT NULL), e AS (SELECT row_number() OVER (ORDER BY i) AS i, e - avg(e) OVER () AS u, mean, rho, count(*) OVER () AS n FROM e0)"


@query(f"WITH {_U_IC}, {_E}, {_G.format(s='e')} {_NW.format(s='e', var='(variance / ((1 - rho) * (1 - rho)))', more=', max(rho) AS rho')}")
def newey_west_prewhitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nw(hac.newey_west(_ic(spark, sf_dir), prewhiten=True, p_value=False))


@query()
def newey_west_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both references' records of one series, which is computed once."""
    return hac.both_references(_ic(spark, sf_dir)).withColumnRenamed("reference", "kind").withColumn("reference", F.col("kind"))


@query(f"WITH {_U_IC} SELECT CAST(x.i - y.i AS INTEGER) AS lag, round(sum(x.u * y.u) / max(x.n), 9) + 0.0 AS gamma FROM s x JOIN s y ON x.i - y.i BETWEEN 0 AND 6 GROUP BY 1")
def hac_autocovariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hac.autocovariances(_ic(spark, sf_dir), 6).withColumn("gamma", F.round("gamma", 9) + F.lit(0.0))


@query(f"WITH {_U_IC}, {_RHO} SELECT (SELECT max(n) FROM s) AS n, round(rho, 6) + 0.0 AS rho FROM r")
def ar1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hac.ar1(_ic(spark, sf_dir)), "rho")


@query(f"WITH {_U_IC} SELECT max(n) AS n, round(sum(u * p) / sum(u * u), 6) + 0.0 AS acf1 FROM (SELECT n, u, lag(u) OVER (ORDER BY i) AS p FROM s)")
def acf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hac.lag1_autocorrelation(_ic(spark, sf_dir)), "acf1")


# ---- tensors -----------------------------------------------------------------------------------


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = user_day(spark, sf_dir).withColumn("y", F.lead("val").over(grid.by_name())).withColumn("open", F.coalesce(F.col("n_events") > 0, F.lit(False)))
    return tensor.sequence_bundle(panel, ["n_events", "val"], "y", lookback=5, fill=-1.0, tradable="open", weight="n_events", min_valid_steps=2)


_STEPS = f"""{B_SQL},
k AS (SELECT datetime, pos, instrument, val, n_events, lead(val) OVER (PARTITION BY instrument ORDER BY pos) AS y, coalesce(n_events > 0, false) AS open FROM b),
st AS (SELECT k.datetime, k.instrument, s.i AS step, h.val, h.n_events, h.val IS NOT NULL AND h.n_events IS NOT NULL AND (k.open OR s.i < 4) AS ok FROM k CROSS JOIN range(5) s(i) LEFT JOIN k h ON h.instrument = k.instrument AND h.pos = k.pos - 4 + s.i),
bn AS (SELECT k.datetime, k.instrument, k.y IS NOT NULL AS c1, k.open AS c3, n_ok >= 2 AS c4, n_ok, coalesce(k.n_events, 0) AS weight, k.y FROM k JOIN (SELECT datetime, instrument, count(*) FILTER (ok) AS n_ok FROM st GROUP BY 1, 2) q USING (datetime, instrument))"""


@query(f"WITH {_STEPS} SELECT datetime, instrument, step, ok, round(CASE WHEN ok THEN CAST(n_events AS FLOAT) ELSE -1.0 END, 2) + 0.0 AS f_n_events, round(CASE WHEN ok THEN CAST(CAST(val AS FLOAT) AS DOUBLE) ELSE -1.0 END, 2) + 0.0 AS f_val FROM st")
def sequence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _bundle(spark, sf_dir).select("datetime", "instrument", F.posexplode(F.arrays_zip("step_mask", "X")).alias("step", "s"))
    return steps.select("datetime", "instrument", F.col("step").cast("bigint").alias("step"), F.col("s.step_mask").alias("ok"), *[(F.round(F.element_at("s.X", i + 1).cast("double"), 2) + F.lit(0.0)).alias(f"f_{n}") for i, n in enumerate(("n_events", "val"))])


@query(f"WITH {_STEPS} SELECT count(*) AS n_samples, count(*) FILTER (c1 AND c3 AND c4) AS n_valid, round(avg(CAST(c1 AND c3 AND c4 AS DOUBLE)), 6) AS coverage, 5 AS lookback, 2 AS n_features, round(avg(n_ok), 3) AS mean_valid_steps, CAST(-1.0 AS DOUBLE) AS fill_value, count(*) FILTER (NOT c1) AS invalid_by_label_available, CAST(0 AS BIGINT) AS invalid_by_provided_mask, count(*) FILTER (NOT c3) AS invalid_by_tradable_on_decision_date, count(*) FILTER (NOT c4) AS invalid_by_enough_valid_steps FROM bn")
def bundle_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.describe(_bundle(spark, sf_dir), fill=-1.0)


@query(f"WITH {_STEPS} SELECT round(sum(CAST(CAST(y AS FLOAT) AS DOUBLE) * weight) FILTER (c1 AND c3 AND c4) / sum(weight) FILTER (c1 AND c3 AND c4), 4) + 0.0 AS masked_mean FROM bn")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor.masked_mean(_bundle(spark, sf_dir), "y", "mask", "weight").withColumn("masked_mean", F.round("masked_mean", 4) + F.lit(0.0))


@query(f"WITH {_STEPS} SELECT datetime, instrument, round(CASE WHEN ok THEN CAST(n_events AS FLOAT) ELSE -1.0 END, 2) + 0.0 AS n_events, round(CASE WHEN ok THEN CAST(CAST(val AS FLOAT) AS DOUBLE) ELSE -1.0 END, 2) + 0.0 AS val FROM st WHERE step = 4")
def flatten_last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tensor.flatten_last_step(_bundle(spark, sf_dir), ["n_events", "val"], fill=-1.0)
    return flat.withColumns({c: F.round(c, 2) + F.lit(0.0) for c in ("n_events", "val")})


# ---- keys, sources -----------------------------------------------------------------------------


@query("SELECT CAST(ts AS DATE) AS datetime, user_id AS instrument, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.duplicate_keys(read(spark, sf_dir, "events").select(F.to_date("ts").alias("datetime"), F.col("user_id").alias("instrument")))


@query(f"WITH {B_SQL} SELECT datetime, count(*) AS n FROM b WHERE val IS NOT NULL GROUP BY 1 HAVING count(*) >= 10")
def support_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.support_filter(user_day(spark, sf_dir), ["val"], 10).groupBy("datetime").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B_SQL} SELECT 2 * count(*) AS n_cells, round(avg(CAST(val IS NULL AS DOUBLE)), 6) AS missing_rate FROM b")
def missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.missing_rate(user_day(spark, sf_dir), ["val", "n_events"]).withColumn("missing_rate", F.round("missing_rate", 6))


@query(f"WITH {B_SQL} SELECT min(datetime) AS first_date, max(datetime) AS last_date, count(DISTINCT datetime) AS n_dates, count(DISTINCT instrument) AS n_instruments, count(*) AS n_rows, round(avg(CAST(val IS NULL AS DOUBLE)), 6) AS missing_rate FROM b")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.inventory(user_day(spark, sf_dir), ["val"]).withColumn("missing_rate", F.round("missing_rate", 6))


@query("SELECT datetime, instrument, round(sum(value), 4) + 0.0 AS val FROM (SELECT CAST(ts AS DATE) AS datetime, user_id AS instrument, value FROM events) WHERE datetime BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' AND instrument IN (1, 2, 3, 5, 8) GROUP BY 1, 2")
def field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of a few instruments in a range of dates: what the scan is for."""
    return store.field_scan(user_day_rows(spark, sf_dir), [1, 2, 3, 5, 8], ["val"], "2024-01-05", "2024-01-10").withColumn("val", F.round("val", 4) + F.lit(0.0))


@query("SELECT list_filter([CASE WHEN lo > DATE '1900-01-01' THEN 'starts before the first day' END, CASE WHEN hi < DATE '2999-12-31' THEN 'ends after the last day' END, CASE WHEN n = 0 THEN 'no rows' END], lambda x: x IS NOT NULL) AS problems FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi, count(*) FILTER (CAST(ts AS DATE) BETWEEN DATE '1900-01-01' AND DATE '2999-12-31') AS n FROM events)")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.domain_check(user_day_rows(spark, sf_dir), "1900-01-01", "2999-12-31")


@query(f"WITH {A_SQL} SELECT datetime, pos FROM cal")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.calendar(read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("datetime")))


@query(f"WITH {A_SQL} SELECT datetime, instrument, qty FROM a")
def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_month(spark, sf_dir).select("datetime", "instrument", "qty")


# ---- audits ------------------------------------------------------------------------------------


_PROBED = """
x AS (SELECT datetime, pos, instrument, qty AS x0, {altered} AS x1 FROM a),
z AS (
  SELECT instrument, pos, CASE WHEN count(x0) OVER w >= 6 THEN (x0 - avg(x0) OVER w) / nullif(stddev_samp(x0) OVER w, 0) END AS r0,
    CASE WHEN count(x1) OVER w >= 6 THEN (x1 - avg(x1) OVER w) / nullif(stddev_samp(x1) OVER w, 0) END AS r1,
    (x0 - avg({first}) OVER i) / nullif(stddev_samp({first}) OVER i, 0) AS g0, (x1 - avg(x1) OVER i) / nullif(stddev_samp(x1) OVER i, 0) AS g1
  FROM x WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), i AS (PARTITION BY instrument))
SELECT count(*) FILTER (NOT (r0 IS NOT DISTINCT FROM r1 OR coalesce(abs(r0 - r1) <= {atol}, false))) AS moved_past, count(*) FILTER (NOT (g0 IS NOT DISTINCT FROM g1 OR coalesce(abs(g0 - g1) <= {atol}, false))) AS leaky_moves FROM z WHERE {where}"""


def _probe(spark: SparkSession, sf_dir: str, probe, **kwargs) -> DataFrame:
    """Cells that move of a causal score and of its negative control, which sees the whole sample."""
    panel = supplier_month(spark, sf_dir)
    moved = lambda name, f: probe(panel, "qty", f, "z", **kwargs).agg(F.count(F.lit(1)).alias(name))
    causal = moved("moved_past", lambda d: normalize.roll_z(d, "qty", "z", length=12, min_periods=6))
    return causal.crossJoin(F.broadcast(moved("leaky_moves", lambda d: normalize.global_z(d, "qty", "z", allow_leaky=True))))  # one row each


@query(f"WITH {A_SQL}, " + _PROBED.format(altered="CASE WHEN pos <= 30 THEN qty WHEN (pos - 30) % 2 = 1 THEN NULL ELSE 1e6 END", first="x0", atol="1e-12", where="pos = 30"))
def causality_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir, audit.causality_probe, position=30)


@query(f"WITH {A_SQL}, " + _PROBED.format(altered="CASE WHEN pos < 40 THEN qty ELSE 1e9 END", first="CASE WHEN pos < 40 THEN x0 END", atol="0", where="pos < 40"))
def prefix_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir, audit.prefix_invariance, keep=40)


@query(f"WITH {B_SQL}, o AS (SELECT r.b, datetime AS source, row_number() OVER (PARTITION BY r.b ORDER BY md5('7|' || r.b || '|' || CAST(datetime AS VARCHAR))) - 1 AS dst FROM bcal CROSS JOIN (VALUES (1), (2), (3)) r(b)) SELECT o.b, c.datetime, o.source FROM o JOIN bcal c ON c.pos = o.dst")
def permute_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.date_permutation(grid.calendar(user_day_rows(spark, sf_dir)), 7, [1, 2, 3])


@query(f"WITH {A_SQL} SELECT CAST(k AS INTEGER) AS fold, datetime, pos, CASE WHEN pos >= floor(k * n / 5) AND pos < floor((k + 1) * n / 5) THEN 'test' WHEN pos >= floor(k * n / 5) - 1 AND pos < floor((k + 1) * n / 5) + greatest(1, ceil(n * 0.01)) THEN 'purged' ELSE 'train' END AS role FROM cal CROSS JOIN (SELECT count(*) AS n FROM cal) CROSS JOIN range(5) r(k)")
def purged_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.purged_kfold(calendar(spark, sf_dir), 5, 1)


# a free intercept and two features: the centred normal equations with 1 added to their diagonal
_RIDGE_OOS = f"""WITH {A_SQL}, {_PAIRS},
fo AS (SELECT CAST(k AS INTEGER) AS fold, floor(n * (k + 1) / 4) - 1 AS ends, floor(n * (k + 1) / 4) AS lo, floor(n * (k + 2) / 4) AS hi FROM range(3) r(k), (SELECT count(*) AS n FROM cal)),
rw AS (SELECT datetime, instrument, score AS x, CAST(pos AS DOUBLE) AS t, label AS y FROM pairs JOIN cal USING (datetime) WHERE score IS NOT NULL AND label IS NOT NULL),
tr AS (SELECT fold, x, t, y FROM rw JOIN fo ON t < ends),
mn AS (SELECT fold, avg(x) AS mx, avg(t) AS mt, avg(y) AS my FROM tr GROUP BY 1),
sm AS (SELECT fold, any_value(mx) AS mx, any_value(mt) AS mt, any_value(my) AS my, sum((x - mx) * (x - mx)) + 1 AS xx, sum((t - mt) * (t - mt)) + 1 AS tt, sum((x - mx) * (t - mt)) AS xt, sum((x - mx) * (y - my)) AS xy, sum((t - mt) * (y - my)) AS ty FROM tr JOIN mn USING (fold) GROUP BY 1)
SELECT fold, datetime, instrument, round(my + (xy * tt - ty * xt) / (xx * tt - xt * xt) * (x - mx) + (ty * xx - xy * xt) / (xx * tt - xt * xt) * (t - mt), 6) + 0.0 AS score, round(y, 6) + 0.0 AS label
FROM rw JOIN fo ON t >= lo AND t < hi JOIN sm USING (fold)"""


@query(_RIDGE_OOS)
def ridge_oos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _design(spark, sf_dir)
    n = calendar(spark, sf_dir).count()
    return rounded(audit.ridge_oos(rows, ["score", "trend"], audit.expanding_folds(n, 3, 1)), "score", "label")


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("trend", F.col("pos").cast("double"))


@query()
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.leakage_audit(_design(spark, sf_dir), ["score"], calendar(spark, sf_dir), radius=1, min_obs=MIN_OBS)
    return spark.createDataFrame([(found["verdict"], found["observed_ic"], found["shuffle_mean_ic"], found["p_value"], found["n_permutations"])], "verdict string, observed_ic double, shuffle_mean_ic double, p_value double, n_permutations int")


# ---- portfolios --------------------------------------------------------------------------------

_BUCKETS = f"{A_SQL}, {_PAIRS}, f AS (SELECT * FROM pairs WHERE score IS NOT NULL AND label IS NOT NULL), q AS (SELECT datetime, label, CAST(least(5, ceil(5 * ({_RANK.format(x='score')}) / count(*) OVER (PARTITION BY datetime))) AS INTEGER) AS bucket FROM f), bk AS (SELECT datetime, bucket, count(*) AS n, avg(label) AS ret FROM q GROUP BY 1, 2)"


def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.quantile_returns(_pairs(spark, sf_dir), 5)


@query(f"WITH {_BUCKETS} SELECT datetime, bucket, n, round(ret, 6) + 0.0 AS ret FROM bk")
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_quantiles(spark, sf_dir), "ret")


@query(f"WITH {_BUCKETS} SELECT datetime, round(spread, 6) + 0.0 AS spread FROM (SELECT datetime, max(CASE WHEN bucket = 5 THEN ret END) - max(CASE WHEN bucket = 1 THEN ret END) AS spread FROM bk GROUP BY 1) WHERE spread IS NOT NULL")
def long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.long_short(_quantiles(spark, sf_dir), 5), "spread")


_WEIGHTS = f"{A_SQL}, {_PAIRS}, h AS (SELECT c.pos, p.datetime, p.instrument, p.label, p.score IS NOT NULL AND row_number() OVER (PARTITION BY p.datetime ORDER BY p.score DESC NULLS LAST, p.instrument) <= 5 AS held FROM pairs p JOIN cal c USING (datetime)), wt AS (SELECT pos, datetime, instrument, label, CASE WHEN held THEN 1.0::DOUBLE / count(*) FILTER (held) OVER (PARTITION BY datetime) ELSE 0.0 END AS weight FROM h), d AS (SELECT datetime, weight - coalesce(lag(weight) OVER (PARTITION BY instrument ORDER BY pos), 0) AS d FROM wt)"


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.topk_weights(_pairs(spark, sf_dir), 5)


@query(f"WITH {_WEIGHTS} SELECT datetime, round(sum(abs(d)) / 2, 6) + 0.0 AS one_side, round(sum(abs(d)), 6) + 0.0 AS gross, round(sum(abs(d)) / 2 * 12, 6) + 0.0 AS annual FROM d GROUP BY 1")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.turnover(_weights(spark, sf_dir), periods_per_year=12), "one_side", "gross", "annual")


@query(f"WITH {_WEIGHTS} SELECT datetime, round(sum(CASE WHEN d > 0 THEN d * 0.0007 WHEN d < 0 THEN -d * 0.0017 ELSE 0 END), 8) + 0.0 AS cost FROM d GROUP BY 1")
def trading_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.trading_cost(_weights(spark, sf_dir), buy=0.0005, sell=0.0015, slippage=0.0002).withColumn("cost", F.round("cost", 8) + F.lit(0.0))


_RET = f"{_WEIGHTS}, rt AS (SELECT datetime, sum(weight * coalesce(label, 0)) AS ret FROM wt GROUP BY 1), w AS (SELECT datetime, exp(sum(ln(1 + ret)) OVER (ORDER BY datetime)) AS wealth FROM rt)"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).groupBy("datetime").agg(F.sum(F.col("weight") * F.coalesce("label", F.lit(0.0))).alias("ret"))


@query(f"WITH {_RET} SELECT datetime, round(ln(wealth), 6) + 0.0 AS log_wealth, round(wealth / greatest(1, max(wealth) OVER (ORDER BY datetime)) - 1, 6) + 0.0 AS drawdown FROM w")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.drawdown(_returns(spark, sf_dir)).select("datetime", F.log("wealth").alias("log_wealth"), "drawdown"), "log_wealth", "drawdown")


@query(f"WITH {_RET}, dd AS (SELECT min(wealth / peak - 1) AS worst FROM (SELECT wealth, greatest(1, max(wealth) OVER (ORDER BY datetime)) AS peak FROM w)), m AS (SELECT count(ret) AS n, avg(ret) * 12 AS mean_annual, stddev_samp(ret) * sqrt(12) AS vol_annual FROM rt) SELECT n, round(mean_annual, 6) + 0.0 AS mean_annual, round(vol_annual, 6) + 0.0 AS vol_annual, round(mean_annual / vol_annual, 6) + 0.0 AS sharpe, round(worst, 6) + 0.0 AS max_drawdown, round(mean_annual / nullif(abs(worst), 0), 6) + 0.0 AS calmar FROM m, dd")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.performance(_returns(spark, sf_dir), periods_per_year=12), "mean_annual", "vol_annual", "sharpe", "max_drawdown", "calmar")


@query("SELECT p_partkey, CAST(floor(floor(p_size * 1000.0::DOUBLE / p_retailprice) / 100) * 100 AS BIGINT) AS shares FROM part")
def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("weight"), F.col("p_retailprice").alias("price"))
    return portfolio.lots(targets, nav=1000.0).select("p_partkey", "shares")


@query(f"WITH {A_SQL}, {_PAIRS}, f AS (SELECT datetime, score - avg(score) OVER w AS x, label - avg(label) OVER w AS y FROM pairs WHERE score IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY datetime)) SELECT datetime, count(*) AS n, round(sum(x * y) / nullif(sum(x * x), 0), 6) + 0.0 AS beta FROM f GROUP BY 1")
def beta_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.beta_by_date(_pairs(spark, sf_dir)), "beta")


_TESTS = "t AS (SELECT p_partkey AS name, p_size / 1000.0::DOUBLE AS p FROM part)"


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") / F.lit(1000.0)).alias("p"))


@query(f"WITH {_TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t) SELECT name, round(p, 6) + 0.0 AS p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC)), 6) + 0.0 AS p_bh FROM r")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.benjamini_hochberg(_tests(spark, sf_dir)), "p", "p_bh")


@query(f"WITH {_TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t) SELECT name, round(p, 6) + 0.0 AS p, round(least(1, max(p * (m - k + 1)) OVER (ORDER BY k)), 6) + 0.0 AS p_holm FROM r")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.holm(_tests(spark, sf_dir)), "p", "p_holm")


@query()
def diebold_mariano(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _ic(spark, sf_dir).select("datetime", F.col("ic").alias("a")).join(ic.pearson_ic(_pairs(spark, sf_dir), min_obs=MIN_OBS).select("datetime", F.col("ic").alias("b")), "datetime")
    return inference.diebold_mariano(pairs, "a", "b", horizon=1)


# values of two decimals in up to 31 days have no covariance midway between two numbers of seven decimals
@query(f"WITH {B_SQL}, x AS (SELECT * FROM b WHERE val IS NOT NULL) SELECT p.instrument AS a, q.instrument AS b, count(*) AS n, round(covar_samp(p.val, q.val), 7) + 0.0 AS cov FROM x p JOIN x q USING (datetime) WHERE p.instrument <= q.instrument GROUP BY 1, 2 HAVING count(*) >= 5")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.covariance(user_day(spark, sf_dir), "val", min_obs=5).withColumn("cov", F.round("cov", 7) + F.lit(0.0))


_LW = f"""
{B_SQL}, x0 AS (SELECT datetime, instrument, val - avg(val) OVER (PARTITION BY instrument) AS x FROM b),
x AS (SELECT datetime, instrument, coalesce(x, 0) AS x FROM x0 WHERE instrument IN (SELECT instrument FROM x0 WHERE x IS NOT NULL)),
q AS (SELECT count(*) AS t, sum(q * q) AS q2 FROM (SELECT sum(x * x) AS q FROM x GROUP BY datetime)),
s AS (SELECT p.instrument AS a, r.instrument AS b, sum(p.x * r.x) / max(t) AS s FROM x p JOIN x r USING (datetime), q WHERE p.instrument <= r.instrument GROUP BY 1, 2),
m AS (SELECT sum(CASE WHEN a = b THEN s * s ELSE 2 * s * s END) AS s2, sum(s) FILTER (a = b) AS tr, count(*) FILTER (a = b) AS n FROM s),
k AS (SELECT least(1, greatest(0, (q2 / (t * t) - s2 / t) / nullif(s2 - tr * tr / n, 0))) AS delta, tr / n AS level FROM m, q),
lw AS (SELECT a, b, (1 - delta) * s + CASE WHEN a = b THEN delta * level ELSE 0 END AS cov, delta FROM s, k)
"""


@query(f"WITH {_LW} SELECT a, b, round(cov, 4) + 0.0 AS cov, round(delta, 6) + 0.0 AS delta FROM lw")
def ledoit_wolf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.ledoit_wolf(user_day(spark, sf_dir), "val"), "delta").withColumn("cov", F.round("cov", 4) + F.lit(0.0))


@query(f"WITH {_LW}, e AS (SELECT datetime, instrument, 1.0::DOUBLE / count(*) OVER (PARTITION BY datetime) AS w FROM b WHERE val IS NOT NULL), v AS (SELECT p.datetime, sqrt(sum(p.w * r.w * cov * CASE WHEN a = b THEN 1 ELSE 2 END)) AS vol FROM lw JOIN e p ON p.instrument = a JOIN e r ON r.instrument = b AND r.datetime = p.datetime GROUP BY 1) SELECT datetime, instrument, round(w * 10 / vol, 6) + 0.0 AS weight FROM e JOIN v USING (datetime)")
def volatility_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = user_day(spark, sf_dir)
    held = panel.where("val is not null").select("datetime", "instrument", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("datetime"))).alias("weight"))
    return rounded(risk.volatility_target(held, risk.shrunk(panel, "val"), 10.0), "weight")


# the same three operators over the growth of suppliers, by month
_GROWTH = f"{A_SQL}, gw AS (SELECT datetime, instrument, {_lab(1)} AS val FROM a)"
_LW_GROWTH = _LW.replace(B_SQL, _GROWTH + " ").replace("FROM b)", "FROM gw)")
_HELD_GROWTH = "e AS (SELECT datetime, instrument, 1.0::DOUBLE / count(*) OVER (PARTITION BY datetime) AS w FROM gw WHERE val IS NOT NULL), v AS (SELECT p.datetime, sqrt(sum(p.w * r.w * cov * CASE WHEN a = b THEN 1 ELSE 2 END)) AS vol FROM lw JOIN e p ON p.instrument = a JOIN e r ON r.instrument = b AND r.datetime = p.datetime GROUP BY 1)"


def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.forward_return(supplier_month(spark, sf_dir), labels.LabelSpec(field="qty"), "val").select("datetime", "instrument", "val")


@query(f"WITH {_GROWTH}, x AS (SELECT * FROM gw WHERE val IS NOT NULL) SELECT p.instrument AS a, q.instrument AS b, count(*) AS n, round(covar_samp(p.val, q.val), 6) + 0.0 AS cov FROM x p JOIN x q USING (datetime) WHERE p.instrument <= q.instrument GROUP BY 1, 2 HAVING count(*) >= 5")
def covariance_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.covariance(_growth(spark, sf_dir), "val", min_obs=5), "cov")


@query(f"WITH {_LW_GROWTH} SELECT a, b, round(cov, 6) + 0.0 AS cov, round(delta, 6) + 0.0 AS delta FROM lw")
def ledoit_wolf_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.ledoit_wolf(_growth(spark, sf_dir), "val"), "cov", "delta")


@query(f"WITH {_LW_GROWTH}, {_HELD_GROWTH} SELECT datetime, instrument, round(w * 0.1 / vol, 6) + 0.0 AS weight FROM e JOIN v USING (datetime)")
def volatility_target_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _growth(spark, sf_dir)
    held = normalize.with_date_figures(panel.where("val is not null"), _n=F.count(F.lit(1))).select("datetime", "instrument", (1.0 / F.col("_n")).alias("weight"))
    return rounded(risk.volatility_target(held, risk.shrunk(panel, "val"), 0.1), "weight")


_CSCV = f"""
{_BUCKETS}, tr AS (SELECT datetime, bucket, ret FROM bk WHERE ret IS NOT NULL),
gd AS (SELECT datetime, (row_number() OVER (ORDER BY datetime) - 1) * 16 // count(*) OVER () AS g FROM (SELECT DISTINCT datetime FROM tr)),
gs AS (SELECT bucket, g, sum(ret) AS s, count(*) AS n FROM tr JOIN gd USING (datetime) GROUP BY 1, 2),
mk AS (SELECT CAST(range AS INTEGER) AS split FROM range(65536) WHERE bit_count(CAST(range AS INTEGER)) = 8),
cs AS (SELECT split, bucket, sum(s) FILTER ((split >> g) & 1 = 1) / sum(n) FILTER ((split >> g) & 1 = 1) AS ins, sum(s) FILTER ((split >> g) & 1 = 0) / sum(n) FILTER ((split >> g) & 1 = 0) AS oos FROM gs, mk GROUP BY 1, 2),
cv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ins DESC, bucket) AS r, median(oos) OVER (PARTITION BY split) AS med FROM cs WHERE ins IS NOT NULL AND oos IS NOT NULL) WHERE r = 1)
"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantiles(spark, sf_dir).select("datetime", F.col("bucket").alias("trial"), "ret")


@query(f"WITH {_CSCV} SELECT split, bucket AS best, round(oos, 6) + 0.0 AS oos, round(med, 6) + 0.0 AS median FROM cv")
def cscv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.cscv(_trials(spark, sf_dir)), "oos", "median")


@query(f"WITH {_CSCV} SELECT count(*) AS n_splits, round(avg(CASE WHEN oos < med THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS pbo FROM cv")
def pbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.pbo(_trials(spark, sf_dir)), "pbo")


_SOFT = f"{A_SQL}, {_PAIRS}, k AS (SELECT *, {_RANK.format(x='label')} AS rl, count(*) OVER (PARTITION BY datetime) AS n FROM pairs WHERE score IS NOT NULL AND label IS NOT NULL), sr AS (SELECT p.datetime, p.instrument, p.rl, p.n, sum(1 / (1 + exp((o.score - p.score) / 0.5))) AS soft FROM k p JOIN k o USING (datetime) GROUP BY 1, 2, 3, 4)"


@query(f"WITH {_SOFT} SELECT datetime, instrument, round(soft, 6) + 0.0 AS soft_rank, round(-(soft - avg(soft) OVER w) / nullif(stddev_samp(soft) OVER w, 0) * (rl - avg(rl) OVER w) / nullif(stddev_samp(rl) OVER w, 0) / n, 6) + 0.0 AS loss FROM sr WINDOW w AS (PARTITION BY datetime)")
def soft_rank_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.soft_rank_loss(_pairs(spark, sf_dir), 0.5), "soft_rank", "loss")


@query()
def copula_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.copula_loss(_pairs(spark, sf_dir)), "loss")


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 110_000.0).alias("u"))


_SHARES = "u AS (SELECT l_extendedprice / 110000.0::DOUBLE AS u FROM lineitem)"


@query(f"WITH {_SHARES} SELECT CAST(least(19, floor(u * 20)) AS INTEGER) AS bin, count(*) AS n FROM u WHERE u BETWEEN 0 AND 1 GROUP BY 1")
def pit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.pit_histogram(_probabilities(spark, sf_dir), "u")


@query(f"WITH {_SHARES}, r AS (SELECT u, row_number() OVER (ORDER BY u) AS k, count(*) OVER () AS n FROM u WHERE u BETWEEN 0 AND 1) SELECT max(n) AS n, round(max(greatest(k / n::DOUBLE - u, u - (k - 1) / n::DOUBLE)), 6) + 0.0 AS ks FROM r")
def ks_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.ks_uniform(_probabilities(spark, sf_dir), "u"), "ks")


@query(f"WITH {_SHARES} SELECT level, count(*) AS n, round(avg(CASE WHEN u >= (1 - level) / 2 AND u <= (1 + level) / 2 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS covered FROM u, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) l(level) WHERE u IS NOT NULL GROUP BY 1")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.interval_coverage(_probabilities(spark, sf_dir), "u"), "covered")


_NET = f"{_WEIGHTS}, dd AS (SELECT datetime, instrument, weight * coalesce(label, 0) AS g, weight - coalesce(lag(weight) OVER (PARTITION BY instrument ORDER BY pos), 0) AS d FROM wt)"


@query(f"WITH {_NET}, n AS (SELECT datetime, sum(g) AS gross, sum(CASE WHEN d > 0 THEN d * 0.0007 ELSE -d * 0.0017 END) AS cost FROM dd GROUP BY 1) SELECT datetime, round(gross, 6) + 0.0 AS gross, round(cost, 6) + 0.0 AS cost, round(gross - cost, 6) + 0.0 AS net FROM n")
def net_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.net_returns(_weights(spark, sf_dir), buy=0.0007, sell=0.0017), "gross", "cost", "net")


@query(f"WITH {_NET}, t AS (SELECT datetime, sum(g) AS g, sum(abs(d) * 0.1 * 0.02 * sqrt(abs(d) / 1e6)) AS k FROM dd GROUP BY 1), c AS (SELECT amount, avg(g - sqrt(amount) * k) / nullif(stddev_samp(g - sqrt(amount) * k), 0) * sqrt(12) AS ir FROM t, (VALUES (0.0::DOUBLE), (1e6), (1e8), (1e10)) a(amount) GROUP BY 1) SELECT amount, round(ir, 6) + 0.0 AS ir, ir >= 0.5 * max(ir) FILTER (amount = 0) OVER () AS holds FROM c")
def capacity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _weights(spark, sf_dir).withColumns({"sigma": F.lit(0.02), "adv": F.lit(1e6)})
    return rounded(portfolio.capacity_curve(held, [1e6, 1e8, 1e10], eta=0.1, periods_per_year=12), "ir")


# ---- segments, residuals, trials, generated panels ---------------------------------------------

_SEGMENTS = config.Segments(("1992-01-01", "1995-12-31"), ("1996-01-01", "1996-12-31"), ("1997-01-01", "1998-06-30"), purge_radius=2)
_ROLE = "SELECT datetime, pos, CASE WHEN datetime BETWEEN DATE '1992-01-01' AND DATE '1995-12-31' THEN 'train' WHEN datetime BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN 'valid' WHEN datetime BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' THEN 'test' END AS role FROM cal"


@query(f"WITH {A_SQL}, sg AS ({_ROLE}), st AS (SELECT min(pos) FILTER (role = 'valid') AS v, min(pos) FILTER (role = 'test') AS t FROM sg) SELECT datetime, pos, CASE WHEN role = 'train' AND (coalesce(pos >= v - 2, false) OR coalesce(pos >= t - 2, false)) OR role = 'valid' AND coalesce(pos >= t - 2, false) THEN 'purged' ELSE role END AS role FROM sg, st")
def segment_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.segment_roles(calendar(spark, sf_dir), _SEGMENTS)


@query(f"WITH {_IC}, d AS (SELECT pos - lag(pos) OVER (ORDER BY pos) AS d FROM ic JOIN cal USING (datetime)) SELECT count(*) AS n, round(avg(d), 6) + 0.0 AS mean_gap, round(12 / avg(d), 6) + 0.0 AS per_year FROM d")
def mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = _ic(spark, sf_dir).select("datetime").join(calendar(spark, sf_dir), "datetime")
    return rounded(inference.mean_gap(dated, periods_per_year=12), "mean_gap", "per_year")


@query(f"WITH {A_SQL}, {_PAIRS}, f AS (SELECT datetime, instrument, score - avg(score) OVER w AS x, label - avg(label) OVER w AS y FROM pairs WHERE score IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY datetime)), r AS (SELECT datetime, instrument, y - coalesce(sum(x * y) OVER w / nullif(sum(x * x) OVER w, 0), 0) * x AS e FROM f WINDOW w AS (PARTITION BY datetime)) SELECT datetime, instrument, round(r.e, 6) + 0.0 AS residual FROM pairs LEFT JOIN r USING (datetime, instrument)")
def residualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.residualize(_pairs(spark, sf_dir), "label", ["score"]).select("datetime", "instrument", "residual"), "residual")


_DATED = f"{A_SQL}, {_PAIRS}, k AS (SELECT datetime, instrument, label, avg(label) OVER w AS mean, stddev_samp(label) OVER w AS sd, score IS NOT NULL AS on_ FROM pairs WINDOW w AS (PARTITION BY datetime))"


@query(f"WITH {_DATED}, l AS (SELECT on_, 0.5 * ln(2 * pi()) + ln(sd) + 0.5 * pow((label - mean) / sd, 2) AS nll FROM k WHERE label IS NOT NULL AND sd > 0) SELECT count(*) AS n, round(avg(nll), 6) + 0.0 AS objective FROM l WHERE on_")
def masked_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean Gaussian loss of the labels by their date's own mean and deviation, where there is a score."""
    dated = normalize.with_date_figures(_pairs(spark, sf_dir), mean=F.avg("label"), sd=F.stddev_samp("label")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")))
    return rounded(inference.masked_mean_nll(inference.gaussian_nll(dated.withColumn("on", F.col("score").isNotNull()), "label", "mean", "sd"), "nll", "on"), "objective")


@query(f"WITH {_DATED}, l AS (SELECT on_, lgamma(2.5) - lgamma(3) + 0.5 * ln(pi() * 5) + ln(sd) + 3 * ln(1 + pow((label - mean) / sd, 2) / 5) AS nll FROM k WHERE label IS NOT NULL AND sd > 0) SELECT count(*) AS n, round(avg(nll), 6) + 0.0 AS objective FROM l WHERE on_")
def masked_student_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Student's distribution with five degrees of freedom."""
    dated = normalize.with_date_figures(_pairs(spark, sf_dir), mean=F.avg("label"), sd=F.stddev_samp("label")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd"))).withColumn("nu", F.lit(5.0))
    return rounded(inference.masked_mean_nll(inference.student_nll(dated.withColumn("on", F.col("score").isNotNull()), "label", "mean", "sd", "nu"), "nll", "on"), "objective")


@query(f"WITH {_BUCKETS}, c AS (SELECT bucket AS trial, ret - avg(ret) OVER (PARTITION BY bucket) AS d, ret FROM bk) SELECT trial, count(ret) AS n, round(avg(ret) / stddev_samp(ret), 6) + 0.0 AS sharpe, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) + 0.0 AS skew, round(avg(d * d * d * d) / pow(avg(d * d), 2), 6) + 0.0 AS kurt FROM c GROUP BY 1")
def trial_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.trial_moments(_trials(spark, sf_dir)), "sharpe", "skew", "kurt")


@query(f"WITH {_BUCKETS}, rr AS (SELECT p.bucket AS a, o.bucket AS b, corr(p.ret, o.ret) AS rho FROM bk p JOIN bk o USING (datetime) WHERE p.bucket < o.bucket AND p.ret IS NOT NULL AND o.ret IS NOT NULL GROUP BY 1, 2) SELECT (SELECT count(DISTINCT bucket) FROM bk) AS m, (SELECT count(DISTINCT bucket) FROM bk) - (SELECT count(DISTINCT b) FROM rr WHERE rho >= 0.4 AND NOT isnan(rho)) AS k_eff")
def effective_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.effective_trials(_trials(spark, sf_dir), redundant=0.4)


@query()
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.deflated_sharpe(_trials(spark, sf_dir))


def _like_the_suppliers(spark: SparkSession, sf_dir: str, correlation: float) -> synthetic.PanelSpec:
    """A generated panel with as many instruments and dates as the tables have suppliers and months."""
    shape = read(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey").alias("names"), F.count_distinct(F.trunc("l_shipdate", "month")).alias("dates")).first()
    return synthetic.PanelSpec(instruments=shape.names, days=shape.dates, correlation=correlation)


@query()
def synthetic_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rank ICs of a generated panel of the tables' shape come out as its copula says."""
    spec = _like_the_suppliers(spark, sf_dir, 0.3)
    got = ic.rank_ic(synthetic.generate(spark, spec), min_obs=3)
    return got.agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("mean_ic"), (F.abs(F.avg("ic") - spec.copula_rank_ic) <= 4 * F.stddev_samp("ic") / F.sqrt(F.count("ic"))).alias("near_truth"))


@query()
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.ground_truth(spark, _like_the_suppliers(spark, sf_dir, 0.05))


_TRAIN = "tr AS (SELECT val FROM b WHERE val IS NOT NULL AND datetime < DATE '2024-01-15'), f0 AS (SELECT median(val) AS m FROM tr), f1 AS (SELECT any_value(m) AS m, 1.4826022 * median(abs(val - m)) AS s FROM tr, f0)"


@query(f"WITH {B_SQL}, {_TRAIN} SELECT datetime, instrument, round(CASE WHEN val IS NULL OR s = 0 OR s IS NULL THEN 0.0 ELSE greatest(-3.0, least(3.0, (val - m) / s)) END, 6) + 0.0 AS val FROM b, f1")
def fitted_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = user_day(spark, sf_dir)
    fitted = normalize.fit_robust(panel.where("datetime < DATE '2024-01-15'"), ["val"])
    return rounded(normalize.apply_robust(panel, fitted, ["val"], fill=0.0).select("datetime", "instrument", "val"), "val")


def queries() -> dict[str, Query]:
    from . import studies  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import studies  # noqa: F401

    return dict(SQL)
