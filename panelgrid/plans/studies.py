"""Registered queries of whole studies: folds and paths, resampling, rolling risk, attribution, sessions, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.functions import text
from panelgrid.operators import attribution as parts
from panelgrid.operators import audit, bootstrap, detect, folds, grid, hac, ic, inference, optimize, processors, risk, selection
from panelgrid.operators.portfolio import topk_weights
from panelgrid.streaming import stateful

from .panels import A_SQL, B_SQL, read, supplier_month, user_day
from .queries import _BUCKETS, _G, _IC, _KEPT, _NET, _NW, _PAIRS, _RANK, _TRAIN, _U_IC, MIN_OBS, _corr, _ic, _pairs, _quantiles, _weights, calendar
from .registry import query, rounded

GROUPS, TESTED, RADIUS = 6, 2, 1

# ---- folds -------------------------------------------------------------------------------------

_GROUPS = f"""
sz AS (SELECT count(*) AS n FROM cal),
gr AS (SELECT range AS g, floor(range * n / {GROUPS}) AS lo, floor((range + 1) * n / {GROUPS}) AS hi, greatest({RADIUS}, ceil(n * 0.01)) AS after FROM range({GROUPS}), sz),
sp AS (SELECT CAST(range AS INTEGER) AS split FROM range({2**GROUPS}) WHERE bit_count(CAST(range AS INTEGER)) = {TESTED})"""
_COMBINED = f"""{_GROUPS},
cf AS (
  SELECT split, datetime, pos, CASE WHEN bool_or(pos >= lo AND pos < hi) THEN 'test' WHEN bool_or(pos >= lo - {RADIUS} AND pos < hi + after) THEN 'purged' ELSE 'train' END AS role
  FROM cal, sp JOIN gr ON (split >> g) & 1 = 1 GROUP BY 1, 2, 3)"""
_PATHS = """
pt AS (
  SELECT CAST(row_number() OVER (PARTITION BY datetime ORDER BY split) - 1 AS INTEGER) AS path, datetime, pos, CAST(g AS INTEGER) AS "group", split
  FROM cal JOIN gr ON pos >= lo AND pos < hi JOIN sp ON (split >> g) & 1 = 1)"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.combinatorial_folds(calendar(spark, sf_dir), GROUPS, TESTED, RADIUS)


@query(f"WITH {A_SQL}, {_COMBINED} SELECT split, datetime, pos, role FROM cf")
def combinatorial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir)


@query(f'WITH {A_SQL}, {_GROUPS}, {_PATHS} SELECT path, datetime, pos, "group", split FROM pt')
def backtest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.backtest_paths(calendar(spark, sf_dir), GROUPS, TESTED)


@query(f"WITH {_IC}, {_COMBINED} SELECT split, count(*) AS n_dates, round(avg(ic), 6) + 0.0 AS ic FROM ic JOIN cf USING (datetime) WHERE role = 'test' GROUP BY 1")
def fold_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.fold_ic(_pairs(spark, sf_dir), _combined(spark, sf_dir), "split", min_obs=MIN_OBS), "ic")


_K_FOLDS = "kf AS (SELECT CAST(k AS INTEGER) AS fold, datetime FROM cal, (SELECT count(*) AS n FROM cal), range(5) r(k) WHERE pos >= floor(k * n / 5) AND pos < floor((k + 1) * n / 5))"


@query(f"WITH {_IC}, {_K_FOLDS}, fi AS (SELECT fold, avg(ic) AS ic FROM ic JOIN kf USING (datetime) GROUP BY 1) SELECT count(*) AS n_folds, round(avg(ic), 6) + 0.0 AS mean, round(min(ic), 6) + 0.0 AS min, round(max(ic), 6) + 0.0 AS max, round(stddev_samp(ic), 6) + 0.0 AS std FROM fi")
def fold_ic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ics = folds.fold_ic(_pairs(spark, sf_dir), folds.purged_kfold(calendar(spark, sf_dir), 5, RADIUS), "fold", min_obs=MIN_OBS)
    return rounded(folds.spread_of_folds(ics), "mean", "min", "max", "std")


# one feature and a free intercept: slope = Sxy / (Sxx + 1)
_RIDGE = f"""
tr AS (SELECT split, score, label FROM pairs JOIN cf USING (datetime) WHERE role = 'train' AND score IS NOT NULL AND label IS NOT NULL),
ml AS (SELECT split, avg(score) AS mx, avg(label) AS my FROM tr GROUP BY 1),
rd AS (SELECT split, any_value(mx) AS mx, any_value(my) AS my, sum((score - mx) * (label - my)) / (sum((score - mx) * (score - mx)) + 1) AS beta FROM tr JOIN ml USING (split) GROUP BY 1),
os AS (SELECT split, datetime, my + beta * (score - mx) AS score, label FROM pairs JOIN cf USING (datetime) JOIN rd USING (split) WHERE role = 'test' AND score IS NOT NULL AND label IS NOT NULL)"""


@query(f"WITH {A_SQL}, {_PAIRS}, {_COMBINED}, {_RIDGE}, t AS (SELECT split, datetime, avg(score) AS score, sum(label) AS label, count(*) AS n FROM os GROUP BY 1, 2) SELECT split, datetime, n, round(score, 6) + 0.0 AS score, round(label, 6) + 0.0 AS label FROM t")
def combinatorial_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).groupBy(F.col("fold").alias("split"), "datetime")
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.sum("label").alias("label")), "score", "label")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ridge_oos(_pairs(spark, sf_dir), ["score"], _combined(spark, sf_dir))


_RANKED = "CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY split, datetime ORDER BY {x}) + (count(*) OVER (PARTITION BY split, datetime, {x}) - 1) / 2.0::DOUBLE END"


@query(
    f"""WITH {A_SQL}, {_PAIRS}, {_COMBINED}, {_PATHS}, {_RIDGE},
rk AS (SELECT split, datetime, {_RANKED.format(x='score')} AS x, {_RANKED.format(x='label')} AS y, count(*) OVER (PARTITION BY split, datetime) AS c FROM os),
si AS (SELECT split, datetime, corr(x, y) AS ic FROM rk WHERE c >= {MIN_OBS} GROUP BY 1, 2)
SELECT path, count(*) AS n_dates, round(avg(ic), 6) + 0.0 AS ic FROM pt JOIN si USING (split, datetime) WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY 1"""
)
def path_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(folds.oos_path_ic(_scored(spark, sf_dir), backtest_paths(spark, sf_dir), min_obs=MIN_OBS), "ic")


# ---- resampling --------------------------------------------------------------------------------

SEED, MEAN_BLOCK = 3, 2  # one and a half horizons of one, rounded up
_HEX = "CAST('0x' || substr(md5('{seed}|' || b || '|' || {place}), {first}, 12) AS BIGINT)"
_NUMBERED = "num AS (SELECT row_number() OVER (ORDER BY datetime) - 1 AS t, count(*) OVER () AS n, ic AS x FROM ic)"


def _at(place: str, first: int = 1) -> str:
    return _HEX.format(seed=SEED, place=place, first=first)


_STATIONARY = f"""{_NUMBERED},
dr AS (SELECT b, t, n, {_at('t')} % n AS start, t = 0 OR {_at('t', 13)} < {16**12 // MEAN_BLOCK} AS begins FROM range({bootstrap.REPLICATES}) r(b), num),
ru AS (SELECT b, t, n, last_value(CASE WHEN begins THEN t END IGNORE NULLS) OVER w AS began, last_value(CASE WHEN begins THEN start END IGNORE NULLS) OVER w AS start FROM dr WINDOW w AS (PARTITION BY b ORDER BY t)),
ix AS (SELECT b, t, (start + t - began) % n AS i FROM ru)"""
_CIRCULAR = f"{_NUMBERED}, ix AS (SELECT b, t, ({_at(f'CAST(floor(t / {MEAN_BLOCK}) AS BIGINT)')} + t % {MEAN_BLOCK}) % n AS i FROM range({bootstrap.REPLICATES}) r(b), num)"
_IID = f"{_NUMBERED}, ix AS (SELECT b, t, {_at('t')} % n AS i FROM range({bootstrap.REPLICATES}) r(b), num)"
_MEANS = "SELECT b, round(avg(x), 6) + 0.0 AS mean FROM ix JOIN (SELECT t AS i, x FROM num) USING (i) GROUP BY 1"


def _bootstrap(name: str, method: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(bootstrap.means(_ic(spark, sf_dir), col="ic", method=method, mean_block=MEAN_BLOCK, seed=SEED), "mean")

    run.__name__ = name
    query(f"WITH {_IC}, {sql} {_MEANS}")(run)


_bootstrap("stationary_bootstrap", "stationary", _STATIONARY)
_bootstrap("block_bootstrap", "circular_block", _CIRCULAR)
_bootstrap("iid_bootstrap", "iid", _IID)


@query(
    f"""WITH {_IC}, {_STATIONARY}, mm AS (SELECT b, avg(x) AS mean FROM ix JOIN (SELECT t AS i, x FROM num) USING (i) GROUP BY 1), ob AS (SELECT count(*) AS n, avg(x) AS o FROM num)
SELECT max(n) AS n, count(*) AS replicates, round(max(o), 6) + 0.0 AS mean, round(stddev_samp(mean), 6) + 0.0 AS se, round(quantile_cont(mean, 0.025), 6) + 0.0 AS lo, round(quantile_cont(mean, 0.975), 6) + 0.0 AS hi,
  round(avg(CASE WHEN abs(mean - o) >= abs(o) THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS p_value FROM mm, ob"""
)
def bootstrap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bootstrap.summary(_ic(spark, sf_dir), col="ic", mean_block=MEAN_BLOCK, seed=SEED), "mean", "se", "lo", "hi", "p_value")


# the automatic length of blocks, of a series bs (t, n, x)
def _block_sql(shrink: float) -> str:
    return f"""
bp AS (SELECT max(n) AS n, greatest(5, ceil(sqrt(log10(max(n))))) AS run, 2 * sqrt(log10(max(n)) / max(n)) AS bound FROM bs),
bl AS (SELECT *, least(ceil(sqrt(n)) + run, n - 1) AS last FROM bp),
bu AS (SELECT t, x - avg(x) OVER () AS u FROM bs),
bg AS (SELECT p.t - o.t AS l, sum(p.u * o.u) / any_value(n) AS gamma FROM bu p JOIN bu o ON p.t >= o.t JOIN bl ON p.t - o.t <= last GROUP BY 1),
bq AS (SELECT l, abs(gamma / (SELECT gamma FROM bg WHERE l = 0)) < bound AS quiet FROM bg, bl WHERE l > 0),
bm AS (SELECT coalesce((SELECT min(k) FROM range(10000) r(k), bl WHERE k < last AND NOT EXISTS (SELECT 1 FROM bq WHERE l > k AND l <= k + run AND NOT quiet)), any_value(last)) AS m FROM bl),
bt AS (SELECT least(2 * greatest(m, 1), last) AS top FROM bm, bl),
bw2 AS (SELECT sum(CASE WHEN l > 0 THEN 2 * least(1, 2 * (1 - l / top)) * l * gamma END) AS g, sum(CASE WHEN l = 0 THEN gamma ELSE 2 * least(1, 2 * (1 - l / top)) * gamma END) AS level FROM bg, bt WHERE l <= top),
mb AS (SELECT least(greatest(pow(2 * g * g / ({shrink} * level * level), 1.0::DOUBLE / 3) * pow(n, 1.0::DOUBLE / 3), 1), ceil(least(3 * sqrt(n), n / 3))) AS mb FROM bw2, bp)"""


_IC_SERIES = "bs AS (SELECT row_number() OVER (ORDER BY datetime) - 1 AS t, count(*) OVER () AS n, ic AS x FROM ic)"


@query(f"WITH {_IC}, {_IC_SERIES}, {_block_sql(4 / 3)} SELECT round(mb, 6) + 0.0 AS block FROM mb")
def block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.createDataFrame([(inference.block_length(_ic(spark, sf_dir), col="ic"),)], "block double"), "block")


@query(f"WITH {_IC}, {_IC_SERIES}, {_block_sql(2)} SELECT round(mb, 6) + 0.0 AS block FROM mb")
def stationary_block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spark.createDataFrame([(inference.block_length(_ic(spark, sf_dir), col="ic", method="stationary"),)], "block double"), "block")


# dates with all five buckets, their spread's block length, and the replicates' bucket means
_MONO = f"""{_BUCKETS},
fd AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS t, count(*) OVER () AS n, hi - lo AS x FROM (SELECT datetime, max(CASE WHEN bucket = 5 THEN ret END) AS hi, max(CASE WHEN bucket = 1 THEN ret END) AS lo FROM bk GROUP BY 1 HAVING count(ret) = 5)),
bs AS (SELECT t, n, x FROM fd), {_block_sql(2)},
num AS (SELECT t, n FROM fd), {_STATIONARY.removeprefix(_NUMBERED + ',').replace(f'< {16**12 // MEAN_BLOCK}', f'< floor({16**12} / (SELECT mb FROM mb))')},
rm AS (SELECT b, bucket, avg(ret) AS m FROM ix JOIN fd ON fd.t = ix.i JOIN bk USING (datetime) GROUP BY 1, 2),
om AS (SELECT bucket, avg(ret) AS o, any_value(fd.n) AS n FROM fd JOIN bk USING (datetime) GROUP BY 1),
og AS (SELECT min(d) AS gap FROM (SELECT o - lag(o) OVER (ORDER BY bucket) AS d FROM om)),
rg AS (SELECT b, min(d) AS gap FROM (SELECT b, (m - o) - lag(m - o) OVER (PARTITION BY b ORDER BY bucket) AS d FROM rm JOIN om USING (bucket)) GROUP BY 1),
rs AS (SELECT b, max(CASE WHEN bucket = 5 THEN m END) - max(CASE WHEN bucket = 1 THEN m END) AS spread, corr(bucket, k) AS rho FROM (SELECT *, rank() OVER (PARTITION BY b ORDER BY m) + (count(*) OVER (PARTITION BY b, m) - 1) / 2.0::DOUBLE AS k FROM rm) GROUP BY 1)"""


@query(
    f"""WITH {_MONO}
SELECT (SELECT max(n) FROM om) AS n, round((SELECT gap FROM og), 6) + 0.0 AS gap, round((SELECT avg(CASE WHEN rg.gap >= og.gap THEN 1.0::DOUBLE ELSE 0 END) FROM rg, og), 6) + 0.0 AS p_mono,
  round((SELECT max(CASE WHEN bucket = 5 THEN o END) - max(CASE WHEN bucket = 1 THEN o END) FROM om), 6) + 0.0 AS spread, round(quantile_cont(spread, 0.025), 6) + 0.0 AS spread_lo, round(quantile_cont(spread, 0.975), 6) + 0.0 AS spread_hi,
  round((SELECT corr(bucket, k) FROM (SELECT bucket, rank() OVER (ORDER BY o) AS k FROM om)), 6) + 0.0 AS spearman, round(quantile_cont(rho, 0.025), 6) + 0.0 AS spearman_lo, round(quantile_cont(rho, 0.975), 6) + 0.0 AS spearman_hi FROM rs"""
)
def monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = _quantiles(spark, sf_dir)
    block = inference.block_length(inference.long_short(buckets, 5), col="spread", method="stationary")
    tested = selection.monotonicity(buckets, 5, mean_block=block, seed=SEED)
    return rounded(tested, *[c for c in tested.columns if c != "n"])


@query()
def monotonicity_studentized(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = _quantiles(spark, sf_dir)
    block = inference.block_length(inference.long_short(buckets, 5), col="spread")
    return selection.monotonicity_studentized(buckets, 5, replicates=bootstrap.REPLICATES, block=max(1, round(block)), seed=SEED)


# ---- intervals, weighted buckets ---------------------------------------------------------------

_SUMMARY = f"""{_U_IC}, {_G.format(s='s')},
o AS (SELECT count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic), nw AS (SELECT any_value(variance) AS variance, any_value(bw) AS bw FROM v)"""


@query(
    f"WITH {_SUMMARY} SELECT n AS n_periods, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(mean / std, 6) + 0.0 AS icir, round(mean / std * sqrt(12), 6) + 0.0 AS icir_ann, "
    "round(mean / (sqrt(variance / n) * sqrt(n / (n - 2.0::DOUBLE))), 6) + 0.0 AS t_nw, CAST(bw AS BIGINT) AS nw_bandwidth, "
    "round(mean - 1.959963984540054 * sqrt(variance / n) * sqrt(n / (n - 2.0::DOUBLE)), 6) + 0.0 AS ci_low, round(mean + 1.959963984540054 * sqrt(variance / n) * sqrt(n / (n - 2.0::DOUBLE)), 6) + 0.0 AS ci_high FROM o, nw"
)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the record but its p-value, for which DuckDB has no function."""
    return rounded(hac.ic_summary(_ic(spark, sf_dir), periods_per_year=12).drop("p_nw"), "mean", "std", "icir", "icir_ann", "t_nw", "ci_low", "ci_high")


@query()
def hac_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of both references, of one series."""
    tested = hac.confidence_interval(hac.both_references(_ic(spark, sf_dir)))
    return tested.select("reference", "n_obs", "mean", "standard_error", "p_value", "ci_low", "ci_high")


_RIVALS = f"{A_SQL}, {_PAIRS}, {_KEPT}, ic0 AS ({_corr('rs', 'rl', 'ranks')}), ip AS ({_corr('score', 'label', 'ranks')}), q AS (SELECT datetime, x.ic * x.ic - y.ic * y.ic AS ic FROM ic0 x JOIN ip y USING (datetime) WHERE x.ic IS NOT NULL AND y.ic IS NOT NULL), s AS (SELECT row_number() OVER (ORDER BY datetime) AS i, ic - avg(ic) OVER () AS u, avg(ic) OVER () AS mean, count(*) OVER () AS n FROM q)"


@query(f"WITH {_RIVALS}, {_G.format(s='s')} {_NW.format(s='s', var='variance', more='').replace('round(variance, 6)', 'round(variance, 9)').replace('round(mean, 6)', 'round(mean, 9)').replace('round(se, 6)', 'round(se, 9)')}")
def loss_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of two signals' squared ICs, all but its p-value."""
    both = _ic(spark, sf_dir).select("datetime", F.col("ic").alias("a")).join(ic.pearson_ic(_pairs(spark, sf_dir), min_obs=MIN_OBS).select("datetime", F.col("ic").alias("b")), "datetime")
    tested = inference.diebold_mariano(both, "a", "b", horizon=1, p_value=False).select("n_obs", "bandwidth", "mean", "variance", "standard_error", "t_stat")
    return rounded(tested, "t_stat").withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("mean", "variance", "standard_error")})


_VALUED = f"""{A_SQL}, {_PAIRS}, f AS (
  SELECT datetime, instrument, score, label, lag(n_lines) OVER (PARTITION BY instrument ORDER BY pos) AS w FROM pairs JOIN a USING (datetime, instrument)),
q AS (SELECT datetime, label, coalesce(w, 0) AS w, CAST(least(5, ceil(5 * ({_RANK.format(x='score')}) / count(*) OVER (PARTITION BY datetime))) AS INTEGER) AS bucket FROM f WHERE score IS NOT NULL AND label IS NOT NULL)"""


@query(f"WITH {_VALUED} SELECT datetime, bucket, count(*) AS n, round(sum(w * label) / nullif(sum(w), 0), 6) + 0.0 AS ret FROM q GROUP BY 1, 2")
def quantile_returns_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets weighted by each supplier's number of lines in the month before."""
    sized = _pairs(spark, sf_dir).join(supplier_month(spark, sf_dir).select("datetime", "instrument", "n_lines"), grid.KEYS)
    return rounded(inference.quantile_returns(sized, 5, weight="n_lines"), "ret")


# ---- rolling risk ------------------------------------------------------------------------------


# quantities are whole: over up to 12 months no covariance lies midway between two numbers of six decimals
@query(
    f"""WITH {A_SQL}, p AS (SELECT x.datetime, x.pos, x.instrument AS a, y.instrument AS b, CASE WHEN y.qty IS NOT NULL THEN x.qty END AS u, CASE WHEN x.qty IS NOT NULL THEN y.qty END AS w FROM a x JOIN a y USING (pos) WHERE x.instrument <= y.instrument),
c AS (SELECT datetime, pos, a, b, count(u) OVER r AS n, covar_samp(u, w) OVER r AS cov FROM p WINDOW r AS (PARTITION BY a, b ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT datetime, pos, a, b, n, round(cov, 6) + 0.0 AS cov FROM c WHERE n >= 6"""
)
def rolling_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.rolling_covariance(supplier_month(spark, sf_dir), "qty", length=12, min_obs=6), "cov")


@query()
def mean_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the last month with scores: expected growth in proportion to the score, shrunk covariance of growth, from the
    weights of the top five the month before. The gap to the best objective is that of the returned weights."""
    # the panel is read by several jobs; what is kept has no more partitions than its rows need
    parts = max(spark.sparkContext.defaultParallelism, -(-read(spark, sf_dir, "lineitem").count() // grid.TASK_ROWS))
    panel = _pairs(spark, sf_dir, parts).persist()
    try:
        return _rebalanced(panel)
    finally:
        panel.unpersist()


def _rebalanced(panel: DataFrame) -> DataFrame:
    last = panel.where("score is not null").agg(F.max("pos")).first()[0]
    now = panel.where(F.col("pos") == last).select("instrument", (0.02 * F.coalesce("score", F.lit(0.0))).alias("mu"), F.col("score").isNotNull().alias("tradable"))
    before = topk_weights(panel.where(F.col("pos") == last - 1), 5).select("instrument", F.col("weight").alias("previous"))
    names = now.join(before, "instrument", "left").withColumns({"lower": F.lit(0.0), "upper": F.lit(0.2)})
    cov = risk.shrunk(panel.where(F.col("pos") < last - 1).select("datetime", "instrument", "label"), "label", keep=True)
    try:
        found = optimize.mean_variance(names, cov, optimize.Program(risk_aversion=2.0, shrinkage=0.1, turnover=1.5))
    finally:
        cov.rows.unpersist()
    number = lambda x: F.nanvl(F.lit(x), F.lit(None).cast("double"))
    return found.weights.withColumns({"status": F.lit(found.status), "gap": number(found.gap), "objective": number(found.objective)})


# ---- attribution and gates ---------------------------------------------------------------------

BUY, SELL = 0.0007, 0.0017
_PARTS = f"""{_NET},
g AS (SELECT s_suppkey AS instrument, r_name AS region, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
one AS (
  SELECT datetime, coalesce(region, 'unassigned') AS region, coalesce(nation, 'unassigned') AS nation, CAST(g AS DECIMAL(38, 14)) AS gross,
    CAST(CASE WHEN d > 0 THEN d * {BUY}::DOUBLE ELSE -d * {SELL}::DOUBLE END AS DECIMAL(38, 14)) AS cost, CAST(coalesce(label / count(label) OVER (PARTITION BY datetime), 0) AS DECIMAL(38, 14)) AS benchmark
  FROM dd JOIN (SELECT datetime, instrument, label FROM wt) USING (datetime, instrument) LEFT JOIN g USING (instrument)),
pa AS (
  SELECT datetime, CAST(2 - grouping(region) - grouping(nation) AS INTEGER) AS level, region, nation, count(*) AS n, sum(gross) AS gross, sum(cost) AS cost, sum(gross) - sum(cost) AS net, sum(benchmark) AS benchmark, sum(gross) - sum(cost) - sum(benchmark) AS active
  FROM one GROUP BY GROUPING SETS ((datetime), (datetime, region), (datetime, region, nation)))"""
_FIGURES = ("gross", "cost", "net", "benchmark", "active")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    groups = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("instrument"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return parts.contributions(_weights(spark, sf_dir), groups, ["region", "nation"], buy=BUY, sell=SELL)


@query(f"WITH {_PARTS} SELECT datetime, level, region, nation, n, " + ", ".join(f"round(CAST({c} AS DOUBLE), 8) + 0.0 AS {c}" for c in _FIGURES) + " FROM pa")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double"), 8) + F.lit(0.0) for c in _FIGURES})


@query(f"WITH {_PARTS} SELECT level, region, nation, count(*) AS n_obs, round(avg(CAST(active AS DOUBLE)), 8) + 0.0 AS mean FROM pa GROUP BY 1, 2, 3")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = parts.attribution(_parts(spark, sf_dir), ["region", "nation"], p_value=False)
    return tested.select("level", "region", "nation", "n_obs", (F.round("mean", 8) + F.lit(0.0)).alias("mean"))


@query()
def attribution_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same means with their Newey-West tests."""
    return parts.attribution(_parts(spark, sf_dir), ["region", "nation"])


#: What _NET adds to the panel and its pairs.
_NET_ONLY = _NET.removeprefix(f"{A_SQL}, {_PAIRS}, ")
_TURNED = "tu AS (SELECT avg(t) AS turnover_annual FROM (SELECT sum(abs(d)) / 2 * 12 AS t FROM dd GROUP BY datetime))"
_GATE_ROWS = ", ".join(f"({k}, '{c}', '{f}', {b}::DOUBLE, '{r}')" for k, (c, f, r, b) in enumerate(parts.GATES))


@query(
    f"""WITH {_SUMMARY}, {_NET_ONLY}, {_TURNED}, x AS (SELECT mean AS mean_ic, mean / (sqrt(variance / n) * sqrt(n / (n - 2.0::DOUBLE))) AS t_nw, mean / std * sqrt(12) AS icir_ann, turnover_annual FROM o, nw, tu),
e AS (SELECT criterion, figure, bound, rule, CASE figure WHEN 'mean_ic' THEN mean_ic WHEN 't_nw' THEN t_nw WHEN 'icir_ann' THEN icir_ann WHEN 'turnover_annual' THEN turnover_annual END AS value FROM x, (VALUES {_GATE_ROWS}) g(k, criterion, figure, bound, rule))
SELECT criterion, figure, round(value, 6) + 0.0 AS value, bound, rule, CASE WHEN value IS NULL THEN 'not_evaluated' WHEN CASE rule WHEN '>=' THEN value >= bound ELSE value <= bound END THEN 'pass' ELSE 'fail' END AS status FROM e"""
)
def acceptance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criteria on mean IC, its test, its information ratio and turnover; the others count as not evaluated here."""
    from panelgrid.operators.portfolio import turnover

    one = hac.ic_summary(_ic(spark, sf_dir), periods_per_year=12).select(F.col("mean").alias("mean_ic"), "t_nw", "icir_ann")
    turned = turnover(_weights(spark, sf_dir), periods_per_year=12).agg(F.avg("annual").alias("turnover_annual"))
    return rounded(parts.evaluate_gates(one.crossJoin(F.broadcast(turned))), "value")  # one row each


# ---- sessions ----------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT user_id AS instrument, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM n)
SELECT instrument, min(ts) AS start, max(ts) AS last, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY instrument, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sessions(read(spark, sf_dir, "events"), "6 hours").withColumn("total", F.round("total", 4) + F.lit(0.0))


# ---- detectors ---------------------------------------------------------------------------------


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _detect_sql(table: str, key: str, text: str) -> str:
    family = lambda kind: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(line_text, {_sql_text(p)}) THEN '{n}' END" for k, n, _, p in detect.RULES if k == kind) + ")"
    value = f"trim(concat(regexp_extract(line_text, {_sql_text(detect.ASSIGNED)}, 1), regexp_extract(line_text, {_sql_text(detect.ASSIGNED)}, 2)))"
    return f"""
WITH t AS (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {table} WHERE {text} IS NOT NULL),
l AS (SELECT {key}, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS line_text FROM t),
r AS (
  SELECT {key}, line, unnest([{family('path')}, {family('secret')},
    CASE WHEN length({value}) >= {detect.LEAST_SECRET} AND NOT regexp_matches({value}, {_sql_text(detect.PLACEHOLDER)}) THEN 'hardcoded-credential-assignment' END,
    CASE WHEN len(list_filter(regexp_extract_all(line_text, {_sql_text(detect.EMAIL)}), lambda a: NOT regexp_matches(a, {_sql_text(detect.NOBODY)}))) > 0 THEN 'personal-identifier-email' END]) AS rule FROM l)
SELECT {key}, CAST(line AS INTEGER) AS line, rule FROM r WHERE rule IS NOT NULL"""


@query(_detect_sql("documents", "doc_id", "text"))
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.find(read(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


@query(_detect_sql("pages", "page_id", "html"))
def detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.find(read(spark, sf_dir, "pages"), id_col="page_id", text_col="html")


# ---- texts, digests, chains of processors ------------------------------------------------------


@query(
    f"""SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha256, md5(t) AS md5 FROM (
  SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), ''), {_sql_text(text.SPACES.replace(chr(92) + 'x0B', chr(92) + 'v') + '+(' + chr(92) + 'n|$)')}, '{chr(92)}1', 'g'), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents)"""
)
def tidy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidied = read(spark, sf_dir, "documents").select("doc_id", text.tidy(F.col("text")).alias("t"))
    return tidied.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), text.digests(F.col("t").cast("binary")).alias("d")).select("doc_id", "n_chars", "d.*")


@query(r"SELECT page_id, CASE WHEN s = '' THEN 'document' ELSE s END AS stem FROM (SELECT page_id, trim(regexp_replace(url, '[^0-9A-Za-z\x{4e00}-\x{9fff}._-]+', '_', 'g'), '_') AS s FROM pages)")
def page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.safe_stem(F.col("url")).alias("stem"))


_CHAIN = [
    {"class": "RobustZScoreNorm", "kwargs": {"fields_group": "feature", "clip_outlier": True}},
    {"class": "Fillna", "kwargs": {"fields_group": "feature"}},
    {"class": "DropnaLabel"},
    {"class": "CSRankNorm", "kwargs": {"fields_group": "label"}},
]


@query(
    f"""WITH {B_SQL}, {_TRAIN}, l AS (SELECT datetime, instrument, val, lead(val) OVER (PARTITION BY instrument ORDER BY pos) AS label FROM b),
c AS (SELECT datetime, instrument, coalesce(CASE WHEN s <> 0 AND val IS NOT NULL THEN greatest(-3.0, least(3.0, (val - m) / s)) END, 0.0) AS val, label AS x FROM l, f1 WHERE label IS NOT NULL)
SELECT datetime, instrument, round(val, 6) + 0.0 AS val, round(({_RANK.format(x='x')}) / (count(x) OVER (PARTITION BY datetime) + 1.0::DOUBLE), 6) + 0.0 AS label FROM c"""
)
def processor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study's chain over user days: features fitted before mid-January, labels of the next day."""
    panel = user_day(spark, sf_dir).withColumn("label", F.lead("val").over(grid.by_name())).select("datetime", "instrument", "val", "label")
    apply = processors.fit_chain(_CHAIN, panel.where("datetime < DATE '2024-01-15'"), ["val"], "label")
    return rounded(apply(panel), "val", "label")
