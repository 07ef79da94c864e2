"""All queries on the derived panel by survey id, each with the SQL that an independent engine runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import gram as G
from ..operators import metrics as M
from ..operators import outputs as O
from ..operators import reports as R
from ..operators import signals as S
from ..operators import solve
from ..operators import walk as W
from ..sources import panel as P
from . import config

PANEL = """
daily AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS paid, sum(CAST(round(l_quantity * 100) AS BIGINT)) AS sold
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily),
dense AS (SELECT days.date, t.ticker, paid, sold FROM days CROSS JOIN (SELECT DISTINCT ticker FROM daily) t
          LEFT JOIN daily ON daily.date = days.date AND daily.ticker = t.ticker),
prices AS (SELECT date, ticker, close FROM (
             SELECT date, ticker, CAST(sum(paid) OVER w AS DOUBLE) / nullif(CAST(sum(sold) OVER w AS DOUBLE), 0) AS close FROM dense
             WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW))
           WHERE isodow(date) < 6 AND date >= DATE '1995-04-03'),
mday AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS paid, count(*) AS n FROM orders GROUP BY 1),
mpx AS (SELECT * FROM (SELECT date, CAST(sum(paid) OVER w AS DOUBLE) / 100 / sum(n) OVER w AS px FROM mday
          WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW))
        WHERE isodow(date) < 6 AND date >= DATE '1995-04-03'),
market AS (SELECT * FROM (SELECT date, px / lag(px) OVER (ORDER BY date) - 1 AS mkt_ret FROM mpx) WHERE mkt_ret IS NOT NULL),
sectors AS (SELECT DISTINCT p_brand AS ticker, 'S' || CAST(floor((CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) - 1) / 5.0) AS INT) AS sector FROM part),
raw_ret AS (SELECT date, ticker, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM prices),
rets AS (SELECT date, ticker, ret FROM (SELECT *, count(ret) OVER (PARTITION BY date) AS known, count(*) OVER (PARTITION BY date) AS al FROM raw_ret) WHERE known = al),
fwd AS (SELECT date, ticker, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS fwd_ret FROM (
          SELECT date, ticker, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM (
            SELECT date, ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS px FROM prices))),
mom AS (SELECT date, ticker, lag(close, 21) OVER t / nullif(lag(close, 252) OVER t, 0) - 1 AS mom FROM prices WINDOW t AS (PARTITION BY ticker ORDER BY date))
"""


def _robust(source: str, x: str, name: str) -> str:
    """CTEs for the robust z-score of x of source, as name(date, ticker, score)."""
    return f"""{name}_m AS (SELECT *, median({x}) OVER (PARTITION BY date) AS m FROM {source}),
{name}_s AS (SELECT *, 1.4826 * median(abs({x} - m)) OVER (PARTITION BY date) AS s FROM {name}_m),
{name}_z AS (SELECT *, coalesce(CASE WHEN {x} IS NULL THEN NULL ELSE greatest(-3.0, least(3.0, ({x} - m) / (s + 1e-12))) END, 0) AS z FROM {name}_s),
{name} AS (SELECT date, ticker, CASE WHEN count({x}) OVER (PARTITION BY date) < 3 THEN 0.0 ELSE z - avg(z) OVER (PARTITION BY date) END AS score FROM {name}_z)"""


def _zpop(x: str) -> str:
    w = "OVER (PARTITION BY date)"
    return f"CASE WHEN count({x}) {w} < 3 OR stddev_pop({x}) {w} <= 0 THEN 0.0 ELSE coalesce(({x} - avg({x}) {w}) / (stddev_pop({x}) {w} + 1e-12), 0.0) END"


def _rank(x: str) -> str:
    return f"(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0)"


SIGNAL = _robust("mom", "mom", "signal")
RESID = """rj AS (SELECT r.date, r.ticker, r.ret, m.mkt_ret FROM rets r JOIN market m ON m.date = r.date),
rb AS (SELECT *, CASE WHEN count(ret) OVER w >= 50 THEN covar_pop(ret, mkt_ret) OVER w / nullif(var_samp(mkt_ret) OVER w, 0) END AS beta FROM rj
       WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
resid AS (SELECT date, ticker, ret - coalesce(beta, 0) * mkt_ret AS resid FROM rb)"""
MR = (
    RESID
    + """,
mv AS (SELECT date, ticker, resid / nullif(CASE WHEN count(resid) OVER w >= 12 THEN stddev_samp(resid) OVER w END, 0) AS v FROM resid
       WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
mraw AS (SELECT date, ticker, CASE WHEN count(v) OVER w >= 2 THEN -sum(v) OVER w END AS raw FROM mv
         WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
"""
    + _robust("mraw", "raw", "mrs")
)
IC = (
    SIGNAL
    + f""",
pairs AS (SELECT s.date, s.ticker, s.score, f.fwd_ret FROM signal s JOIN fwd f ON f.date = s.date AND f.ticker = s.ticker WHERE s.score IS NOT NULL AND f.fwd_ret IS NOT NULL),
ranked AS (SELECT date, {_rank("score")} AS x, {_rank("fwd_ret")} AS y, {_rank("score")} / count(*) OVER (PARTITION BY date) AS q, fwd_ret FROM pairs),
ic AS (SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic FROM ranked GROUP BY date HAVING count(*) >= 3),
ic1 AS (SELECT * FROM ic WHERE ic IS NOT NULL),
ls AS (SELECT date, avg(CASE WHEN q >= 0.9 THEN fwd_ret END) - avg(CASE WHEN q <= 0.1 THEN fwd_ret END) AS ls_ret FROM ranked GROUP BY date HAVING count(*) >= 20)"""
)
BOOK = (
    SIGNAL
    + """,
periods AS (SELECT last_day(date) AS period_end, ticker, product(1 + ret) - 1 AS period_ret FROM rets GROUP BY 1, 2),
wl AS (SELECT last_day(date) AS date, ticker, max_by(score, date) AS score FROM signal GROUP BY 1, 2),
weights AS (SELECT date, ticker, coalesce(2.0 * score / nullif(sum(abs(score)) OVER (PARTITION BY date), 0), 0) AS weight FROM wl),
turn AS (SELECT date, sum(change) AS turnover FROM (SELECT date, abs(weight - coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY date), 0)) AS change FROM weights) GROUP BY 1),
gain AS (SELECT p.period_end, sum(w.weight * p.period_ret) AS gain FROM weights w JOIN periods p ON p.ticker = w.ticker AND p.period_end = last_day(w.date + INTERVAL 1 DAY) GROUP BY 1),
pnl AS (SELECT g.period_end, g.gain - t.turnover * 5 / 1e4 AS pnl FROM gain g JOIN turn t ON g.period_end = last_day(t.date + INTERVAL 1 DAY)),
eq AS (SELECT *, equity / max(equity) OVER (ORDER BY period_end) - 1 AS drawdown FROM (SELECT *, product(1 + pnl) OVER (ORDER BY period_end) AS equity FROM pnl)),
mper AS (SELECT last_day(date) AS period_end, product(1 + mkt_ret) - 1 AS mkt_period FROM market GROUP BY 1),
sb AS (SELECT ticker, CASE WHEN count(*) >= 5 THEN coalesce(covar_samp(ret, mkt_ret) / nullif(var_samp(mkt_ret), 0), 0) ELSE 0 END AS beta
       FROM rets r JOIN market m ON m.date = r.date GROUP BY 1)"""
)

QUERIES, ORACLE_SQL = {}, {}


def _lines(spark, d):
    """Lines as (date, ticker, close, load_seq); the place in the files is read before the join, which doesn't keep it."""
    seq = P.load_order(F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    lines = P.read(spark, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast("double").alias("close"), seq.alias("load_seq"))
    return lines.join(P.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("date", F.col("p_brand").alias("ticker"), "close", "load_seq")


def _signal(spark, d):
    return S.momentum_signal(P.prices(spark, d))


def _rets(spark, d):
    return S.returns(P.prices(spark, d))


def _resid(spark, d):
    return S.residuals(_rets(spark, d), P.market(spark, d))


def _weights(spark, d):
    return M.score_weights(_signal(spark, d))


def _pnl(spark, d):
    return M.portfolio_pnl(_weights(spark, d), M.period_returns(_rets(spark, d)))


def _ic(spark, d):
    return M.information_coefficient(_signal(spark, d), S.forward_returns(P.prices(spark, d)))


def _market_periods(spark, d):
    return P.market(spark, d).groupBy(F.last_day("date").alias("period_end")).agg((F.product(1 + F.col("mkt_ret")) - 1).alias("mkt_period"))


def _betas(spark, d):
    return M.static_betas(_rets(spark, d), P.market(spark, d))


def add(name: str, make, sql: str | None = None, ctes: str = "", rounds: str = "") -> None:
    """Register a query and its SQL; doubles named in rounds are rounded to 6 places on both sides."""
    columns = rounds.split()

    def run(spark, sf_dir):
        return make(spark, sf_dir).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns}) if columns else make(spark, sf_dir)

    QUERIES[name] = run
    if sql:
        head = f"WITH {PANEL}" + (f", {ctes} " if ctes else "")
        replace = " REPLACE (" + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns) + ")" if columns else ""
        ORACLE_SQL[name] = f"{head} SELECT *{replace} FROM ({sql})"


add("src1_prices", lambda s, d: P.load(P.prices(s, d), "1996-01-01", "1996-12-31"), "SELECT * FROM prices WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", rounds="close")
add("src12_sectors", P.sectors, "SELECT * FROM sectors")
add(
    "src14_hygiene",
    lambda s, d: P.hygiene(_lines(s, d), undated=True),
    "SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, min_by(CAST(l_extendedprice AS DOUBLE), l_orderkey * 100 + l_linenumber) AS close FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2",
    rounds="close",
)
add(
    "src16_missing_window", lambda s, d: P.missing_window(P.prices(s, d), "1995-01-02", "2001-12-31"),
    "SELECT ticker, CAST(CASE WHEN lo > DATE '1995-01-02' THEN DATE '1995-01-02' WHEN hi < DATE '2001-12-31' THEN hi + 1 END AS DATE) AS need_from, CAST(CASE WHEN hi < DATE '2001-12-31' THEN DATE '2001-12-31' WHEN lo > DATE '1995-01-02' THEN lo - 1 END AS DATE) AS need_to FROM (SELECT ticker, min(date) AS lo, max(date) AS hi FROM prices WHERE close IS NOT NULL GROUP BY 1)",
)
add("ts1_returns", _rets, "SELECT * FROM rets", rounds="ret")
add("ts2_forward_returns", lambda s, d: S.forward_returns(P.prices(s, d)), "SELECT * FROM fwd", rounds="fwd_ret")
add("ts3_ahead_5", lambda s, d: S.ahead(_rets(s, d), 5), "SELECT date, ticker, lead(ret, 5) OVER (PARTITION BY ticker ORDER BY date) AS fwd_ret FROM rets", rounds="fwd_ret")
add("ts4_trailing_mean", lambda s, d: S.trailing_mean(_rets(s, d)), "SELECT ticker, avg(ret) AS mean_ret FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM rets) WHERE r <= 21 GROUP BY 1", rounds="mean_ret")
W252 = "WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
add(
    "sg1_momentum_engine", lambda s, d: S.momentum_engine(_rets(s, d)),
    f"SELECT date, ticker, lag(p, 21) OVER (PARTITION BY ticker ORDER BY date) AS mom FROM (SELECT date, ticker, CASE WHEN count(ret) OVER w >= 252 THEN product(1 + ret) OVER w - 1 END AS p FROM rets {W252})", rounds="mom",
)
add("sg2_momentum_signal", _signal, "SELECT * FROM signal", SIGNAL, "score")
SECTOR_MOM = "ms AS (SELECT m.date, m.ticker, CASE WHEN count(mom) OVER (PARTITION BY m.date) < 3 THEN mom ELSE mom - avg(mom) OVER (PARTITION BY m.date, s.sector) END AS mom FROM mom m JOIN sectors s ON s.ticker = m.ticker), " + _robust("ms", "mom", "signal")
add("k8_sector_neutral_signal", lambda s, d: S.momentum_signal(P.prices(s, d), sectors=P.sectors(s, d)), "SELECT * FROM signal", SECTOR_MOM, "score")
add("sg3_momentum_12_1", lambda s, d: S.momentum_ratio(P.prices(s, d)), "SELECT * FROM mom", rounds="mom")
add("sg4_momentum_6_1", lambda s, d: S.momentum_ratio(P.prices(s, d), 21, 126), "SELECT date, ticker, lag(close, 21) OVER t / nullif(lag(close, 126) OVER t, 0) - 1 AS mom FROM prices WINDOW t AS (PARTITION BY ticker ORDER BY date)", rounds="mom")
add("sg5_residuals", _resid, "SELECT * FROM resid", RESID, "resid")
add("sg6_mean_reversion", lambda s, d: S.mean_reversion(_resid(s, d)), "SELECT * FROM mrs", MR, "score")
add(
    "sg7_blend", lambda s, d: S.blend(_signal(s, d), S.mean_reversion(_resid(s, d))),
    f"SELECT s.date, s.ticker, coalesce(b.score, 0) AS score FROM signal s LEFT JOIN (SELECT date, ticker, greatest(-3.0, least(3.0, {_zpop('b')})) AS score FROM (SELECT date, ticker, zp + 0.3 * zs AS b FROM (SELECT date, ticker, {_zpop('p')} AS zp, {_zpop('s')} AS zs FROM (SELECT a.date, a.ticker, a.score AS p, c.score AS s FROM signal a JOIN mrs c ON c.date = a.date AND c.ticker = a.ticker)))) b ON b.date = s.date AND b.ticker = s.ticker",
    SIGNAL + ", " + MR, "score",
)
add("k1_zscore", lambda s, d: K.z_pop(_rets(s, d), "ret", "z").select("date", "ticker", "z"), f"SELECT date, ticker, {_zpop('ret')} AS z FROM rets", rounds="z")
add(
    "k4_zscore_sample", lambda s, d: K.z_samp(_rets(s, d), "ret", "z").select("date", "ticker", "z"),
    "SELECT date, ticker, CASE WHEN coalesce(stddev_samp(ret) OVER w, 0) = 0 THEN 0.0 ELSE (ret - avg(ret) OVER w) / (stddev_samp(ret) OVER w + 1e-12) END AS z FROM rets WINDOW w AS (PARTITION BY date)", rounds="z",
)
add(
    "k5_winsorize", lambda s, d: K.winsorize(_rets(s, d), "ret", "z").select("date", "ticker", "z"),
    "SELECT date, ticker, CASE WHEN coalesce(stddev_samp(ret) OVER w, 0) = 0 THEN coalesce(ret, 0) ELSE greatest(-3.0, least(3.0, (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0))) END AS z FROM rets WINDOW w AS (PARTITION BY date)", rounds="z",
)
add("k3_robust_z", lambda s, d: K.robust_z(_rets(s, d), "ret", "score").select("date", "ticker", "score"), "SELECT * FROM rz", _robust("rets", "ret", "rz"), "score")
add("k7_sector_demean", lambda s, d: K.demean_by_sector(_rets(s, d).join(F.broadcast(P.sectors(s, d)), "ticker"), "ret", "demeaned").select("date", "ticker", "demeaned"), "SELECT r.date, r.ticker, ret - avg(ret) OVER (PARTITION BY r.date, sector) AS demeaned FROM rets r JOIN sectors s ON s.ticker = r.ticker", rounds="demeaned")
add("k9_percent_rank", lambda s, d: _rets(s, d).select("date", "ticker", K.percent_rank("ret").alias("q")), f"SELECT date, ticker, {_rank('ret')} / count(*) OVER (PARTITION BY date) AS q FROM rets", rounds="q")
add("k13_trade_pnl", lambda s, d: P.read(s, d, "orders").select("o_orderkey", K.trade_pnl(F.lit(100.0), 100 + F.col("o_orderkey") % 7, F.lit(10.0), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short")).alias("pnl")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 10.0 ELSE -10.0 END * ((100 + o_orderkey % 7) / CAST(100.0 AS DOUBLE) - 1) AS pnl FROM orders", rounds="pnl")
add("ts10_rolling_betas", lambda s, d: S.rolling_betas(_rets(s, d), P.market(s, d)), f"SELECT date, ticker, CASE WHEN count(ret) OVER w >= 252 THEN covar_pop(ret, mkt_ret) OVER w / nullif(var_samp(mkt_ret) OVER w, 0) END AS beta FROM rj {W252}", RESID, "beta")
add("cal2_period_returns", lambda s, d: M.period_returns(_rets(s, d)), "SELECT * FROM periods", BOOK, "period_ret")
add("cal5_monthly_ic", lambda s, d: _ic(s, d).groupBy(F.last_day("date").alias("period_end")).agg(F.avg("ic").alias("ic_mean")), "SELECT last_day(date) AS period_end, avg(ic) AS ic_mean FROM ic1 GROUP BY 1", IC, "ic_mean")
add("ag2_ic_spearman", _ic, "SELECT * FROM ic1", IC, "ic")
add(
    "ag4_ic_summary", lambda s, d: M.ic_summary(_ic(s, d)),
    "SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 0) AS ic_ir_ann, avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END) * 100 AS hit_rate_pct, count(*) AS n_days FROM ic1", IC, "ic_mean ic_std ic_ir_ann hit_rate_pct",
)
add("ag5_decile_ls", lambda s, d: M.decile_long_short(_signal(s, d), S.forward_returns(P.prices(s, d))), "SELECT * FROM ls WHERE ls_ret IS NOT NULL", IC, "ls_ret")
add(
    "ag6_ls_stats", lambda s, d: M.return_stats(M.decile_long_short(_signal(s, d), S.forward_returns(P.prices(s, d))), "ls_ret"),
    "SELECT avg(ls_ret) * 252 AS ann_ret, stddev_samp(ls_ret) * sqrt(252) AS ann_vol, coalesce(avg(ls_ret) * 252 / nullif(stddev_samp(ls_ret) * sqrt(252), 0), 0) AS sharpe, count(ls_ret) AS n_days FROM ls", IC, "ann_ret ann_vol sharpe",
)
STATS = "avg(pnl) * 12 AS ann_return, stddev_samp(pnl) * sqrt(12) AS ann_vol, coalesce(avg(pnl) * 12 / nullif(stddev_samp(pnl) * sqrt(12), 0), 0) AS sharpe, count(*) AS periods"
add("ag1_performance", lambda s, d: M.performance(_pnl(s, d), M.turnover(_weights(s, d))), f"SELECT * FROM (SELECT {STATS}, -min(drawdown) AS max_drawdown FROM eq) CROSS JOIN (SELECT avg(turnover) AS avg_turnover_per_rebalance, avg(turnover) * 12 AS ann_turnover FROM turn)", BOOK, "ann_return ann_vol sharpe max_drawdown avg_turnover_per_rebalance ann_turnover")
add("ag9_regimes", lambda s, d: M.by_regime(_pnl(s, d), _market_periods(s, d)), f"SELECT CASE WHEN coalesce(mkt_period, 0) >= 0 THEN 'UP' ELSE 'DOWN' END AS regime, {STATS} FROM pnl LEFT JOIN mper USING (period_end) GROUP BY 1", BOOK, "ann_return ann_vol sharpe")
add("ag12_binding", lambda s, d: M.binding(_weights(s, d), _betas(s, d)), "SELECT w.date, avg(CASE WHEN abs(weight) >= 0.1 - 1e-6 THEN 1.0 ELSE 0.0 END) AS pos_bind_rate, CAST(sum(abs(weight)) >= 2.0 - 1e-6 AS DOUBLE) AS gross_bind, sum(weight * coalesce(beta, 0)) AS beta_exposure, CAST(abs(sum(weight * coalesce(beta, 0))) >= 0.02 - 1e-6 AS DOUBLE) AS beta_bind FROM weights w LEFT JOIN sb ON sb.ticker = w.ticker GROUP BY 1", BOOK, "pos_bind_rate gross_bind beta_exposure beta_bind")
add("ag14_sector_exposure", lambda s, d: M.sector_exposure(_weights(s, d), P.sectors(s, d)), "SELECT date, sector, sum(weight) AS exposure FROM weights w JOIN sectors s ON s.ticker = w.ticker GROUP BY 1, 2", BOOK, "exposure")
add("ag17_static_betas", _betas, "SELECT * FROM sb", BOOK, "beta")
add("ag22_total_return", lambda s, d: _pnl(s, d).agg((F.product(1 + F.col("pnl")) - 1).alias("total")), "SELECT product(1 + pnl) - 1 AS total FROM pnl", BOOK, "total")
add("bt7_period_pnl", _pnl, "SELECT * FROM pnl", BOOK, "pnl")
add("ts6_drawdown", lambda s, d: M.equity(_pnl(s, d)), "SELECT * FROM eq", BOOK, "pnl equity drawdown")
add("ts7_rolling_sharpe", lambda s, d: M.rolling_sharpe(_pnl(s, d)), "SELECT period_end, CASE WHEN count(pnl) OVER w >= 12 THEN avg(pnl) OVER w / nullif(stddev_samp(pnl) OVER w, 0) * sqrt(12) END AS rolling_sharpe FROM pnl WINDOW w AS (ORDER BY period_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", BOOK, "rolling_sharpe")
add("ts9_turnover", lambda s, d: M.turnover(_weights(s, d)), "SELECT * FROM turn", BOOK, "turnover")
add("ag21_quantiles", lambda s, d: _rets(s, d).agg(F.percentile("ret", F.lit(0.05)).alias("q05"), F.percentile("ret", F.lit(0.95)).alias("q95")), "SELECT quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.95) AS q95 FROM rets", rounds="q05 q95")
COV = "SELECT a.ticker AS ticker_i, b.ticker AS ticker_j, {} AS c FROM {} a JOIN {} b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2"
# covariances of daily returns are near 1e-4: compared in units of 1e-4
SCALED = lambda df: df.withColumn("c", F.col("c") * 1e4)
EWMA = "wd AS (SELECT r.date, ticker, ret, (1 - 0.94) * pow(0.94, (SELECT count(DISTINCT date) FROM rets) - dense_rank() OVER (ORDER BY r.date)) AS w FROM rets r)"
add("rm2_sample_cov", lambda s, d: SCALED(M.covariance(_rets(s, d))), COV.format("covar_samp(a.ret, b.ret) * 1e4", "rets", "rets"), rounds="c")
add("rm3_ewma_cov", lambda s, d: SCALED(M.ewma_covariance(_rets(s, d))), COV.format("sum(a.w * a.ret * b.ret) * 1e4", "wd", "wd"), EWMA, "c")
add("rm9_ewma_cov_normalised", lambda s, d: SCALED(M.ewma_covariance(_rets(s, d), normalised=True)), COV.format("sum(a.w * a.ret * b.ret) / sum(a.w) * 1e4", "wd", "wd"), EWMA, "c")
# no eigenvalue of the panel's sample covariance is below its floor, so the repair must give it back
add("rm1_psd_repair", lambda s, d: SCALED(G.repaired_covariance(_rets(s, d))), COV.format("covar_samp(a.ret, b.ret) * 1e4", "rets", "rets"), rounds="c")
LW = "lc AS (SELECT date, ticker, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM rets), ls_ AS (" + COV.format("sum(a.x * b.x) / count(*)", "lc", "lc") + """),
ln AS (SELECT sum(CASE WHEN ticker_i = ticker_j THEN c END) AS trace, sum(c * c * CASE WHEN ticker_i = ticker_j THEN 1 ELSE 2 END) AS norm2, count(*) FILTER (ticker_i = ticker_j) AS p FROM ls_),
lq AS (SELECT sum(q * q) AS quads, count(*) AS n FROM (SELECT date, sum(x * x) AS q FROM lc GROUP BY 1)),
lsh AS (SELECT trace / p AS mean, least(norm2 / p - trace / p * trace / p, (quads / n - norm2) / (n * p)) / (norm2 / p - trace / p * trace / p) AS share FROM ln CROSS JOIN lq)"""
add("rm4_ledoit_wolf", lambda s, d: SCALED(G.ledoit_wolf(_rets(s, d))), "SELECT ticker_i, ticker_j, ((1 - share) * c + CASE WHEN ticker_i = ticker_j THEN share * mean ELSE 0 END) * 1e4 AS c FROM ls_ CROSS JOIN lsh", LW, "c")
add("qp1_optimal_weights", lambda s, d: solve.optimal_weights(_weights(s, d), G.sample_axes(_rets(s, d)), _betas(s, d)))


GRID = """gk AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM rets)),
gp AS (SELECT last_day(date) AS date, max(date) AS "asof", max(ord) AS ord FROM gk GROUP BY 1),
gl AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS DATE)) AS date FROM gp),
grid AS (SELECT gl.date, lead(gl.date) OVER (ORDER BY gl.date) AS next_date, row_number() OVER (ORDER BY gl.date) - 1 AS k,
         last_value("asof" IGNORE NULLS) OVER (ORDER BY gl.date) AS "asof", last_value(ord IGNORE NULLS) OVER (ORDER BY gl.date) AS ord FROM gl LEFT JOIN gp ON gp.date = gl.date)"""


def _grid(spark, d):
    return W.rebalance_grid(_rets(spark, d))


def _ic_of(signal: str, fwd: str, name: str) -> str:
    """CTEs for the daily rank correlation of signal with fwd, as name(date, ic)."""
    return f"""{name}_p AS (SELECT s.date, s.score, f.fwd_ret FROM {signal} s JOIN {fwd} f ON f.date = s.date AND f.ticker = s.ticker WHERE s.score IS NOT NULL AND f.fwd_ret IS NOT NULL),
{name}_r AS (SELECT date, {_rank("score")} AS x, {_rank("fwd_ret")} AS y FROM {name}_p),
{name} AS (SELECT * FROM (SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic FROM {name}_r GROUP BY date HAVING count(*) >= 3) WHERE ic IS NOT NULL)"""


SUMMARY = "avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 0) AS ic_ir_ann, avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END) * 100 AS hit_rate_pct, count(*) AS n_days"
CELLS = [(g, n) for g in (10, 21, 30) for n in (126, 189, 252)]
MOM_GRID = ", ".join(
    f"m{g}_{n} AS (SELECT date, ticker, lag(close, {g}) OVER t / nullif(lag(close, {n}) OVER t, 0) - 1 AS mom FROM prices WINDOW t AS (PARTITION BY ticker ORDER BY date)), " + _robust(f"m{g}_{n}", "mom", f"s{g}_{n}") + ", " + _ic_of(f"s{g}_{n}", "fwd", f"i{g}_{n}")
    for g, n in CELLS
)
add("ag7_momentum_grid", lambda s, d: R.momentum_grid(P.prices(s, d), S.forward_returns(P.prices(s, d))), " UNION ALL ".join(f"SELECT {g} AS gap, {n} AS lookback, {SUMMARY} FROM i{g}_{n}" for g, n in CELLS), MOM_GRID, "ic_mean ic_std ic_ir_ann hit_rate_pct")
add("so3_best_cell", lambda s, d: R.best(R.momentum_grid(P.prices(s, d), S.forward_returns(P.prices(s, d)))), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {g} AS gap, {n} AS lookback, {SUMMARY} FROM i{g}_{n}" for g, n in CELLS) + ") ORDER BY ic_ir_ann DESC, ic_mean DESC LIMIT 1", MOM_GRID, "ic_mean ic_std ic_ir_ann hit_rate_pct")
MR_GRID = RESID + ", mv AS (SELECT date, ticker, resid / nullif(CASE WHEN count(resid) OVER w >= 12 THEN stddev_samp(resid) OVER w END, 0) AS v FROM resid WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), "
MR_GRID += ", ".join(f"a{h} AS (SELECT date, ticker, lead(ret, {h}) OVER (PARTITION BY ticker ORDER BY date) AS fwd_ret FROM rets)" for h in (1, 3, 5)) + ", "
MR_GRID += ", ".join(
    f"w{n} AS (SELECT date, ticker, CASE WHEN count(v) OVER w >= {max(2, n // 2)} THEN -sum(v) OVER w END AS raw FROM mv WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)), " + _robust(f"w{n}", "raw", f"z{n}") + ", " + ", ".join(_ic_of(f"z{n}", f"a{h}", f"j{n}_{h}") for h in (1, 3, 5))
    for n in (3, 5, 10)
)
add("ag8_reversion_grid", lambda s, d: R.reversion_grid(_resid(s, d), _rets(s, d)), " UNION ALL ".join(f"SELECT {n} AS mr_lookback, {h} AS fwd_days, {SUMMARY} FROM j{n}_{h}" for n in (3, 5, 10) for h in (1, 3, 5)), MR_GRID, "ic_mean ic_std ic_ir_ann hit_rate_pct")
add("cal1_rebalance_grid", _grid, "SELECT * FROM grid", GRID)
add("cal6_weekly_signal", lambda s, d: R.last_of_period(_signal(s, d), W.period_end(F.col("date"), "W-FRI")), "SELECT CAST(date_trunc('week', date) + INTERVAL 4 DAY AS DATE) AS period_end, ticker, max_by(score, date) AS score FROM signal GROUP BY 1, 2", SIGNAL, "score")
add(
    "cal3_riskfree_periods", lambda s, d: W.riskfree_periods(P.riskfree(_rets(s, d)), _pnl(s, d).select("period_end")),
    "SELECT period_end, coalesce(c / nullif(lag(c) OVER (ORDER BY period_end), 0) - 1, 0) AS rf FROM (SELECT period_end, (SELECT max(pow(1.0001, n - 1)) FROM (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM rets)) WHERE date <= period_end) AS c FROM pnl)", BOOK, "rf",
)
PRICED = "tp AS (SELECT last_day(date + INTERVAL 1 DAY) AS period_end, turnover FROM turn)"
add(
    "ag10_cost_sweep", lambda s, d: R.repriced(_pnl(s, d), M.turnover(_weights(s, d)).select(F.last_day(F.add_months("date", 1)).alias("period_end"), "turnover")),
    "SELECT bps, avg(p) * 12 AS ann_return, stddev_samp(p) * sqrt(12) AS ann_vol, coalesce(avg(p) * 12 / nullif(stddev_samp(p) * sqrt(12), 0), 0) AS sharpe FROM (SELECT bps, pnl + (5.0 - bps) * 1e-4 * coalesce(turnover, 0) AS p FROM pnl LEFT JOIN tp USING (period_end) CROSS JOIN (SELECT CAST(unnest([0, 5, 10, 20]) AS DOUBLE) AS bps)) GROUP BY 1", BOOK + ", " + PRICED, "ann_return ann_vol sharpe",
)
BIND = "bind AS (SELECT w.date, avg(CASE WHEN abs(weight) >= 0.1 - 1e-6 THEN 1.0 ELSE 0.0 END) AS pos_bind_rate, CAST(sum(abs(weight)) >= 2.0 - 1e-6 AS DOUBLE) AS gross_bind, sum(weight * coalesce(beta, 0)) AS beta_exposure, CAST(abs(sum(weight * coalesce(beta, 0))) >= 0.02 - 1e-6 AS DOUBLE) AS beta_bind FROM weights w LEFT JOIN sb ON sb.ticker = w.ticker GROUP BY 1)"
add("ag13_binding_summary", lambda s, d: R.binding_summary(M.binding(_weights(s, d), _betas(s, d))), " UNION ALL ".join(f"SELECT '{c}' AS \"constraint\", avg({c}) * 100 AS bind_pct FROM bind" for c in ("pos_bind_rate", "gross_bind", "beta_exposure", "beta_bind")), BOOK + ", " + BIND, "bind_pct")
add("ag11_beta_exposure", lambda s, d: R.exposure(_weights(s, d), _betas(s, d)), "SELECT date, sum(weight * coalesce(beta, 0)) AS exposure FROM weights LEFT JOIN sb USING (ticker) GROUP BY 1", BOOK, "exposure")
add("ag16_alignment", lambda s, d: R.alignment(_signal(s, d), S.momentum_ratio(P.prices(s, d), 21, 126).withColumnRenamed("mom", "weight"), "pearson"), "SELECT date, covar_pop(score, mom) / nullif(stddev_pop(score) * stddev_pop(mom), 0) AS ic FROM signal JOIN m6 USING (date, ticker) WHERE mom IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 AND covar_pop(score, mom) / nullif(stddev_pop(score) * stddev_pop(mom), 0) IS NOT NULL", SIGNAL + ", m6 AS (SELECT date, ticker, lag(close, 21) OVER t / nullif(lag(close, 126) OVER t, 0) - 1 AS mom FROM prices WINDOW t AS (PARTITION BY ticker ORDER BY date))", "ic")
add("ts8_realized_vol", lambda s, d: R.realized_vol(_pnl(s, d)), "SELECT period_end, CASE WHEN count(*) OVER w >= 12 THEN stddev_samp(pnl) OVER w * sqrt(12) END AS vol FROM pnl WINDOW w AS (ORDER BY period_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", BOOK, "vol")
add("k12_neutral_to_beta", lambda s, d: R.neutral_to_beta(_rets(s, d).withColumnRenamed("ret", "mu"), _betas(s, d)), "SELECT date, ticker, ret - regr_intercept(ret, beta) OVER (PARTITION BY date) - regr_slope(ret, beta) OVER (PARTITION BY date) * beta AS mu FROM (SELECT r.date, r.ticker, r.ret, sb.beta FROM rets r JOIN sb USING (ticker))", BOOK, "mu")
add("k11_rank_labels", lambda s, d: W.labelled(M.period_returns(_rets(s, d)).select(F.col("period_end").alias("date"), "ticker", F.col("period_ret").alias("y")), "rank"), f"SELECT date, ticker, {_rank('y')} / count(*) OVER (PARTITION BY date) - 0.5 AS y FROM (SELECT period_end AS date, ticker, period_ret AS y FROM periods)", BOOK, "y")
add(
    "k11_zmad_labels", lambda s, d: W.labelled(M.period_returns(_rets(s, d)).select(F.col("period_end").alias("date"), "ticker", F.col("period_ret").alias("y")), "zmad"),
    "SELECT date, ticker, greatest(-3.0, least(3.0, (y - m) / (1.4826 * (median(abs(y - m)) OVER (PARTITION BY date) + 1e-12)))) AS y FROM (SELECT period_end AS date, ticker, period_ret AS y, median(period_ret) OVER (PARTITION BY period_end) AS m FROM periods)", BOOK, "y",
)
KERNELS = {"rbf": "exp(-x * x / 2)", "exp": "exp(-x)", "matern32": "(1 + sqrt(3) * x) * exp(-sqrt(3) * x)", "matern52": "(1 + sqrt(5) * x + 5 * x * x / 3) * exp(-sqrt(5) * x)"}
KW = "kx AS (SELECT date, (row_number() OVER (ORDER BY date DESC) - 1) / 32.0 AS x FROM (SELECT DISTINCT date FROM rets))"
for _kind, _form in KERNELS.items():
    add(f"rm5_weights_{_kind}", lambda s, d, k=_kind: R.kernel_weights(_rets(s, d), k), f"SELECT date, {_form} / sum({_form}) OVER () AS w FROM kx", KW, "w")
KR = KW + f", kr AS (SELECT r.date, ticker, ret, {KERNELS['matern32']} / (SELECT sum({KERNELS['matern32']}) FROM kx) AS w FROM rets r JOIN kx USING (date))"
add("rm6_kernel_cov", lambda s, d: SCALED(R.kernel_covariance(_rets(s, d))), COV.format("sum(a.w * a.ret * b.ret) * 1e4", "kr", "kr"), KR, "c")
add("rm6_kernel_cov_demeaned", lambda s, d: SCALED(R.kernel_covariance(_rets(s, d), zero_mean=False)), COV.format("sum(a.w * a.ret * b.ret) * 1e4", "kd", "kd"), KR + ", kd AS (SELECT date, ticker, w, ret - sum(w * ret) OVER (PARTITION BY ticker) AS ret FROM kr)", "c")
PLUG = "sc AS (" + COV.format("covar_samp(a.ret, b.ret)", "rets", "rets") + "), sq AS (SELECT *, CASE WHEN ticker_i = ticker_j THEN 1 ELSE 2 END AS n, (SELECT avg(c) FROM sc WHERE ticker_i = ticker_j) AS v FROM sc), sm AS (SELECT *, (SELECT sum(n * c) / sum(n) FROM sq) AS m, CASE WHEN ticker_i = ticker_j THEN v ELSE 0 END AS f FROM sq), sa AS (SELECT least(1.0, sum(n * (c - f) * (c - f)) / (sum(n * (c - m) * (c - m)) + 1e-12)) AS a FROM sm)"
add("rm10_plug_in_shrinkage", lambda s, d: SCALED(R.plug_in_shrinkage(M.covariance(_rets(s, d)))), "SELECT ticker_i, ticker_j, ((1 - a) * c + a * f) * 1e4 AS c FROM sm CROSS JOIN sa", PLUG, "c")
add(
    "rm11_ex_ante_vol", lambda s, d: R.ex_ante_vol(_weights(s, d), _rets(s, d)),
    "SELECT t AS date, CASE WHEN count(*) >= 42 THEN stddev_samp(r) * sqrt(252) END AS vol FROM (SELECT t, gk.date, sum(weight * ret) AS r FROM (SELECT t, max(ord) - 1 AS last FROM (SELECT DISTINCT date AS t FROM weights) JOIN gk ON gk.date <= t GROUP BY 1) JOIN gk ON ord BETWEEN last - 251 AND last JOIN rets r ON r.date = gk.date JOIN weights w ON w.date = t AND w.ticker = r.ticker GROUP BY 1, 2) GROUP BY 1", BOOK + ", " + GRID, "vol",
)
add("pl2_normalised_equity", lambda s, d: R.normalised(M.equity(_pnl(s, d)).select("period_end", "equity"), "equity", "period_end"), "SELECT period_end, equity / first_value(equity) OVER (ORDER BY period_end) AS equity FROM eq", BOOK, "equity")
add("pl5_ic_histogram", lambda s, d: R.histogram(_ic(s, d).withColumn("ic", F.round("ic", 6)), "ic"), "SELECT CAST(least(40, floor((x - lo) / (hi - lo) * 40) + 1) AS BIGINT) AS bin, count(*) AS n FROM (SELECT round(ic, 6) AS x FROM ic1) CROSS JOIN (SELECT min(round(ic, 6)) AS lo, max(round(ic, 6)) AS hi FROM ic1) GROUP BY 1", IC)
add(
    "st1_merge_cache", lambda s, d: P.merge_cache(P.load(P.prices(s, d), "1995-04-03", "1997-12-31"), P.load(P.prices(s, d), "1997-06-01", "1998-12-31").withColumn("close", F.col("close") + 1)),
    "SELECT date, ticker, CASE WHEN date >= DATE '1997-06-01' THEN close + 1 ELSE close END AS close FROM prices WHERE date <= DATE '1998-12-31' AND close IS NOT NULL", rounds="close",
)
_CFG = config.settings("MOM_MONTHLY")
add(
    "bt3_market_state", lambda s, d: W.market_state(P.market_prices(s, d), _grid(s, d), config.variant(_CFG, {"market_filter": True, "crash_fast_th": 0.0, "crash_slow_th": 0.0})),
    "SELECT date, NOT coalesce(last_value(up IGNORE NULLS) OVER (ORDER BY date), false) AS risk_off, coalesce(last_value(melt IGNORE NULLS) OVER (ORDER BY date), false) AS melt_up FROM (SELECT grid.date, up, coalesce(melt, CASE WHEN up IS NOT NULL THEN false END) AS melt FROM grid LEFT JOIN (SELECT last_day(date) AS date, arg_max(up, date) AS up, arg_max(melt, date) AS melt FROM (SELECT date, avg(px) OVER (ORDER BY date ROWS 62 PRECEDING) > avg(px) OVER (ORDER BY date ROWS 251 PRECEDING) AS up, px / lag(px, 21) OVER (ORDER BY date) - 1 >= 0 AND px / lag(px, 63) OVER (ORDER BY date) - 1 >= 0 AS melt FROM mpx) GROUP BY 1) m ON m.date = grid.date)", GRID,
)
add("ag18_window_betas", lambda s, d: W.window_betas(_rets(s, d), P.market(s, d), _grid(s, d), 252), "SELECT g.date, r.ticker, CASE WHEN count(*) >= 5 THEN coalesce(covar_samp(ret, mkt_ret) / nullif(var_samp(mkt_ret), 0), 0) ELSE 0 END AS beta FROM grid g JOIN rets r ON r.date > g.date - 252 AND r.date <= g.date JOIN market m ON m.date = r.date GROUP BY 1, 2", GRID, "beta")


def _inputs(spark, d):
    return _rets(spark, d), P.market(spark, d)


def _run(spark, d, variants):
    return W.backtest(*_inputs(spark, d), P.market_prices(spark, d), P.sectors(spark, d), variants)


def _one(mode, **overrides):
    return {mode.lower(): config.settings(mode, overrides)}


_AB = {"base": _CFG, "no_overlay": config.variant(_CFG, {"overlay_mr": False})}
_GP = config.settings("GP_MONTHLY")


def _zsamp(x: str) -> str:
    w = "OVER (PARTITION BY date)"
    return f"CASE WHEN coalesce(stddev_samp({x}) {w}, 0) = 0 THEN 0.0 ELSE ({x} - avg({x}) {w}) / (stddev_samp({x}) {w} + 1e-12) END"


def _reversion(rows: int, name: str) -> str:
    """CTEs for the three-day reversion score of residuals over so many rows, as name(date, ticker, score)."""
    ticker = "PARTITION BY ticker ORDER BY date ROWS BETWEEN"
    return f"""{name}_b AS (SELECT *, CASE WHEN count(ret) OVER w >= {max(5, rows // 5)} THEN covar_pop(ret, mkt_ret) OVER w / nullif(var_samp(mkt_ret) OVER w, 0) END AS beta
  FROM (SELECT r.date, r.ticker, r.ret, m.mkt_ret FROM rets r JOIN market m ON m.date = r.date) WINDOW w AS ({ticker} {rows - 1} PRECEDING AND CURRENT ROW)),
{name}_e AS (SELECT date, ticker, ret - coalesce(beta, 0) * mkt_ret AS resid FROM {name}_b),
{name}_v AS (SELECT date, ticker, resid / nullif(CASE WHEN count(resid) OVER w >= 12 THEN stddev_samp(resid) OVER w END, 0) AS v FROM {name}_e WINDOW w AS ({ticker} 59 PRECEDING AND CURRENT ROW)),
{name}_w AS (SELECT date, ticker, CASE WHEN count(v) OVER w >= 2 THEN -sum(v) OVER w END AS raw FROM {name}_v WINDOW w AS ({ticker} 2 PRECEDING AND CURRENT ROW)),
{_robust(f"{name}_w", "raw", name)}"""


ENGINE = f"me AS (SELECT date, ticker, lag(p, 21) OVER (PARTITION BY ticker ORDER BY date) AS mom FROM (SELECT date, ticker, CASE WHEN count(ret) OVER w >= 252 THEN product(1 + ret) OVER w - 1 END AS p FROM rets {W252}))"
WBETA = "wb AS (SELECT g.date, r.ticker, CASE WHEN count(*) >= 5 THEN coalesce(covar_samp(ret, mkt_ret) / nullif(var_samp(mkt_ret), 0), 0) ELSE 0 END AS beta FROM grid g JOIN rets r ON r.date > g.date - 252 AND r.date <= g.date JOIN market m ON m.date = r.date GROUP BY 1, 2)"
FEATURES = GRID + ", " + ENGINE + ", " + _reversion(252, "fr") + ", " + WBETA + f""",
iv AS (SELECT date, ticker, stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS idvol FROM rets),
fx AS (SELECT g.date, r.ticker, coalesce(mom, 0) AS mom, coalesce(score, 0) AS mr, coalesce(idvol, 0) AS idvol, coalesce(beta, 0) AS beta FROM grid g JOIN rets r ON r.date = g."asof"
       LEFT JOIN me ON me.date = r.date AND me.ticker = r.ticker LEFT JOIN fr ON fr.date = r.date AND fr.ticker = r.ticker
       LEFT JOIN iv ON iv.date = r.date AND iv.ticker = r.ticker LEFT JOIN wb ON wb.date = g.date AND wb.ticker = r.ticker),
ft AS (SELECT date, ticker, {_zsamp("mom")} AS z_mom, {_zsamp("mr")} AS z_mr, {_zsamp("idvol")} AS z_idvol, {_zsamp("beta")} AS z_beta,
       date_diff('day', (SELECT min(date) FROM rets), date) / CAST(252 AS DOUBLE) AS tau FROM fx)"""
_FEATURE_NAMES = "z_mom z_mr z_idvol z_beta tau"
add("ml1_features", lambda s, d: W.features(*_inputs(s, d), _grid(s, d), _GP), "SELECT * FROM ft", FEATURES, _FEATURE_NAMES)
TRAIN = FEATURES + """,
ty AS (SELECT g.date, r.ticker, product(1 + ret) - 1 AS y FROM grid g JOIN rets r ON last_day(r.date) = g.next_date GROUP BY 1, 2),
td AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY md5(date || ' ' || ticker)) AS turn, count(*) OVER (PARTITION BY date) AS n FROM ty) WHERE turn <= greatest(1, floor(n * 0.4))),
tl AS (SELECT date, ticker, greatest(-3.0, least(3.0, (y - m) / (1.4826 * (median(abs(y - m)) OVER (PARTITION BY date) + 1e-12)))) AS y FROM (SELECT *, median(y) OVER (PARTITION BY date) AS m FROM td)),
tu AS (SELECT * FROM (SELECT a.date AS t, b.date, b.k, count(*) OVER (PARTITION BY a.date) AS dates, max(b.k) OVER (PARTITION BY a.date) AS last FROM grid a JOIN grid b ON b.k < a.k AND b.date >= a.date - 100) WHERE dates >= 3 AND k < last)"""
add(
    "ml2_training_rows", lambda s, d: W.training_rows(W.features(*_inputs(s, d), _grid(s, d), _GP), _rets(s, d), _grid(s, d), _GP),
    "SELECT tu.t, ft.date, ft.ticker, z_mom, z_mr, z_idvol, z_beta, tau, y FROM tu JOIN ft ON ft.date = tu.date JOIN tl ON tl.date = ft.date AND tl.ticker = ft.ticker", TRAIN, _FEATURE_NAMES + " y",
)
ALPHA = GRID + ", " + ENGINE + ", " + _reversion(126, "ar") + f""",
am AS (SELECT g.date, r.ticker, coalesce(CASE WHEN g.ord >= 274 THEN mom END, 0) AS mu, coalesce(score, 0) AS mr FROM grid g JOIN rets r ON r.date = g."asof"
       LEFT JOIN me ON me.date = r.date AND me.ticker = r.ticker LEFT JOIN ar ON ar.date = r.date AND ar.ticker = r.ticker),
az AS (SELECT date, ticker, {_zsamp("mu")} AS mu, mr FROM am),
ao AS (SELECT date, ticker, mu * (1 - 0.3 * CASE WHEN sign(mu) <> sign(mr) THEN least(abs(mr), 1) ELSE 0 END) AS mu FROM az),
ap AS (SELECT date, ticker, {_zsamp("mu")} AS mu FROM ao), aq AS (SELECT date, ticker, {_zsamp("mu")} AS mu FROM ap),
aw AS (SELECT date, ticker, CASE WHEN coalesce(stddev_samp(mu) OVER w, 0) = 0 THEN coalesce(mu, 0) ELSE greatest(-3.0, least(3.0, (mu - avg(mu) OVER w) / nullif(stddev_samp(mu) OVER w, 0))) END AS mu FROM aq WINDOW w AS (PARTITION BY date)),
ax AS (SELECT last_day(date) AS date, arg_max(melt, date) AS melt FROM (SELECT date, px / lag(px, 21) OVER (ORDER BY date) - 1 >= 0.07 AND px / lag(px, 63) OVER (ORDER BY date) - 1 >= 0.12 AS melt FROM mpx) GROUP BY 1),
ay AS (SELECT g.date, coalesce(last_value(melt IGNORE NULLS) OVER (ORDER BY g.date), false) AS melt FROM grid g LEFT JOIN ax ON ax.date = g.date)"""
add("bt2_alpha", lambda s, d: W.alpha(*_inputs(s, d), P.market_prices(s, d), P.sectors(s, d), _grid(s, d), _CFG), "SELECT date, ticker, CASE WHEN melt AND mu < 0 THEN mu * 0.5 ELSE mu END AS mu FROM aw JOIN ay USING (date)", ALPHA, "mu")
add("bt3_ready_dates", lambda s, d: W.ready_dates(_rets(s, d), _grid(s, d), 504).select("date", "next_date", F.least("ord", F.lit(504)).alias("rows")), "SELECT date, next_date, least(ord, 504) AS rows FROM grid WHERE least(ord, 504) >= 60", GRID)
add(
    "ag23_cooldowns", lambda s, d: W.cooldowns(_pnl(s, d), fall=0.01),
    "SELECT period_end, s AS sum_recent, losses, drawdown, coalesce(n >= 4 AND (s < -0.002 OR losses >= 2) AND drawdown > 0.01, false) AS cool FROM (SELECT period_end, n, s, losses, 1 - equity / nullif(greatest(max(equity) OVER (ORDER BY period_end ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), CASE WHEN n <= 4 THEN 1.0 END), 0) AS drawdown FROM (SELECT period_end, equity, row_number() OVER (ORDER BY period_end) AS n, sum(pnl) OVER w AS s, CAST(sum(CAST(pnl < 0 AS INT)) OVER w AS BIGINT) AS losses FROM eq WINDOW w AS (ORDER BY period_end ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)))",
    BOOK, "sum_recent drawdown",
)


def _sectors_by_date(spark, d):
    rets = S.returns(P.prices(spark, d, hold=True))
    return W.at_grid(rets, W.rebalance_grid(rets), "ret", "ret").select("date", "ticker").join(F.broadcast(P.sectors(spark, d)), "ticker")


ROWS = GRID + """, gs AS (SELECT g.date, r.ticker, s.sector FROM grid g JOIN rets r ON r.date = g."asof" JOIN sectors s ON s.ticker = r.ticker),
gc AS (SELECT * FROM (SELECT date, sector, n, count(*) OVER (PARTITION BY date) AS kept FROM (SELECT date, sector, count(*) AS n FROM gs GROUP BY 1, 2) WHERE n >= 2) WHERE kept >= 2)"""
add("ag19_sectors", lambda s, d: W.sector_constraints(_sectors_by_date(s, d)).groupBy("date", F.col("row").alias("sector")).agg(F.count("*").alias("names")), "SELECT date, sector, n AS names FROM gc", ROWS)
add("op3_sector_rows", lambda s, d: W.sector_constraints(_sectors_by_date(s, d)), 'SELECT gs.date, gs.sector AS "row", ticker, CAST(1 AS DOUBLE) AS coefficient FROM gs JOIN gc ON gc.date = gs.date AND gc.sector = gs.sector', ROWS)
add("op4_unit_rows", lambda s, d: W.sector_constraints(_sectors_by_date(s, d), unit=True), 'SELECT gs.date, gs.sector AS "row", ticker, 1 / sqrt(n) AS coefficient FROM gs JOIN gc ON gc.date = gs.date AND gc.sector = gs.sector', ROWS, "coefficient")
# signs of axes are arbitrary: their projector is compared with a full decomposition in the tests
add("op5_principal_axes", lambda s, d: G.sample_axes(P.held(S.returns(P.prices(s, d, hold=True))), 2))
for _model in ("gp_kernel", "gp_kernel:matern52", "sample"):
    add("rm7_" + _model.replace(":", "_"), lambda s, d, m=_model: W.covariances(_rets(s, d), _grid(s, d), m, 0.97, 504))
add("bt1_walk_forward", lambda s, d: W.book(_run(s, d, _one("MOM_MONTHLY"))))
add("bt1_weekly_reversion", lambda s, d: W.book(_run(s, d, _one("MR_WEEKLY"))))
add("bt1_combo", lambda s, d: W.book(_run(s, d, _one("COMBO_MONTHLY"))))
add("ml5_gaussian_process", lambda s, d: W.book(_run(s, d, _one("GP_MONTHLY"))))
add("ml6_nystrom", lambda s, d: W.book(_run(s, d, _one("NYSTROM_MONTHLY"))))
add("bt5_decisions", lambda s, d: _run(s, d, _one("MOM_MONTHLY")).drop("tickers", "weights"))
add(
    "bt_invariants", lambda s, d: W.invariants(_run(s, d, _one("MOM_MONTHLY")), _rets(s, d), _CFG),
    "SELECT date, true AS profit_holds, true AS cost_holds, true AS still_holds, true AS solve_holds FROM grid WHERE least(ord, 504) >= 60", GRID,
)
add("bt11_report", lambda s, d: W.summary(_run(s, d, _one("MOM_MONTHLY")), P.riskfree(_rets(s, d)), _one("MOM_MONTHLY")))
add("bt12_ab_curves", lambda s, d: W.curves(_run(s, d, _AB)))


def flagship(spark, sf_dir):
    return QUERIES["ag4_ic_summary"](spark, sf_dir)

add("k3b_robust_z_std", lambda s, d: K.robust_z(_rets(s, d), "ret", "score", method="std").select("date", "ticker", "score"), "SELECT date, ticker, CASE WHEN count(ret) OVER w < 3 THEN 0.0 ELSE z - avg(z) OVER w END AS score FROM (SELECT date, ticker, ret, greatest(-3.0, least(3.0, (ret - avg(ret) OVER v) / (stddev_pop(ret) OVER v + 1e-12))) AS z FROM rets WINDOW v AS (PARTITION BY date)) WINDOW w AS (PARTITION BY date)", rounds="score")
add("sg8_reversion_from_prices", lambda s, d: S.reversion_from_prices(P.prices(s, d), P.market(s, d), 5), "SELECT p.date, p.ticker, coalesce(m.score, 0) AS score FROM prices p LEFT JOIN mrs m ON m.date = p.date AND m.ticker = p.ticker", MR, "score")
add("sg9_overlay", lambda s, d: S.overlay(_signal(s, d), S.mean_reversion(_resid(s, d))), "SELECT s.date, s.ticker, 0.9 * coalesce(s.score, 0) + 0.1 * coalesce(m.score, 0) AS score FROM signal s LEFT JOIN mrs m ON m.date = s.date AND m.ticker = s.ticker", SIGNAL + ", " + MR, "score")
add(
    "cal4_panel_periods", lambda s, d: R.panel_periods(_rets(s, d), _pnl(s, d)),
    "SELECT period_end, ticker, coalesce(c / nullif(lag(c) OVER (PARTITION BY ticker ORDER BY period_end), 0) - 1, 0) AS ret FROM (SELECT period_end, ticker, max_by(c, g.date) AS c FROM pnl JOIN (SELECT date, ticker, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS c FROM rets) g ON g.date <= period_end GROUP BY 1, 2)", BOOK, "ret",
)
add("cal7_weekly_returns", lambda s, d: _rets(s, d).groupBy(W.period_end(F.col("date"), "W-FRI").alias("period_end"), "ticker").agg((F.product(1 + F.col("ret")) - 1).alias("period_ret")), "SELECT CAST(date_trunc('week', date) + INTERVAL 4 DAY AS DATE) AS period_end, ticker, product(1 + ret) - 1 AS period_ret FROM rets GROUP BY 1, 2", rounds="period_ret")
add("cal8_monthly_exposure", lambda s, d: R.monthly_exposure(M.sector_exposure(_weights(s, d), P.sectors(s, d))), "SELECT strftime(date, '%Y-%m') AS month, sector, avg(exposure) AS exposure FROM (SELECT date, sector, sum(weight) AS exposure FROM weights w JOIN sectors s ON s.ticker = w.ticker GROUP BY 1, 2) GROUP BY 1, 2", BOOK, "exposure")
add("pl6_heatmap", lambda s, d: R.heatmap(M.sector_exposure(_weights(s, d), P.sectors(s, d)), "date", "sector", "exposure", [f"S{i}" for i in range(5)]), "SELECT date, " + ", ".join(f"avg(CASE WHEN sector = 'S{i}' THEN exposure END) AS S{i}" for i in range(5)) + " FROM (SELECT date, sector, sum(weight) AS exposure FROM weights w JOIN sectors s ON s.ticker = w.ticker GROUP BY 1, 2) GROUP BY 1", BOOK, "S0 S1 S2 S3 S4")
add("pl1_to_equity", lambda s, d: R.to_equity(_pnl(s, d), "pnl", "period_end"), "SELECT period_end, product(1 + pnl) OVER (ORDER BY period_end) AS pnl FROM pnl", BOOK, "pnl")


def _blended(weight: float, name: str) -> str:
    return f"""{name} AS (SELECT s.date, s.ticker, coalesce(b.score, 0) AS score FROM signal s LEFT JOIN (SELECT date, ticker, greatest(-3.0, least(3.0, {_zpop('b')})) AS score FROM (
  SELECT date, ticker, zp + {weight} * zs AS b FROM (SELECT date, ticker, {_zpop('p')} AS zp, {_zpop('s')} AS zs FROM (
    SELECT a.date, a.ticker, a.score AS p, c.score AS s FROM signal a JOIN mrs c ON c.date = a.date AND c.ticker = a.ticker)))) b ON b.date = s.date AND b.ticker = s.ticker)"""


BLENDS = (0.0, 0.1, 0.2, 0.3, 0.5)
BLEND_GRID = SIGNAL + ", " + MR + ", nx AS (SELECT date, ticker, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS fwd_ret FROM rets), "
BLEND_GRID += ", ".join(_blended(w, f"b{i}") + ", " + _ic_of(f"b{i}", "nx", f"bi{i}") for i, w in enumerate(BLENDS))
add(
    "ag8_blend_grid", lambda s, d: R.blend_grid(_signal(s, d), S.mean_reversion(_resid(s, d)), S.ahead(_rets(s, d), 1)),
    " UNION ALL ".join(f"SELECT CAST({w} AS DOUBLE) AS mr_weight, coalesce(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(252), 0) AS ic_ir_ann FROM bi{i}" for i, w in enumerate(BLENDS)), BLEND_GRID, "ic_ir_ann",
)


CAL = """ce AS (SELECT DISTINCT period_end FROM pnl),
cg AS (SELECT period_end, ticker, coalesce(c / nullif(lag(c) OVER (PARTITION BY ticker ORDER BY period_end), 0) - 1, 0) AS ret FROM (
  SELECT period_end, ticker, max_by(c, g.date) AS c FROM ce JOIN (SELECT date, ticker, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS c FROM rets) g ON g.date <= period_end GROUP BY 1, 2)),
cm AS (SELECT period_end, coalesce(c / nullif(lag(c) OVER (ORDER BY period_end), 0) - 1, 0) AS mkt_ret FROM (
  SELECT period_end, max_by(c, g.date) AS c FROM ce LEFT JOIN (SELECT date, product(1 + mkt_ret) OVER (ORDER BY date) AS c FROM market) g ON g.date <= period_end GROUP BY 1)),
cb AS (SELECT period_end, ticker, CASE WHEN count(*) OVER w >= 12 THEN (avg(ret * mkt_ret) OVER w - avg(ret) OVER w * avg(mkt_ret) OVER w) / nullif(var_samp(mkt_ret) OVER w, 0) END AS beta
  FROM (SELECT cg.*, mkt_ret FROM cg JOIN cm USING (period_end)) WINDOW w AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


def _period_betas(spark, d):
    return R.period_betas(_rets(spark, d), P.market(spark, d), _pnl(spark, d).select("period_end"), 12)


add("ag15_period_betas", _period_betas, "SELECT period_end AS date, ticker, beta FROM cb", BOOK + ", " + CAL, "beta")
add("ag15_rolling_exposure", lambda s, d: R.exposure(_weights(s, d), _period_betas(s, d), inner=True), "SELECT w.date, sum(weight * coalesce(beta, 0)) AS exposure FROM weights w JOIN cb ON cb.period_end = w.date AND cb.ticker = w.ticker GROUP BY 1", BOOK + ", " + CAL, "exposure")


def _two_curves(spark, d):
    book = M.equity(_pnl(spark, d)).select(F.lit("portfolio").alias("name"), F.col("period_end").alias("date"), F.col("equity").alias("value"))
    return book.unionByName(R.to_growth(P.market(spark, d).select("date", F.col("mkt_ret").alias("ret"))).select(F.lit("market").alias("name"), "date", F.col("growth").alias("value")))


add(
    "pl3_equity_vs_market", lambda s, d: R.aligned(_two_curves(s, d)),
    "SELECT name, date, coalesce(value, nxt) / first_value(coalesce(value, nxt)) OVER (PARTITION BY name ORDER BY date) AS value FROM (SELECT name, date, last_value(v IGNORE NULLS) OVER (PARTITION BY name ORDER BY date) AS value, first_value(v IGNORE NULLS) OVER (PARTITION BY name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nxt FROM (SELECT n.name, t.date, c.value AS v FROM (SELECT DISTINCT date FROM curves) t CROSS JOIN (SELECT DISTINCT name FROM curves) n LEFT JOIN curves c ON c.date = t.date AND c.name = n.name))",
    BOOK + ", curves AS (SELECT 'portfolio' AS name, period_end AS date, equity AS value FROM eq UNION ALL SELECT 'market', date, product(1 + mkt_ret) OVER (ORDER BY date) FROM market)", "value",
)


def _ls_of(signal: str, fwd: str, name: str) -> str:
    """CTE for the daily decile spread of signal in fwd, as name(date, ls_ret)."""
    return f"""{name} AS (SELECT * FROM (SELECT date, avg(CASE WHEN q >= 0.9 THEN fwd_ret END) - avg(CASE WHEN q <= 0.1 THEN fwd_ret END) AS ls_ret FROM (
  SELECT s.date, fwd_ret, {_rank("score").replace("BY date", "BY s.date")} / count(*) OVER (PARTITION BY s.date) AS q FROM {signal} s JOIN {fwd} f ON f.date = s.date AND f.ticker = s.ticker WHERE s.score IS NOT NULL AND f.fwd_ret IS NOT NULL)
  GROUP BY date HAVING count(*) >= 20) WHERE ls_ret IS NOT NULL)"""


def _stats_of(factor: int, count: str) -> str:
    return f"avg(ls_ret) * {factor} AS ann_ret, stddev_samp(ls_ret) * sqrt({factor}) AS ann_vol, coalesce(avg(ls_ret) * {factor} / nullif(stddev_samp(ls_ret) * sqrt({factor}), 0), 0) AS sharpe, count(ls_ret) AS {count}"


def _base(spark, d):
    return S.mean_reversion(_resid(spark, d))


add("snk6_monthly_ic", lambda s, d: O.monthly_ic_grid(P.prices(s, d), S.forward_returns(P.prices(s, d))), " UNION ALL ".join(f"SELECT {g} AS gap, {n} AS lookback, strftime(date, '%Y-%m') AS month, avg(ic) AS ic_mean FROM i{g}_{n} GROUP BY 3" for g, n in CELLS), MOM_GRID, "ic_mean")
BEST = MOM_GRID + ", " + ", ".join(_ls_of(f"s{g}_{n}", "fwd", f"d{g}_{n}") for g, n in CELLS) + ", top AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {g} AS gap, {n} AS lookback, {SUMMARY} FROM i{g}_{n}" for g, n in CELLS) + ") ORDER BY ic_ir_ann DESC LIMIT 1)"
add(
    "snk6_best_deciles", lambda s, d: O.best_deciles(P.prices(s, d), S.forward_returns(P.prices(s, d)), R.momentum_grid(P.prices(s, d), S.forward_returns(P.prices(s, d))))[0],
    "SELECT x.* FROM (" + " UNION ALL ".join(f"SELECT {g} AS gap, {n} AS lookback, {_stats_of(252, 'n_days')} FROM d{g}_{n}" for g, n in CELLS) + ") x JOIN top ON top.gap = x.gap AND top.lookback = x.lookback", BEST, "ann_ret ann_vol sharpe",
)
LABEL = {"W-FRI": "CAST(date_trunc('week', date) + INTERVAL 4 DAY AS DATE)", "ME": "last_day(date)"}


def _period_ctes(freq: str) -> str:
    return MR + f""", lp AS (SELECT {LABEL[freq]} AS date, ticker, max_by(score, date) AS score FROM mrs GROUP BY 1, 2),
lr AS (SELECT {LABEL[freq]} AS date, ticker, product(1 + ret) - 1 AS fwd_ret FROM rets GROUP BY 1, 2),
ln AS (SELECT date, ticker, lead(fwd_ret) OVER (PARTITION BY ticker ORDER BY date) AS fwd_ret FROM lr), {_ic_of("lp", "lr", "lc")}, {_ls_of("lp", "ln", "ld")}"""


def _period_summary(factor: int, count: str) -> str:
    return f"SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, coalesce(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt({factor}), 0) AS ic_ir_ann, count(*) AS {count} FROM lc"


for _freq, _factor, _count in (("W-FRI", 52, "n_weeks"), ("ME", 12, "n_months")):
    add(
        f"snk7_{'weekly' if _factor == 52 else 'monthly'}_ic", lambda s, d, f=_freq, k=_factor, c=_count: M.ic_summary(O.period_ic(_base(s, d), _rets(s, d), f), float(k), c).drop("hit_rate_pct"),
        _period_summary(_factor, _count), _period_ctes(_freq), "ic_mean ic_std ic_ir_ann",
    )
add("snk7_weekly_deciles", lambda s, d: M.return_stats(O.period_deciles(_base(s, d), _rets(s, d), "W-FRI"), "ls_ret", 52.0).withColumnRenamed("n_days", "n_weeks"), f"SELECT {_stats_of(52, 'n_weeks')} FROM ld", _period_ctes("W-FRI"), "ann_ret ann_vol sharpe")
add(
    "snk7_best_stats", lambda s, d: O.reversion_lab(_rets(s, d), _resid(s, d), _signal(s, d))["mr_best_stats"][0],
    "SELECT x.* FROM (" + " UNION ALL ".join(f"SELECT {n} AS L, 1 AS F, {_stats_of(252, 'n_days')} FROM e{n}" for n in (3, 5, 10)) + ") x JOIN rtop ON rtop.mr_lookback = x.L",
    MR_GRID + ", " + ", ".join(_ls_of(f"z{n}", "a1", f"e{n}") for n in (3, 5, 10)) + ", rtop AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {n} AS mr_lookback, {SUMMARY} FROM j{n}_1" for n in (3, 5, 10)) + ") ORDER BY ic_ir_ann DESC, ic_mean DESC LIMIT 1)", "ann_ret ann_vol sharpe",
)
add(
    "snk5_rolling_binding", lambda s, d: M.binding(_weights(s, d), _period_betas(s, d), 0.1, 1.9),
    "SELECT w.date, avg(CASE WHEN abs(weight) >= 0.1 - 1e-6 THEN 1.0 ELSE 0.0 END) AS pos_bind_rate, CAST(sum(abs(weight)) >= 1.9 - 1e-6 AS DOUBLE) AS gross_bind, sum(weight * coalesce(beta, 0)) AS beta_exposure, CAST(abs(sum(weight * coalesce(beta, 0))) >= 0.02 - 1e-6 AS DOUBLE) AS beta_bind FROM weights w LEFT JOIN cb ON cb.period_end = w.date AND cb.ticker = w.ticker GROUP BY 1",
    BOOK + ", " + CAL, "pos_bind_rate gross_bind beta_exposure beta_bind",
)


add("k2_clip", lambda s, d: S.momentum_ratio(P.prices(s, d)).select("date", "ticker", K.clip(F.col("mom"), 0.1).alias("mom")), "SELECT date, ticker, CASE WHEN mom IS NOT NULL THEN greatest(-0.1, least(0.1, mom)) END AS mom FROM mom", rounds="mom")
add(
    "k15_labels", lambda s, d: P.prices(s, d).select("date", "ticker", F.date_format("date", "yyyy-MM").alias("month"), F.lower("ticker").alias("low"), F.upper("ticker").alias("up"), F.col("ticker").startswith("Brand#1").alias("first"), F.get(F.split("ticker", "#"), F.lit(1)).alias("number")),
    "SELECT date, ticker, strftime(date, '%Y-%m') AS month, lower(ticker) AS low, upper(ticker) AS up, starts_with(ticker, 'Brand#1') AS \"first\", split_part(ticker, '#', 2) AS number FROM prices",
)
add(
    "k17_confidence", lambda s, d: _rets(s, d).withColumn("sd", K.rolling(F.col("ret"), F.stddev_samp, 21, 21)).filter("sd is not null").select("date", "ticker", K.by_confidence(F.col("ret"), F.col("sd"), 0.01).alias("mu")),
    "SELECT date, ticker, ret / sqrt(pow(greatest(sd, 0.01), 2) + 1e-12) AS mu FROM (SELECT date, ticker, ret, CASE WHEN count(ret) OVER w >= 21 THEN stddev_samp(ret) OVER w END AS sd FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) WHERE sd IS NOT NULL", rounds="mu",
)
add(
    "j10_semi_anti", lambda s, d: (lambda p, k: p.join(k, "ticker", "left_semi").groupBy("ticker").agg(F.count("close").alias("n")).withColumn("held", F.lit(True)).unionByName(p.join(k, "ticker", "left_anti").groupBy("ticker").agg(F.count("close").alias("n")).withColumn("held", F.lit(False))))(P.prices(s, d), _betas(s, d).filter("beta > 0").select("ticker")),
    "SELECT ticker, count(close) AS n, ticker IN (SELECT ticker FROM sb WHERE beta > 0) AS held FROM prices GROUP BY 1", BOOK,
)


def _mu(spark, d, **overrides):
    return W.raw_alpha(*_inputs(spark, d), _grid(spark, d), config.variant(_CFG, overrides))


add("sg10_momentum_mu", lambda s, d: _mu(s, d, overlay_mr=False), "SELECT date, ticker, mu FROM am", ALPHA, "mu")
add("sg11_reversion_mu", lambda s, d: _mu(s, d, signal_type="mr_3"), "SELECT date, ticker, mr AS mu FROM am", ALPHA, "mu")
COMBO = ALPHA + f""", cm AS (SELECT g.date, me.ticker, mom, score FROM grid g JOIN me ON me.date = g."asof" JOIN ar ON ar.date = me.date AND ar.ticker = me.ticker WHERE g.ord >= 274 AND mom IS NOT NULL),
cz AS (SELECT date, ticker, {_zsamp("mom")} + 0.2 * {_zsamp("score")} AS mu FROM cm)"""
add("sg12_combo_mu", lambda s, d: _mu(s, d, signal_type="combo_mom_mr"), "SELECT am.date, am.ticker, coalesce(cz.mu, 0) AS mu FROM am LEFT JOIN cz ON cz.date = am.date AND cz.ticker = am.ticker", COMBO, "mu")
add("sg13_disagreement", lambda s, d: _mu(s, d), "SELECT date, ticker, mu FROM ap", ALPHA, "mu")
FINAL = ALPHA + f""", fd AS (SELECT ap.date, ap.ticker, mu - avg(mu) OVER (PARTITION BY ap.date, sector) AS mu FROM ap JOIN sectors ON sectors.ticker = ap.ticker), fz AS (SELECT date, ticker, {_zsamp("mu")} AS mu FROM fd)"""
WINSOR = "CASE WHEN coalesce(stddev_samp(mu) OVER w, 0) = 0 THEN coalesce(mu, 0) ELSE greatest(-3.0, least(3.0, (mu - avg(mu) OVER w) / nullif(stddev_samp(mu) OVER w, 0))) END AS mu"
add("sg14_finalized", lambda s, d: W.finalized(_mu(s, d), P.sectors(s, d), config.variant(_CFG, {"sector_neutral_signal": True})), f"SELECT date, ticker, {WINSOR} FROM fz WINDOW w AS (PARTITION BY date)", FINAL, "mu")
OFF = ALPHA + f""", us AS (SELECT last_day(date) AS date, arg_max(up, date) AS up FROM (SELECT date, avg(px) OVER (ORDER BY date ROWS 62 PRECEDING) > avg(px) OVER (ORDER BY date ROWS 251 PRECEDING) AS up FROM mpx) GROUP BY 1),
uf AS (SELECT g.date, NOT coalesce(last_value(up IGNORE NULLS) OVER (ORDER BY g.date), false) AS off FROM grid g LEFT JOIN us ON us.date = g.date),
um AS (SELECT ap.date, ticker, CASE WHEN off THEN 0 ELSE mu END AS mu FROM ap JOIN uf USING (date)), uz AS (SELECT date, ticker, {_zsamp("mu")} AS mu FROM um)"""
add(
    "sg15_risk_off", lambda s, d: W.alpha(*_inputs(s, d), P.market_prices(s, d), P.sectors(s, d), _grid(s, d), config.variant(_CFG, {"market_filter": True, "risk_off_shrink": 0.0, "crash_protect": False})),
    f"SELECT date, ticker, {WINSOR} FROM uz WINDOW w AS (PARTITION BY date)", OFF, "mu",
)
