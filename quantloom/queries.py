"""The engine's queries over the given tables, each with its SQL twin.

Statistics are rounded to nine places at the very end, in both engines; prices never are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.cross_section import average_rank, rank01, score_table, zscore
from quantloom.operators import contracts, core, lifecycle, ranges, signals
from quantloom.plans import compiler
from quantloom.plans.dsl import parse
from quantloom.sources.storage import checkpointed
from quantloom.sources import feeds, market

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUTOFF, BOOK_DAY = "1998-12-31", "2001-06-30"

LINES = """lines AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 5, '0') AS ticker, l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate::DATE AS day,
    round(l_extendedprice * 100)::BIGINT AS c, l_quantity::BIGINT AS q, round(l_discount * 100)::BIGINT AS dp, round(l_tax * 100)::BIGINT AS tp FROM lineitem)"""


def _bars_sql(unit: str) -> str:
    return f"""bars AS (SELECT ticker, date, (high + low) / 2 AS open, high, low, least(high, greatest(low, c::DOUBLE / q / 100)) AS close, q::DOUBLE AS volume, a::DOUBLE / q / 10000 AS adjusted_close
    FROM (SELECT ticker, date_trunc('{unit}', day)::DATE AS date, max(c::DOUBLE / q / 100) AS high, min(c::DOUBLE / q / 100) AS low, sum(c)::BIGINT AS c, sum(q)::BIGINT AS q,
        sum(c * (100 - dp))::BIGINT AS a FROM lines GROUP BY ALL))"""


ESTIMATES = """estimates AS (SELECT ticker, 'C' || o_custkey::VARCHAR AS analyst_id, o_orderdate::DATE AS estimate_date, CASE l_returnflag WHEN 'R' THEN 'EPS' WHEN 'A' THEN 'Revenue' WHEN 'N' THEN 'EBITDA' END AS metric,
    c::DOUBLE / q / 100 AS value, CASE WHEN l_linenumber <> 1 THEN 1 - dp * 5 / 100.0::DOUBLE END AS analyst_accuracy, true AS is_point_in_time FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE q >= 45)"""
FUNDAMENTALS = """fundamentals AS (SELECT f.ticker, (quarter + INTERVAL 3 MONTH + INTERVAL 44 DAY)::DATE AS report_date, year(quarter)::INT AS fiscal_year, quarter(quarter)::INT AS fiscal_quarter, 1000000 + s_acctbal AS total_assets,
    (10 * rv - dc) / 10000 AS net_income, (10 * rv - dc + tx - 4 * rv) / 10000 AS operating_cash_flow, rv / 100 AS revenue, true AS is_point_in_time
    FROM (SELECT ticker, date_trunc('quarter', day)::DATE AS quarter, sum(c)::DOUBLE AS rv, sum(c * dp)::DOUBLE AS dc, sum(c * tp)::DOUBLE AS tx FROM lines GROUP BY ALL) f
    JOIN (SELECT 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS ticker, s_acctbal FROM supplier) s USING (ticker))"""
OWNERSHIP = """ownership AS (SELECT ticker, last_day(day) AS as_of_date, count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) AS institutional_ownership_pct, count(DISTINCT o_custkey)::BIGINT AS institution_count,
    true AS is_point_in_time FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
LINKS = """per_part AS (SELECT l_partkey, ticker, count(*) AS k FROM lines GROUP BY ALL),
    shared AS (SELECT a.ticker, b.ticker AS related_ticker, sum(a.k * b.k) AS n FROM per_part a JOIN per_part b USING (l_partkey) WHERE a.ticker <> b.ticker GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, related_ticker) AS r FROM shared QUALIFY r <= 3),
    links AS (SELECT ticker, related_ticker, CASE WHEN r % 2 = 1 THEN 'supplier' ELSE 'customer' END AS relationship, n::DOUBLE / max(n) OVER (PARTITION BY ticker) AS weight, true AS is_point_in_time FROM ranked)"""
SECTORS = "sectors AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS ticker, n_regionkey AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
PANEL = """panel AS (SELECT *, CASE WHEN abs(p) > 1e-12 THEN adjclose / p - 1 END AS ret FROM (SELECT d.date, t.ticker, open, high, low, close, volume, adjusted_close AS adjclose,
    lag(adjusted_close) OVER (PARTITION BY t.ticker ORDER BY d.date) AS p FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars ON bars.date = d.date AND bars.ticker = t.ticker))"""
FWD = "fwd AS (SELECT * FROM (SELECT ticker, date, lead(adjusted_close, {h}) OVER (PARTITION BY ticker ORDER BY date) / adjusted_close - 1 AS fwd FROM bars) WHERE fwd IS NOT NULL)"
RET = "ret AS (SELECT * FROM (SELECT ticker, date, adjusted_close / lag(adjusted_close, {k}) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM {src}) WHERE ret IS NOT NULL)"
MARKET = "market AS (SELECT date, avg(ret) AS market FROM ret GROUP BY date)"
SCORES = """scores AS (SELECT * FROM (SELECT 'momentum_3' AS signal, date, ticker, adjusted_close / lag(adjusted_close, 3) OVER (PARTITION BY ticker ORDER BY date) - 1 AS raw_score FROM bars
    UNION ALL SELECT 'reversal_1', date, ticker, -(adjusted_close / lag(adjusted_close, 1) OVER (PARTITION BY ticker ORDER BY date) - 1) FROM bars
    UNION ALL SELECT 'volume', date, ticker, ln(1 + volume) FROM bars) WHERE raw_score IS NOT NULL)"""


def _rho_sql(name: str, pairs: str, x: str, y: str, by: str) -> str:
    avg_rank = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE"
    return f"""{name} AS (SELECT {by}, count(*)::BIGINT AS n, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho
    FROM (SELECT {by}, {avg_rank.format(by=by, x=x)} AS rx, {avg_rank.format(by=by, x=y)} AS ry FROM {pairs}) GROUP BY {by} HAVING count(*) >= 5 AND min(rx) < max(rx) AND min(ry) < max(ry))"""


IC = "pairs AS (SELECT * FROM scores JOIN fwd USING (ticker, date)), " + _rho_sql("rhos", "pairs", "raw_score", "fwd", "signal, date") + ", ics AS (SELECT signal, date, n, rho AS ic FROM rhos)"
REGIMES = """daily AS (SELECT date, avg(market) OVER (ORDER BY date ROWS 20 PRECEDING) AS trend, CASE WHEN count(*) OVER (ORDER BY date ROWS 20 PRECEDING) >= 2 THEN stddev_pop(market) OVER (ORDER BY date ROWS 20 PRECEDING) END AS vol FROM market),
    regimes AS (SELECT date, CASE WHEN trend >= 0 THEN 'bull' ELSE 'bear' END AS regime FROM daily
    UNION ALL SELECT date, CASE WHEN vol >= (SELECT median(vol) FROM daily) THEN 'high_vol' ELSE 'low_vol' END FROM daily WHERE vol IS NOT NULL)"""
MONTHLY, WEEKLY = f"{LINES}, {_bars_sql('month')}", f"{LINES}, {_bars_sql('week')}"


def _z_sql(x: str, by: str) -> str:
    w = f"OVER (PARTITION BY {by})"
    return f"CASE WHEN count({x}) {w} < 2 OR min({x}) {w} = max({x}) {w} THEN 0.0::DOUBLE ELSE ({x} - avg({x}) {w}) / stddev_pop({x}) {w} END"


def _rank01_sql(x: str, by: str) -> str:
    n = f"count(*) OVER (PARTITION BY {by})"
    return f"CASE WHEN {n} < 2 THEN 0.5::DOUBLE ELSE (rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE - 1) / ({n} - 1) END"


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, ctes: str = "", doubles: str = ""):
    """Register a query; ``doubles`` are the columns that the SQL rounds."""

    def keep(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            body = f"WITH {ctes} {sql}" if ctes else sql
            swap = ", ".join(f"round({c}, 9) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({swap}) FROM ({body})" if swap else body
        return f

    return keep


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    return market.bars(spark, d, "week")


def three_signals(bars: DataFrame, *also: str) -> DataFrame:
    """A long table of three simple signals on the observation axis, with columns of ``bars`` that are to come along."""
    back = lambda k: F.col("adjusted_close") / F.lag("adjusted_close", k).over(core.by_ticker()) - 1
    wide = bars.select("date", "ticker", *also, back(3).alias("momentum_3"), (-back(1)).alias("reversal_1"), F.log(1 + F.col("volume")).alias("volume"))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("raw_score")) for n in ("momentum_3", "reversal_1", "volume"))))
    return wide.select("date", "ticker", *also, pairs.alias("s")).select("s.signal", "date", "ticker", "s.raw_score", *also).where("raw_score is not null")


PRICE_COLUMNS = "open high low close adjusted_close"


@query("SELECT * FROM bars", MONTHLY, PRICE_COLUMNS)
def bars_monthly(spark, d):
    return market.bars(spark, d)


@query("SELECT * FROM bars", WEEKLY, PRICE_COLUMNS)
def bars_weekly(spark, d):
    return _weekly(spark, d)


@query("SELECT * FROM estimates", f"{LINES}, {ESTIMATES}", "value analyst_accuracy")
def estimates(spark, d):
    return market.estimates(spark, d)


@query("SELECT * FROM fundamentals", f"{LINES}, {FUNDAMENTALS}", "total_assets net_income operating_cash_flow revenue")
def fundamentals(spark, d):
    return market.fundamentals(spark, d)


@query("SELECT * FROM ownership", f"{LINES}, {OWNERSHIP}", "institutional_ownership_pct")
def ownership(spark, d):
    return market.ownership(spark, d)


@query("SELECT * FROM links", f"{LINES}, {LINKS}", "weight")
def links(spark, d):
    return market.links(spark, d)


@query("SELECT * FROM sectors", SECTORS)
def sectors(spark, d):
    return market.sectors(spark, d)


@query(
    """SELECT ticker, date, array_to_string(list_filter([CASE WHEN NOT close > 0 THEN 'close positive' END, CASE WHEN NOT (close BETWEEN low AND high) THEN 'close outside range' END], lambda x : x IS NOT NULL), '; ') AS reasons
    FROM (SELECT * REPLACE (close * 1.2 AS close) FROM bars) WHERE NOT (close BETWEEN low AND high) OR NOT close > 0""",
    MONTHLY,
)
def contract_price_rejects(spark, d):
    bad = contracts.validate(market.bars(spark, d).withColumn("close", F.col("close") * 1.2), contracts.PRICE)[1]
    return bad.select("ticker", "date", F.array_join("reasons", "; ").alias("reasons"))


@query("SELECT metric, count(*)::BIGINT AS n_good FROM estimates WHERE metric IN ('EPS', 'Revenue', 'EBITDA') AND (analyst_accuracy IS NULL OR analyst_accuracy BETWEEN 0.75 AND 1) GROUP BY ALL", f"{LINES}, {ESTIMATES}")
def contract_estimates_good(spark, d):
    rows = market.estimates(spark, d).withColumn("analyst_accuracy", (F.col("analyst_accuracy") - 0.75) * 4)
    return contracts.validate(rows, contracts.ESTIMATE)[0].groupBy("metric").agg(F.count(F.lit(1)).alias("n_good"))


@query("SELECT date, ticker, open, high, low, close, volume, adjclose, ret FROM panel", f"{WEEKLY}, {PANEL}", "open high low close adjclose ret")
def panel_dense(spark, d):
    return compiler.panel(_weekly(spark, d))


@query("SELECT * FROM fwd", f"{MONTHLY}, {FWD.format(h=1)}", "fwd")
def forward_return_1(spark, d):
    return core.forward_return(market.bars(spark, d), 1)


@query("SELECT * FROM fwd", f"{WEEKLY}, {FWD.format(h=21)}", "fwd")
def forward_return_21(spark, d):
    return core.forward_return(_weekly(spark, d), 21)


@query("SELECT * FROM ret", f"{MONTHLY}, {RET.format(k=3, src='bars')}", "ret")
def observed_return_3(spark, d):
    return core.observed_return(market.bars(spark, d), 3)


@query("SELECT * FROM market", f"{MONTHLY}, {RET.format(k=1, src='bars')}, {MARKET}", "market")
def market_return(spark, d):
    return core.market_return(market.bars(spark, d))


@query(f"SELECT date, ticker, {_z_sql('volume', 'date')} AS z FROM bars", WEEKLY, "z")
def zscore_pop(spark, d):
    return _weekly(spark, d).select("date", "ticker", zscore("volume", "date").alias("z"))


@query("SELECT date, ticker, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE AS r FROM bars", WEEKLY)
def avg_rank(spark, d):
    return _weekly(spark, d).select("date", "ticker", average_rank("volume", "date").alias("r"))


@query("SELECT date, ticker, rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0::DOUBLE AS r FROM bars", WEEKLY)
def avg_rank_wide(spark, d):
    """All bars as one cross-section, which no task holds whole."""
    return ranges.average_ranks(_weekly(spark, d).select(F.lit(1).alias("one"), "date", "ticker", "volume"), ["one"], "volume", "r").select("date", "ticker", "r")


@query(f"SELECT date, ticker, {_rank01_sql('volume', 'date')} AS r FROM bars", WEEKLY, "r")
def rank_01(spark, d):
    return _weekly(spark, d).select("date", "ticker", rank01("volume", "date").alias("r"))


@query(
    f"SELECT 'volume' AS signal, '1.0' AS version, 'bars.volume' AS inputs, date, ticker, raw_score, {_rank01_sql('raw_score', 'date')} AS rank_score FROM (SELECT date, ticker, ln(1 + volume) AS raw_score FROM bars)", MONTHLY,
    "raw_score rank_score",
)
def score_stamps(spark, d):
    traded = market.bars(spark, d).select("date", "ticker", F.log(1 + F.col("volume")).alias("traded"))
    found = score_table(traded, "traded", "volume", "1.0", ["bars.volume"])
    return found.select("signal", "version", F.array_join("inputs", ",").alias("inputs"), "date", "ticker", "raw_score", "rank_score")


@query(
    """SELECT kind, ticker, min(known_on) AS first_known, max(known_on) AS last_known, count(*)::BIGINT AS n FROM (SELECT 'prices' AS kind, ticker, date AS known_on FROM bars UNION ALL
    SELECT 'estimates', ticker, estimate_date FROM estimates UNION ALL SELECT 'fundamentals', ticker, report_date FROM fundamentals UNION ALL SELECT 'ownership', ticker, as_of_date FROM ownership) GROUP BY ALL""",
    f"{MONTHLY}, {ESTIMATES}, {FUNDAMENTALS}, {OWNERSHIP}",
)
def knowledge_days(spark, d):
    tables = {"prices": market.bars(spark, d), "estimates": market.estimates(spark, d), "fundamentals": market.fundamentals(spark, d), "ownership": market.ownership(spark, d)}
    return core.knowledge_days(tables).groupBy("kind", "ticker").agg(F.min("known_on").alias("first_known"), F.max("known_on").alias("last_known"), F.count(F.lit(1)).alias("n"))


def _ics(spark, d, h=1):
    """The ICs from one look at the bars: scores and forward returns of a ticker come from the same window."""
    ahead = F.lead("adjusted_close", h).over(core.by_ticker()) / F.col("adjusted_close") - 1
    return core.paired_ic(three_signals(market.bars(spark, d).withColumn("fwd", ahead), "fwd").where("fwd is not null"))


ICS = f"{MONTHLY}, {FWD.format(h=1)}, {SCORES}, {IC}"


@query("SELECT * FROM ics", ICS, "ic")
def daily_ic(spark, d):
    return _ics(spark, d)


@query(
    """SELECT signal, mean_ic, ic_std, positive_ratio, n_days, CASE WHEN ic_std > 0 THEN mean_ic / ic_std ELSE 0 END AS icir FROM (SELECT signal, avg(ic) AS mean_ic, coalesce(stddev_samp(ic), 0) AS ic_std,
    avg((ic > 0)::INT::DOUBLE) AS positive_ratio, count(*)::BIGINT AS n_days FROM ics GROUP BY signal)""", ICS, "mean_ic ic_std positive_ratio icir",
)
def ic_summary(spark, d):
    return core.ic_summary(_ics(spark, d))


@query("SELECT signal, avg(ic) AS mean_ic, count(*)::BIGINT AS n_days FROM ics GROUP BY signal", f"{MONTHLY}, {FWD.format(h=63)}, {SCORES}, {IC}", "mean_ic")
def decay_ic(spark, d):
    bars = market.bars(spark, d)
    return core.ic_summary(core.daily_ic(three_signals(bars), core.forward_return(bars, 63))).select("signal", "mean_ic", "n_days")


REGIME_CTES = f"{RET.format(k=1, src='bars')}, {MARKET}, {REGIMES}"


@query("SELECT * FROM regimes", f"{MONTHLY}, {REGIME_CTES}")
def regime_labels(spark, d):
    return core.regime_labels(market.bars(spark, d))


@query("SELECT signal, regime, avg(ic) AS mean_ic, count(*)::BIGINT AS n_days FROM ics JOIN regimes USING (date) GROUP BY ALL", f"{ICS}, {REGIME_CTES}", "mean_ic")
def regime_ic(spark, d):
    return core.regime_ic(_ics(spark, d), core.regime_labels(market.bars(spark, d)))


LONG_SHORT = """placed AS (SELECT *, row_number() OVER (PARTITION BY signal, date ORDER BY raw_score, ticker) AS place, count(*) OVER (PARTITION BY signal, date) AS m FROM pairs),
    ls AS (SELECT signal, date, avg(fwd) FILTER (place > m - k) - avg(fwd) FILTER (place <= k) - 1 / 10000.0::DOUBLE AS ls FROM (SELECT *, greatest(1, floor(m * (1 / 3.0::DOUBLE))) AS k FROM placed WHERE m >= 5) GROUP BY ALL)"""


def _ls(spark, d):
    bars = market.bars(spark, d)
    return core.long_short(three_signals(bars), core.forward_return(bars, 1))


@query("SELECT * FROM ls", f"{ICS}, {LONG_SHORT}", "ls")
def long_short_returns(spark, d):
    return _ls(spark, d)


CURVE = """eq AS (SELECT signal, date, ls / 100 AS ls, product(1 + ls / 100) OVER (PARTITION BY signal ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM ls),
    curve AS (SELECT *, greatest(1.0::DOUBLE, max(equity) OVER (PARTITION BY signal ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"""


@query("SELECT signal, date, equity, peak, least(0.0::DOUBLE, equity / peak - 1) AS drawdown FROM curve", f"{ICS}, {LONG_SHORT}, {CURVE}", "equity peak drawdown")
def equity_drawdown(spark, d):
    return core.equity_curve(_ls(spark, d).withColumn("ls", F.col("ls") / 100)).drop("ls")


@query(
    """SELECT signal, avg(ls) * 252 AS annualized_return, CASE WHEN stddev_samp(ls) > 0 THEN avg(ls) / stddev_samp(ls) * sqrt(252.0::DOUBLE) ELSE 0 END AS sharpe, min(least(0.0::DOUBLE, equity / peak - 1)) AS max_drawdown
    FROM curve GROUP BY signal""", f"{ICS}, {LONG_SHORT}, {CURVE}", "annualized_return sharpe max_drawdown",
)
def portfolio_stats(spark, d):
    return core.portfolio_stats(_ls(spark, d).withColumn("ls", F.col("ls") / 100))


CORRELATION = "sp AS (SELECT a.signal AS a, b.signal AS b, date, a.raw_score AS x, b.raw_score AS y FROM scores a JOIN scores b USING (date, ticker) WHERE a.signal < b.signal), " + _rho_sql("sr", "sp", "x", "y", "a, b, date")


@query("SELECT a, b, avg(rho) AS mean_rho, avg(abs(rho)) AS mean_abs_rho, count(*)::BIGINT AS n_days FROM sr GROUP BY ALL", f"{MONTHLY}, {SCORES}, {CORRELATION}", "mean_rho mean_abs_rho")
def signal_correlation(spark, d):
    return core.signal_correlation(three_signals(market.bars(spark, d)))


@query("SELECT signal, max(m) AS max_abs FROM (SELECT a AS signal, avg(abs(rho)) AS m FROM sr GROUP BY a, b UNION ALL SELECT b, avg(abs(rho)) FROM sr GROUP BY a, b) GROUP BY signal", f"{MONTHLY}, {SCORES}, {CORRELATION}", "max_abs")
def max_abs_correlation(spark, d):
    pairs = core.signal_correlation(three_signals(market.bars(spark, d)))
    return pairs.select(F.explode(F.array("a", "b")).alias("signal"), "mean_abs_rho").groupBy("signal").agg(F.max("mean_abs_rho").alias("max_abs"))


@query(
    "SELECT signal, avg(ic) AS mean_ic, count(*)::BIGINT AS n_days FROM ics GROUP BY signal",
    f"{MONTHLY}, {FWD.format(h=1)}, {SECTORS}, {SCORES.replace('scores AS', 'plain AS')}, scores AS (SELECT signal, date, ticker, raw_score - avg(raw_score) OVER (PARTITION BY signal, date, sector) AS raw_score FROM plain JOIN sectors USING (ticker)), {IC}",
    "mean_ic",
)
def sector_neutral_ic(spark, d):
    bars = market.bars(spark, d)
    neutral = core.sector_neutral(three_signals(bars), market.sectors(spark, d))
    return core.ic_summary(core.daily_ic(neutral, core.forward_return(bars, 1))).select("signal", "mean_ic", "n_days")


COMMON = "common AS (SELECT * FROM ics WHERE date IN (SELECT date FROM ics GROUP BY date HAVING count(DISTINCT signal) = (SELECT count(DISTINCT signal) FROM ics)))"


@query("SELECT signal, date, n, ic FROM common", f"{ICS}, {COMMON}", "ic")
def common_ic(spark, d):
    return core.common_ic(_ics(spark, d)).select("signal", "date", "n", "ic")


@query("SELECT a.signal AS a, b.signal AS b, covar_samp(a.ic, b.ic) + CASE WHEN a.signal = b.signal THEN 1e-3 ELSE 0 END AS cov FROM common a JOIN common b USING (date) GROUP BY a.signal, b.signal", f"{ICS}, {COMMON}", "cov")
def ic_covariance(spark, d):
    return core.ic_covariance(_ics(spark, d))


@query(
    f"SELECT date, ticker, raw_score, {_rank01_sql('raw_score', 'date')} AS rank_score FROM (SELECT date, ticker, round(sum(z * CASE signal WHEN 'momentum_3' THEN 0.5::DOUBLE WHEN 'reversal_1' THEN 0.3::DOUBLE ELSE 0 END), 9) AS raw_score FROM (SELECT *, {_z_sql('raw_score', 'signal, date')} AS z FROM scores) GROUP BY ALL)",
    f"{MONTHLY}, {SCORES}", "raw_score rank_score",
)
def combine_signals(spark, d):
    mixed = core.combine_signals(three_signals(market.bars(spark, d)), {"momentum_3": 0.5, "reversal_1": 0.3})
    return mixed.withColumn("raw_score", F.round("raw_score", 9)).withColumn("rank_score", rank01("raw_score", "date"))


# The factor language: one query per operator, on the weekly panel with its gaps

_T = "OVER (PARTITION BY ticker ORDER BY date)"


def _frame(f: str, x: str, w: int) -> str:
    over = f"OVER (PARTITION BY ticker ORDER BY date ROWS {w - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} = {w} THEN {f}({x}) {over} END"


def _cs_rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY date) >= 2 THEN (row_number() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}, ticker) - 1)::DOUBLE / (count({x}) OVER (PARTITION BY date) - 1) END"


def _cs_z_sql(x: str) -> str:
    w = "OVER (PARTITION BY date)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {w} >= 2 THEN CASE WHEN stddev_samp({x}) {w} <= 1e-12 THEN 0 ELSE ({x} - avg({x}) {w}) / stddev_samp({x}) {w} END END"


_DSL = {
    "dsl_ret": ("ret", "ret"),
    "dsl_neg": ("(neg close)", "-close"),
    "dsl_abs": ("(abs ret)", "abs(ret)"),
    "dsl_sign": ("(sign ret)", "sign(ret)::DOUBLE"),
    "dsl_log1p_abs": ("(log1p_abs ret)", "sign(ret) * ln(1 + abs(ret))"),
    "dsl_cs_rank": ("(cs_rank volume)", _cs_rank_sql("volume")),
    "dsl_cs_zscore": ("(cs_zscore volume)", _cs_z_sql("volume")),
    "dsl_add": ("(add open volume)", "open + volume"),
    "dsl_sub": ("(sub high low)", "high - low"),
    "dsl_mul": ("(mul close volume)", "close * volume"),
    "dsl_div": ("(div (sub high low) ret)", "CASE WHEN abs(ret) > 1e-12 THEN (high - low) / ret END"),
    "dsl_max": ("(max ret (neg ret))", "CASE WHEN ret IS NOT NULL THEN greatest(ret, -ret) END"),
    "dsl_min": ("(min open ret)", "CASE WHEN open IS NOT NULL AND ret IS NOT NULL THEN least(open, ret) END"),
    "dsl_delay": ("(delay close 3)", f"lag(close, 3) {_T}"),
    "dsl_delta": ("(delta close 5)", f"close - lag(close, 5) {_T}"),
    "dsl_momentum": ("(momentum adjclose 5)", f"CASE WHEN abs(lag(adjclose, 5) {_T}) > 1e-12 THEN adjclose / lag(adjclose, 5) {_T} - 1 END"),
    "dsl_ts_mean": ("(ts_mean close 5)", _frame("avg", "close", 5)),
    "dsl_ts_std": ("(ts_std close 5)", _frame("stddev_samp", "close", 5)),
    "dsl_ts_min": ("(ts_min low 10)", _frame("min", "low", 10)),
    "dsl_ts_max": ("(ts_max high 10)", _frame("max", "high", 10)),
}


def _dsl_query(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        return compiler.evaluate(compiler.panel(_weekly(spark, d)), {"value": parse(text)})

    run.__name__ = name
    query(f"SELECT date, ticker, {sql} AS value FROM panel", f"{WEEKLY}, {PANEL}", "value")(run)


for _name, (_text, _sql) in _DSL.items():
    _dsl_query(_name, _text, _sql)

NESTED = f"n1 AS (SELECT date, ticker, close - lag(close, 5) {_T} AS d5, {_frame('stddev_samp', 'ret', 5)} AS s5 FROM panel), n2 AS (SELECT date, ticker, round(CASE WHEN abs(s5) > 1e-12 THEN d5 / s5 END, 6) AS x FROM n1)"


@query(f"SELECT date, ticker, {_cs_z_sql('x')} AS value FROM n2", f"{WEEKLY}, {PANEL}, {NESTED.replace('round(CASE', '(CASE').replace('END, 6)', 'END)')}", "value")
def dsl_nested(spark, d):
    return compiler.evaluate(compiler.panel(_weekly(spark, d)), {"value": parse("(cs_zscore (div (delta close 5) (ts_std ret 5)))")})


@query(
    f"SELECT 'volume' AS signal, date, ticker, x AS raw_score, {_rank01_sql('x', 'date')} AS rank_score FROM (SELECT date, ticker, volume AS x FROM panel WHERE volume IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 2)",
    f"{WEEKLY}, {PANEL}", "raw_score rank_score",
)
def dsl_to_scores(spark, d):
    values = compiler.evaluate(compiler.panel(_weekly(spark, d)), {"volume": parse("volume")})
    return compiler.long_scores(values, ["volume"]).withColumn("rank_score", rank01("raw_score", ["signal", "date"]))


# Point in time


@query(f"SELECT ticker, report_date, revenue FROM fundamentals WHERE report_date <= DATE '{CUTOFF}'", f"{LINES}, {FUNDAMENTALS}", "revenue")
def asof_filter(spark, d):
    return core.as_of(market.fundamentals(spark, d), CUTOFF, "report_date").select("ticker", "report_date", "revenue")


@query(f"SELECT count(*)::BIGINT AS n_late, min(report_date) AS earliest FROM fundamentals WHERE report_date > DATE '{CUTOFF}'", f"{LINES}, {FUNDAMENTALS}")
def pit_leak_check(spark, d):
    return core.leak_report(market.fundamentals(spark, d), CUTOFF, "report_date")


@query("SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 5 = 0", WEEKLY)
def score_dates(spark, d):
    return core.score_dates(_weekly(spark, d), 5)


@query(
    """SELECT ticker, date, CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' ELSE 'test' END AS part FROM bars
    WHERE date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' OR date BETWEEN DATE '1999-02-01' AND DATE '2001-12-31'""", MONTHLY,
)
def split_by_date(spark, d):
    import datetime as dt

    part = core.split_label(F.col("date"), (dt.date(1995, 1, 1), dt.date(1998, 12, 31)), (dt.date(1999, 2, 1), dt.date(2001, 12, 31)))
    return market.bars(spark, d).select("ticker", "date", part.alias("part")).where("part is not null")


@query("SELECT b.ticker, b.date, f.revenue, f.net_income FROM bars b ASOF LEFT JOIN fundamentals f ON b.ticker = f.ticker AND b.date >= f.report_date", f"{MONTHLY}, {FUNDAMENTALS}", "revenue net_income")
def asof_fundamental(spark, d):
    left = market.bars(spark, d).select("ticker", "date")
    return core.as_of_join(left, market.fundamentals(spark, d), "ticker", "date", "report_date", ["revenue", "net_income"])


@query(
    """SELECT b.own, b.ticker, b.date, f.revenue, f.net_income FROM (SELECT ticker AS own, CASE WHEN month(date) % 2 = 0 THEN 'S00001' ELSE ticker END AS ticker, date FROM bars) b
    ASOF LEFT JOIN fundamentals f ON b.ticker = f.ticker AND b.date >= f.report_date""", f"{MONTHLY}, {FUNDAMENTALS}", "revenue net_income",
)
def asof_hot_ticker(spark, d):
    """One ticker holds half of the rows: its history is dealt by years."""
    left = market.bars(spark, d).select(F.col("ticker").alias("own"), F.when(F.month("date") % 2 == 0, "S00001").otherwise(F.col("ticker")).alias("ticker"), "date")
    return ranges.as_of_buckets(left, market.fundamentals(spark, d), "ticker", "date", "report_date", ["revenue", "net_income"])


OWN_BASE = """base AS (SELECT o.ticker, o.as_of_date, o.institutional_ownership_pct AS latest, coalesce(b.institutional_ownership_pct, first_value(o.institutional_ownership_pct) OVER (PARTITION BY o.ticker ORDER BY o.as_of_date)) AS baseline
    FROM (SELECT *, (as_of_date - INTERVAL 90 DAY)::DATE AS cutoff FROM ownership) o ASOF LEFT JOIN ownership b ON o.ticker = b.ticker AND o.cutoff >= b.as_of_date)"""


@query("SELECT * FROM base", f"{LINES}, {OWNERSHIP}, {OWN_BASE}", "latest baseline")
def ownership_baseline(spark, d):
    return signals.ownership_change(market.ownership(spark, d))


# Signals

SCORE_DAYS = "days AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)) WHERE i % 3 = 0)"


def _days(spark, d):
    return core.score_dates(market.bars(spark, d), 3)


def _composite_sql(parts: str, source: str) -> str:
    z = " + ".join(f"(1 / 3.0::DOUBLE) * ({_z_sql(p, 'date')})" for p in parts.split())
    return f"SELECT date, ticker, {z} AS raw_score FROM {source}"


@query(
    _composite_sql("expert trend management", "parts"),
    f"""{LINES}, {ESTIMATES}, known AS (SELECT *, coalesce(analyst_accuracy, 0.5::DOUBLE) AS a FROM estimates WHERE metric = 'EPS' AND estimate_date <= DATE '{CUTOFF}'),
    own AS (SELECT ticker, CASE WHEN sum(a) > 0 THEN sum(a * value) / sum(a) - avg(value) ELSE 0 END AS expert, -CASE WHEN count(*) > 1 THEN stddev_pop(value) ELSE 0 END AS management FROM known GROUP BY ticker),
    peers AS (SELECT DISTINCT x.ticker, y.ticker AS peer FROM known x JOIN known y USING (analyst_id) WHERE x.ticker <> y.ticker),
    trends AS (SELECT p.ticker, avg(o.expert) AS trend FROM peers p JOIN own o ON p.peer = o.ticker GROUP BY p.ticker),
    parts AS (SELECT DATE '{CUTOFF}' AS date, ticker, expert, management, coalesce(trend, 0) AS trend FROM own LEFT JOIN trends USING (ticker))""", "raw_score",
)
def sig_earnings_surprise(spark, d):
    return signals.earnings_surprise(market.estimates(spark, d), CUTOFF).drop("rank_score")


@query(
    _composite_sql("expert trend management", "parts"),
    f"""{MONTHLY}, {ESTIMATES}, {SCORE_DAYS}, known AS (SELECT d.date, e.*, coalesce(analyst_accuracy, 0.5::DOUBLE) AS a FROM days d JOIN estimates e ON e.estimate_date <= d.date WHERE metric = 'EPS'),
    own AS (SELECT date, ticker, CASE WHEN sum(a) > 0 THEN sum(a * value) / sum(a) - avg(value) ELSE 0 END AS expert, -CASE WHEN count(*) > 1 THEN stddev_pop(value) ELSE 0 END AS management FROM known GROUP BY ALL),
    peers AS (SELECT DISTINCT x.date, x.ticker, y.ticker AS peer FROM known x JOIN known y USING (date, analyst_id) WHERE x.ticker <> y.ticker),
    trends AS (SELECT p.date, p.ticker, avg(o.expert) AS trend FROM peers p JOIN own o ON p.peer = o.ticker AND p.date = o.date GROUP BY ALL),
    parts AS (SELECT date, ticker, expert, management, coalesce(trend, 0) AS trend FROM own LEFT JOIN trends USING (date, ticker))""", "raw_score",
)
def sig_earnings_surprise_dates(spark, d):
    return signals.earnings_surprise_on(market.estimates(spark, d), _days(spark, d)).drop("rank_score")


@query(
    _composite_sql("accruals roa acceleration", "parts"),
    f"""{MONTHLY}, {FUNDAMENTALS}, {SCORE_DAYS}, facts AS (SELECT ticker, report_date, -(net_income - operating_cash_flow) / total_assets AS accruals, net_income / total_assets AS roa,
        coalesce((revenue / nullif(lag(revenue, 1) {_T.replace('date', 'report_date')}, 0) - 1) - (lag(revenue, 1) {_T.replace('date', 'report_date')} / nullif(lag(revenue, 2) {_T.replace('date', 'report_date')}, 0) - 1), 0) AS acceleration FROM fundamentals),
    parts AS (SELECT g.date, g.ticker, accruals, roa, acceleration FROM (SELECT date, ticker FROM days CROSS JOIN (SELECT DISTINCT ticker FROM facts)) g ASOF JOIN facts f ON g.ticker = f.ticker AND g.date >= f.report_date)""", "raw_score",
)
def sig_fundamental(spark, d):
    return signals.fundamental_factors(market.fundamentals(spark, d), _days(spark, d)).drop("rank_score")


@query(
    f"SELECT date, ticker, {_z_sql('momentum', 'date')} AS raw_score FROM parts",
    f"""{MONTHLY}, {OWNERSHIP}, {OWN_BASE}, {SCORE_DAYS}, parts AS (SELECT g.date, g.ticker, latest - baseline AS momentum FROM (SELECT date, ticker FROM days CROSS JOIN (SELECT DISTINCT ticker FROM base)) g
        ASOF JOIN base b ON g.ticker = b.ticker AND g.date >= b.as_of_date)""", "raw_score",
)
def sig_ownership(spark, d):
    return signals.ownership_momentum(market.ownership(spark, d), _days(spark, d)).drop("rank_score")


@query(
    f"SELECT date, ticker, {_z_sql('flow', 'date')} AS raw_score FROM flows",
    f"""{MONTHLY}, {LINKS}, {SCORE_DAYS}, moved AS (SELECT * FROM (SELECT ticker, date, adjusted_close / coalesce(lag(adjusted_close, 21) {_T}, first_value(adjusted_close) {_T}) - 1 AS ret, row_number() {_T} AS i FROM bars) WHERE i >= 2),
    known AS (SELECT g.date, g.related_ticker, m.ret FROM (SELECT date, related_ticker FROM days CROSS JOIN (SELECT DISTINCT related_ticker FROM links)) g ASOF JOIN moved m ON g.related_ticker = m.ticker AND g.date >= m.date),
    flows AS (SELECT k.date, l.ticker, sum(weight * ret) / sum(weight) AS flow FROM links l JOIN known k USING (related_ticker) GROUP BY ALL)""", "raw_score",
)
def sig_supply_chain(spark, d):
    return signals.supply_chain(market.links(spark, d), market.bars(spark, d), _days(spark, d)).drop("rank_score")


# Portfolio and risk

KNOWN_BARS = f"known AS (SELECT * FROM bars WHERE date <= DATE '{BOOK_DAY}')"
VOLS = f"{MONTHLY}, {KNOWN_BARS}, {RET.format(k=1, src='known')}, vols AS (SELECT ticker, stddev_pop(ret) AS vol FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS i FROM ret) WHERE i <= 63 GROUP BY ticker HAVING count(*) >= 2)"
TILT = f"""day AS (SELECT ticker, raw_score FROM scores WHERE signal = 'momentum_3' AND date = (SELECT max(date) FROM known)),
    tilt AS (SELECT ticker, z / greatest(coalesce(nullif(vol, 0), (SELECT median(vol) FROM vols WHERE vol > 0)), 1e-4) AS weight FROM (SELECT *, {_z_sql('raw_score', 'one')} AS z FROM (SELECT *, 1 AS one FROM day)) LEFT JOIN vols USING (ticker))"""
BOOK = """e1 AS (SELECT ticker, greatest(-0.05::DOUBLE, least(0.05::DOUBLE, weight - (SELECT avg(weight) FROM tilt))) AS w FROM tilt),
    legs AS (SELECT sum(w) FILTER (w > 0) AS up, -sum(w) FILTER (w < 0) AS down FROM e1),
    e2 AS (SELECT ticker, w * CASE WHEN up > down AND w > 0 THEN down / up WHEN down > up AND w < 0 THEN up / down ELSE 1 END AS w FROM e1, legs),
    book AS (SELECT ticker, CASE WHEN (SELECT sum(abs(w)) FROM e2) > 1 THEN w * (1.0::DOUBLE / (SELECT sum(abs(w)) FROM e2)) ELSE w END AS weight FROM e2)"""
SCENARIOS = "scenarios AS (SELECT date, ticker, ret FROM ret WHERE date IN (SELECT DISTINCT date FROM ret ORDER BY date DESC LIMIT 63))"
BOOK_CTES = f"{VOLS}, {SCORES}, {TILT}, {BOOK}"
RISK_CTES = f"{BOOK_CTES}, {SCENARIOS}, sr AS (SELECT date, sum(coalesce(weight, 0) * ret) AS ret FROM scenarios LEFT JOIN book USING (ticker) GROUP BY date)"


def _priced(spark, d):
    """The bars, written once for all that a book reads of them."""
    return checkpointed(market.bars(spark, d))


def _tilted(bars):
    known = core.as_of(bars, BOOK_DAY, "date")
    scores = three_signals(known).where("signal = 'momentum_3'")
    day = scores.join(F.broadcast(core.latest_dates(known, 1)), "date").select("ticker", "raw_score")  # one row
    return core.tilt(day, core.trailing_vol(bars, BOOK_DAY))


def _book(bars):
    return core.enforce(_tilted(bars))


def _scenario_returns(spark, d):
    bars = _priced(spark, d)
    return core.scenario_returns(_book(bars), core.scenarios(bars, BOOK_DAY))


@query("SELECT * FROM vols", VOLS, "vol")
def trailing_vol(spark, d):
    return core.trailing_vol(market.bars(spark, d), BOOK_DAY)


@query("SELECT * FROM tilt", f"{VOLS}, {SCORES}, {TILT}", "weight")
def tilt_weights(spark, d):
    return _tilted(_priced(spark, d))


@query("SELECT * FROM book", BOOK_CTES, "weight")
def enforce_weights(spark, d):
    return _book(_priced(spark, d))


@query("SELECT sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0))) AS turnover FROM book n FULL JOIN (SELECT ticker, weight / 2 AS weight FROM book WHERE weight > 0) o USING (ticker)", BOOK_CTES, "turnover")
def turnover(spark, d):
    book = _book(_priced(spark, d))
    return core.turnover(book, book.where("weight > 0").withColumn("weight", F.col("weight") / 2))


@query(
    """SELECT 'position' AS kind, ticker, abs(weight) AS amount FROM tilt WHERE abs(weight) > 0.05::DOUBLE + 1e-9 UNION ALL SELECT 'gross', NULL, sum(abs(weight)) FROM tilt HAVING sum(abs(weight)) > 1 + 1e-9
    UNION ALL SELECT 'net', NULL, sum(weight) FROM tilt HAVING abs(sum(weight)) > 0.05::DOUBLE""", f"{VOLS}, {SCORES}, {TILT}", "amount",
)
def violations(spark, d):
    return core.violations(_tilted(_priced(spark, d)))


@query("SELECT * FROM scenarios", f"{VOLS}, {SCENARIOS}", "ret")
def scenarios(spark, d):
    return core.scenarios(market.bars(spark, d), BOOK_DAY)


@query("SELECT * FROM sr", RISK_CTES, "ret")
def scenario_returns(spark, d):
    return _scenario_returns(spark, d)


@query(
    """SELECT avg(ret) AS expected_return, -max(ret) FILTER (i = greatest(1, ceil((1 - 0.95::DOUBLE) * n))) AS var, -avg(ret) FILTER (i <= greatest(1, floor((1 - 0.95::DOUBLE) * n + 1e-9))) AS cvar
    FROM (SELECT ret, row_number() OVER (ORDER BY ret, date) AS i, count(*) OVER () AS n FROM sr)""", RISK_CTES, "expected_return var cvar",
)
def tail_risk(spark, d):
    return core.tail_risk(_scenario_returns(spark, d))


# Feeds: the tables written as the feeds' JSON and read back by the parsers


@query("SELECT ticker, date, open, high, low, close, volume, CASE WHEN volume % 5 = 0 THEN close ELSE adjusted_close END AS adjusted_close FROM bars WHERE volume % 7 <> 0 AND date <= DATE '2000-12-31'", WEEKLY, PRICE_COLUMNS)
def feed_chart_bars(spark, d):
    bar = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("ts"), F.when(F.col("volume") % 7 != 0, F.col("open")).alias("open"), "high", "low", "close", "volume", F.when(F.col("volume") % 5 != 0, F.col("adjusted_close")).alias("adj"))
    listed = _weekly(spark, d).groupBy("ticker").agg(F.sort_array(F.collect_list(bar)).alias("b"))
    quote = F.struct(*(F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))
    result = F.struct(
        F.struct(F.lit(-18000).alias("gmtoffset")).alias("meta"), F.transform("b.ts", lambda t: t + 18000 + 50400).alias("timestamp"),
        F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.col("b.adj").alias("adjclose"))).alias("adjclose")).alias("indicators"),
    )
    raw = listed.select("ticker", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("body"))
    return feeds.chart_bars(raw, end="2000-12-31")


@query("SELECT ticker, report_date, fiscal_year, fiscal_quarter, total_assets, net_income, operating_cash_flow, revenue FROM fundamentals WHERE report_date <= DATE '2001-12-31'", f"{LINES}, {FUNDAMENTALS}", "total_assets net_income operating_cash_flow revenue")
def feed_company_facts(spark, d):
    facts = market.fundamentals(spark, d).withColumn("filed", F.col("report_date").cast("string"))
    end = F.date_sub("report_date", 45).cast("string")

    def entry(value: Column, days: int, form: str = "10-Q", later: int = 0) -> Column:
        fields = (F.date_sub("report_date", 45 + days).cast("string").alias("start"), end.alias("end"), value.alias("val"), F.date_add("report_date", later).cast("string").alias("filed"))
        return F.struct(*fields, F.col("fiscal_year").alias("fy"), F.concat(F.lit("Q"), F.col("fiscal_quarter").cast("string")).alias("fp"), F.lit(form).alias("form"))

    def tag(c: str) -> Column:
        # the quarter, the year to date in the same filing, an amendment, and the next filing's comparative
        return F.array(entry(F.col(c) * 3, 270), entry(F.col(c), 90), entry(F.col(c) + 1, 90, "10-Q/A"), entry(F.col(c) + 2, 90, later=91))

    tags = {"total_assets": "Assets", "net_income": "NetIncomeLoss", "operating_cash_flow": "NetCashProvidedByUsedInOperatingActivities", "revenue": "SalesRevenueNet"}
    merged = facts.groupBy("ticker").agg(*(F.flatten(F.collect_list(tag(c))).alias(t) for c, t in tags.items()))
    body = F.struct(F.struct(F.struct(*(F.struct(F.struct(F.col(t).alias("USD")).alias("units")).alias(t) for t in tags.values())).alias("us-gaap")).alias("facts"))
    return feeds.company_facts(merged.select("ticker", F.to_json(body).alias("body")), end="2001-12-31")


@query(
    """SELECT ticker, date, CASE WHEN volume % 3 = 0 THEN close ELSE open END AS open, high, low, close, volume, CASE WHEN volume % 4 = 0 THEN close ELSE adjusted_close END AS adjusted_close FROM bars""", MONTHLY, PRICE_COLUMNS,
)
def feed_vendor_prices(spark, d):
    named = market.bars(spark, d).withColumns({"requestId": F.concat("ticker", F.lit("-US")), "day": F.col("date").cast("string")})
    quote = F.struct("requestId", F.col("day").alias("date"), F.col("close").alias("price"), F.when(F.col("volume") % 3 != 0, F.col("open")).otherwise(0.0).alias("priceOpen"), F.col("high").alias("priceHigh"), F.col("low").alias("priceLow"), "volume")
    total = F.struct("requestId", F.col("day").alias("date"), F.col("adjusted_close").alias("price"))
    quotes = named.groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(quote).alias("data"))).alias("body"))
    adjusted = named.where("volume % 4 <> 0").groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(total).alias("data"))).alias("body"))
    return feeds.vendor_prices(quotes, adjusted)[0]


@query("SELECT ticker, count(*)::BIGINT AS n_skipped FROM bars WHERE volume % 7 = 0 GROUP BY ticker", MONTHLY)
def feed_vendor_skipped(spark, d):
    named = market.bars(spark, d).withColumns({"requestId": F.concat("ticker", F.lit("-US")), "day": F.col("date").cast("string")})
    price = F.when(F.col("volume") % 7 == 0, -F.col("close")).otherwise(F.col("close"))
    quote = F.struct("requestId", F.col("day").alias("date"), price.alias("price"), F.col("open").alias("priceOpen"), F.col("high").alias("priceHigh"), F.col("low").alias("priceLow"), "volume")
    quotes = named.groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(quote).alias("data"))).alias("body"))
    return feeds.vendor_prices(quotes, quotes.limit(0))[1].groupBy("ticker").agg(F.count(F.lit(1)).alias("n_skipped"))


LISTING = "listing AS (SELECT s_suppkey AS pos, s_suppkey % 40 AS cik, 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS ticker FROM supplier)"


def _listing(spark, d):
    return market.read(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") % 40).alias("cik"), market.ticker(F.col("s_suppkey")).alias("ticker"))


@query("SELECT min(pos) AS pos, cik, arg_min(ticker, pos) AS ticker FROM listing GROUP BY cik ORDER BY pos LIMIT 25", LISTING)
def feed_universe(spark, d):
    return feeds.universe(_listing(spark, d), 25)


@query("SELECT w.ticker, lpad(cik::VARCHAR, 10, '0') AS cik FROM (SELECT DISTINCT 'S' || lpad(l_suppkey::VARCHAR, 5, '0') AS ticker FROM lineitem) w LEFT JOIN listing USING (ticker)", LISTING)
def feed_cik_lookup(spark, d):
    return feeds.cik_of(market.lines(spark, d).select(F.lower("ticker").alias("ticker")), _listing(spark, d))


# Registry, audit and code scan

_STATUS = {"click": "VALIDATED", "view": "DISCOVERED", "purchase": "PRODUCTION", "signup": "STAGING"}
REGISTRY = f"""reg AS (SELECT 'sig' || user_id::VARCHAR AS name, event_id AS seq, ts AS at, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} ELSE 'RETIRED' END AS status,
    CASE WHEN event_id % 3 = 0 THEN value END AS mean_ic FROM events)"""


def _registry(spark, d):
    status = F.coalesce(F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))[F.col("event_type")], F.lit("RETIRED"))
    events = market.read(spark, d, "events")
    return events.select(F.concat(F.lit("sig"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("mean_ic"))


@query("SELECT name, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(mean_ic, seq) FILTER (mean_ic IS NOT NULL) AS mean_ic FROM reg GROUP BY name", REGISTRY, "mean_ic")
def registry_latest(spark, d):
    return lifecycle.latest(_registry(spark, d)).select("name", "seq", "status", "mean_ic")


@query("SELECT name, max(seq) AS seq, arg_max(mean_ic, seq) FILTER (mean_ic IS NOT NULL) AS mean_ic FROM reg GROUP BY name HAVING arg_max(status, seq) = 'STAGING'", REGISTRY, "mean_ic")
def registry_by_status(spark, d):
    return lifecycle.by_status(_registry(spark, d), "STAGING").select("name", "seq", "mean_ic")


@query("SELECT name, min(seq) FILTER (status = 'VALIDATED') AS validated, min(seq) FILTER (status = 'PRODUCTION') AS promoted, min(seq) FILTER (status = 'RETIRED') AS retired FROM reg GROUP BY name", REGISTRY)
def registry_stamps(spark, d):
    out = lifecycle.stamped(_registry(spark, d).withColumn("at", F.col("seq")))
    return out.select("name", F.col("validated_at").alias("validated"), F.col("promoted_at").alias("promoted"), F.col("retired_at").alias("retired"))


@query(
    """SELECT name, seq, before, status FROM (SELECT name, seq, status, lag(status) OVER (PARTITION BY name ORDER BY seq) AS before FROM reg) WHERE (before IS NULL AND status <> 'DISCOVERED') OR (before IS NOT NULL
    AND before || '>' || status NOT IN ('DISCOVERED>VALIDATED', 'VALIDATED>STAGING', 'STAGING>PRODUCTION', 'PRODUCTION>RETIRED', 'DISCOVERED>RETIRED', 'VALIDATED>RETIRED', 'STAGING>RETIRED'))""", REGISTRY,
)
def registry_bad_transitions(spark, d):
    return lifecycle.bad_transitions(_registry(spark, d))


def _entries(spark, d, chain: Column) -> DataFrame:
    """Events as hashed entries of chains, some with a wrong hash before and some with another text than was hashed."""
    body = F.concat(F.col("event_id").cast("string"), "props")
    rows = market.read(spark, d, "events").select(chain.alias("chain"), F.col("event_id").alias("seq"), body.alias("body"), F.sha2(body, 256).alias("hash"))
    return rows.withColumn("body", F.when(F.col("seq") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))


@query(
    """SELECT user_id AS chain, event_id AS seq, prev_hash IS NOT DISTINCT FROM lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS linked, event_id % 97 <> 0 AS intact FROM
    (SELECT *, CASE WHEN event_id % 89 = 0 THEN 'x' ELSE lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) END AS prev_hash FROM (SELECT user_id, event_id, sha256(event_id::VARCHAR || props) AS hash FROM events))""",
)
def audit_verify(spark, d):
    before = F.lag("hash").over(W.partitionBy("chain").orderBy("seq"))
    entries = _entries(spark, d, F.col("user_id"))
    return lifecycle.chain(entries.withColumn("prev_hash", F.when(F.col("seq") % 89 == 0, "x").otherwise(before))).select("chain", "seq", "linked", "intact")


@query(
    """SELECT event_id AS seq, prev_hash IS NOT DISTINCT FROM lag(hash) OVER (ORDER BY event_id) AS linked, event_id % 97 <> 0 AS intact FROM
    (SELECT *, CASE WHEN event_id % 89 = 0 THEN 'x' ELSE lag(hash) OVER (ORDER BY event_id) END AS prev_hash FROM (SELECT event_id, sha256(event_id::VARCHAR || props) AS hash FROM events))""",
)
def audit_verify_long(spark, d):
    """All events as one chain, which no task holds whole."""
    entries = ranges.lagged(_entries(spark, d, F.lit(0)), ["chain"], ["seq"], "hash", "before")
    return lifecycle.long_chain(entries.withColumn("prev_hash", F.when(F.col("seq") % 89 == 0, "x").otherwise(F.col("before"))).drop("before")).select("seq", "linked", "intact")


@query(
    r"""WITH lines AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS value, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
    SELECT path, line, unnest(list_filter([
        CASE WHEN regexp_matches(value, 'os\.(environ|getenv)') THEN 'environment access' END, CASE WHEN regexp_matches(value, '^\s*print\(') THEN 'print call' END,
        CASE WHEN regexp_matches(value, '^\s*except\s*:') THEN 'bare except' END,
        CASE WHEN regexp_matches(value, '(?i)(api_?key|password|secret|token)\s*=\s*[''"][^''"]{8,}[''"]') THEN 'credential literal' END,
        CASE WHEN regexp_matches(value, '(datetime\.now|date\.today|time\.time)\(') THEN 'wall clock' END], lambda r : r IS NOT NULL)) AS rule FROM lines""",
)
def code_scan(spark, d):
    lines = market.read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lifecycle.code_findings(lines.withColumn("line", (F.col("line") + 1).cast("long")))


# Streaming


@query(f"SELECT date, ticker, CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END AS value FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING)", f"{MONTHLY}, {PANEL}", "value")
def stream_rolling_mean(spark, d):
    """The panel as a stream of three batches; every ticker's last slots are the state."""
    from quantloom.streaming.filings import run_to_end
    from quantloom.streaming.rolling import replayed, rolling

    slots = compiler.panel(market.bars(spark, d)).select("date", "ticker", F.col("close").alias("value"))
    return run_to_end(rolling(replayed(slots, ("1995-01-01", "1998-01-01")), "ts_mean", 5), "append")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, sum(value) AS total FROM events GROUP BY ALL", doubles="total")
def stream_activity(spark, d):
    from quantloom.streaming.filings import activity, run_to_end, stream_table

    schema = market.read(spark, d, "events").schema
    events = stream_table(spark, d, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return run_to_end(activity(events, "ts", "event_type", "value")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def stream_first_filings(spark, d):
    from quantloom.streaming.filings import first_filings, run_to_end, stream_table

    events = stream_table(spark, d, "events.parquet", market.read(spark, d, "events").schema)
    keyed = events.select("user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("at"))
    return run_to_end(first_filings(keyed, ["user_id", "event_type", "day"], "at"), "append").select("user_id", "event_type", "day")


# Searches, books and verdicts: results of iterative or driver-side numerics over Spark plans


@query()
def backtest_report(spark, d):
    from quantloom.plans.backtest import run_backtest

    bars = checkpointed(market.bars(spark, d))
    scores = three_signals(bars).where("signal = 'momentum_3'")
    found = run_backtest(scores, bars, n_trials=3, others=three_signals(bars).where("signal <> 'momentum_3'"), sectors=market.sectors(spark, d))
    keep = {k: float(v) for k, v in found.items() if isinstance(v, int | float) and not isinstance(v, bool)} | {f"regime_{k}": v for k, v in found["regimes"].items()}
    keep |= {"passed": float(found["passed"])} | {f"failed: {why}": 1.0 for why in found["reasons"]}
    return spark.createDataFrame(sorted(keep.items()), "statistic string, amount double")


#: The three signals' mean ICs and covariances on common days as one row, and the solution of the 3 x 3 system by cofactors.
SOLVED = """moments AS (SELECT avg(m) AS x, avg(r) AS y, avg(v) AS z, var_samp(m) + 1e-3 AS a, covar_samp(m, r) AS b, covar_samp(m, v) AS c, var_samp(r) + 1e-3 AS d, covar_samp(r, v) AS e, var_samp(v) + 1e-3 AS f
    FROM (SELECT date, max(ic) FILTER (signal = 'momentum_3') AS m, max(ic) FILTER (signal = 'reversal_1') AS r, max(ic) FILTER (signal = 'volume') AS v FROM common GROUP BY date)),
    solved AS (SELECT (d * f - e * e) * x + (c * e - b * f) * y + (b * e - c * d) * z AS m, (c * e - b * f) * x + (a * f - c * c) * y + (b * c - a * e) * z AS r,
        (b * e - c * d) * x + (b * c - a * e) * y + (a * d - b * b) * z AS v, sign(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) AS s FROM moments)"""


@query(
    "SELECT unnest(['momentum_3', 'reversal_1', 'volume']) AS signal, unnest([m, r, v]) * s / (abs(m) + abs(r) + abs(v)) AS weight FROM solved", f"{ICS}, {COMMON}, {SOLVED}", "weight",
)
def optimal_weights(spark, d):
    from quantloom.plans.research import ic_weights

    return spark.createDataFrame(list(ic_weights(checkpointed(_ics(spark, d))).items()), "signal string, weight double")


@query()
def research_book(spark, d):
    from quantloom.plans.research import four_signals
    from quantloom.plans.research import research_book as build

    bars = checkpointed(market.bars(spark, d))
    days = checkpointed(core.score_dates(bars, 3))
    estimates, facts, owned, linked = (checkpointed(f(spark, d)) for f in (market.estimates, market.fundamentals, market.ownership, market.links))
    scores = four_signals(bars, estimates, facts, owned, linked, days)
    return build(scores, bars)[0]


@query(
    """SELECT unnest(['momentum_3', 'reversal_1', 'volume']) AS signal, unnest([NULL, r, CASE WHEN coalesce(abs(mv), 0) >= 0.5 THEN 'momentum_3' WHEN r IS NULL AND coalesce(abs(rv), 0) >= 0.5 THEN 'reversal_1' END]) AS clashes_with
    FROM (SELECT max(rho) FILTER (a = 'momentum_3' AND b = 'volume') AS mv, max(rho) FILTER (a = 'reversal_1') AS rv, CASE WHEN abs(max(rho) FILTER (b = 'reversal_1')) >= 0.5 THEN 'momentum_3' END AS r
    FROM (SELECT a, b, avg(rho) AS rho FROM sr GROUP BY ALL))""", f"{MONTHLY}, {SCORES}, {CORRELATION}",
)
def select_signals(spark, d):
    from quantloom.plans import stats

    rho = {(r["a"], r["b"]): r["mean_rho"] for r in core.signal_correlation(three_signals(market.bars(spark, d))).collect()}
    kept, dropped = stats.select_signals(["momentum_3", "reversal_1", "volume"], rho)
    return spark.createDataFrame([(k, None) for k in kept] + list(dropped.items()), "signal string, clashes_with string")


@query()
def cvar_book(spark, d):
    from quantloom.plans.portfolio import cvar_portfolio

    known = checkpointed(core.as_of(market.bars(spark, d), BOOK_DAY, "date"))
    day = known.agg(F.max("date")).first()[0]
    return cvar_portfolio(three_signals(known).where("signal = 'momentum_3'"), known, day)[0]


@query()
def mined_factors(spark, d):
    from quantloom.plans.miner import mine

    return spark.createDataFrame(mine(market.bars(spark, d)), "expression string, fitness double, mean_ic double, n_evaluated long")
