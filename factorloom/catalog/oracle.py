"""The registered queries once more, as plain SQL over the source tables.

Every statement is a chain of common table expressions.  ``statement`` adds the ones that a
query needs.  The texts follow the definitions, not the Spark plans: ranks and cuts are
ordinary window functions here.
"""

from __future__ import annotations

import re

from ..functions.scalars import OPEN_END
from ..operators import jobs as J
from ..operators import textscan as Z
from ..operators.factors import COMPUTABLE, FACTORS
from ..sources.market_tables import CHANGES, EVENT_STATES, PRIORITIES, WIDE_SERIES

OPEN = f"DATE '{OPEN_END}'"


def r(expression: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({expression}) * {scale} + 0.5001e0) / {scale}"


def growth(expression: str) -> str:
    """Compounded growth can be huge; the number of digits kept falls with its size."""
    return (
        f"CASE WHEN {expression} < 1e3 THEN {r(expression)} WHEN {expression} < 1e9 THEN {r(expression, 2)} "
        f"WHEN {expression} < 1e15 THEN floor({expression} / 1e6 + 0.5001e0) * 1e6 ELSE round({expression} / 1e15) * 1e15 END"
    )


def div(numerator: str, denominator: str) -> str:
    return f"CASE WHEN abs({denominator}) > 1e-12 THEN ({numerator}) / ({denominator}) END"


def avg_rank(value: str, partition: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {partition} ORDER BY {value}) + "
        f"(count(*) OVER (PARTITION BY {partition}, {value}) - 1) / 2e0)"
    )


def _resolved(text: str) -> str:
    """Character references replaced by their characters, part by part behind each ampersand."""
    name = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);', 1)"
    known = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": "\u00a0"}
    named = " ".join(f"WHEN {name} = '{n}' THEN '{c}' || p[{len(n) + 2}:]" for n, c in known.items())
    code = f"CASE WHEN {name}[2:2] IN ('x', 'X') THEN TRY_CAST('0x' || {name}[3:] AS INTEGER) ELSE TRY_CAST({name}[2:] AS INTEGER) END"
    numeric = f"WHEN {name}[1:1] = '#' AND ({code}) BETWEEN 1 AND 1114111 AND ({code}) NOT BETWEEN 55296 AND 57343 THEN chr({code}) || p[length({name}) + 2:]"
    parts = f"string_split({text}, '&')"
    return f"{parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: CASE {named} {numeric} ELSE '&' || p END), '')"


def quantile(value: str, q: str, order_column: str = "rn", size: str = "n") -> str:
    """Interpolated quantile inside an aggregate over rows numbered from 1."""
    pos = f"round((max({size}) - 1) * {q}, 6)"
    place = f"round(({size} - 1) * {q}, 6)"
    low = f"max({value}) FILTER (WHERE {order_column} - 1 = floor({place}))"
    high = f"max({value}) FILTER (WHERE {order_column} - 1 = ceil({place}))"
    return f"({low} + ({high} - {low}) * ({pos} - floor({pos})))"


def correlation(x: str, y: str) -> str:
    return (
        f"CASE WHEN count(*) > 1 AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 "
        f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    )


def role_correlation(role: str) -> str:
    x, y = (f"CASE WHEN role = '{role}' THEN {c} END" for c in ("rp", "rl"))
    return (
        f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 "
        f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    )


_MACRO = list(PRIORITIES)
_SIGNALS = {f.signal: f for f in COMPUTABLE}


def _signal_rows() -> str:
    parts = []
    for name, f in _SIGNALS.items():
        part = "exchcd" if f.scope == "local" else "0"
        parts.append(
            f"SELECT '{name}' AS signal, formation_date, permno, ret_1m_fwd, {f.source_column} AS raw, "
            f"{part} AS grp, {f.direction}e0 AS dir FROM fp"
        )
    return " UNION ALL ".join(parts)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else f"'{v}'"
                                     for v in row) + ")" for row in rows)


def _horizon(h: int) -> str:
    w = "PARTITION BY permno ORDER BY date"
    ahead = f"({w} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    full = f"count(ret) OVER {ahead} = {h}"
    text = f"CASE WHEN {full} THEN product(1 + ret) OVER {ahead} - 1 END AS ret_{h}m_fwd"
    if h != 1:
        text += f", CASE WHEN {full} THEN lead(date, {h}) OVER ({w}) END AS forward_return_end_{h}m"
    return text


def _momentum(rows: int, least: int) -> str:
    w = f"(PARTITION BY permno ORDER BY formation_date ROWS BETWEEN {rows + 1} PRECEDING AND 2 PRECEDING)"
    x = "CASE WHEN ret_1m > -1 THEN ln(1 + ret_1m) END"
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN exp(sum({x}) OVER {w}) - 1 END"


def _yoy(name: str) -> str:
    prior = f"lag({name}, 4) OVER (PARTITION BY gvkey ORDER BY datadate)"
    return div(f"{name} - {prior}", f"abs({prior})")


_COMP = ("pb", "pe_proxy", "roe", "debt_to_assets", "liabilities_to_assets", "revenue_yoy", "net_income_yoy",
         "available_lag_days")
_IBES = ("mean_estimate", "estimate_dispersion", "num_estimates", "revision_1m", "surprise", "target_price_mean",
         "target_revision_balance_1m")
COMP_COLUMNS = [f"compustat__{c}" for c in _COMP]
IBES_COLUMNS = [f"ibes__{c}" for c in _IBES]

CTES: dict[str, str] = {
    "sm0": """SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS date,
        avg(l_extendedprice / l_quantity) AS prc, sum(l_quantity) AS shrout, CAST(count(*) AS DOUBLE) AS vol
        FROM lineitem GROUP BY 1, 2""",
    "sm": """SELECT permno, permno AS permco, date, prc,
        prc / lag(prc) OVER (PARTITION BY permno ORDER BY date) - 1 AS ret, shrout, vol,
        CAST(1 + permno % 2 AS DOUBLE) AS cfacpr FROM sm0""",
    "nh": """SELECT s_suppkey AS permno, s_name AS comnam, 'T' || s_suppkey AS ticker, 10 + s_suppkey % 3 AS shrcd,
        1 + (s_nationkey + n) % 4 AS exchcd,
        CASE WHEN n = 0 THEN DATE '1995-01-01' ELSE DATE '1998-07-01' END AS namedt,
        CASE WHEN n = 0 THEN DATE '1998-06-30' END AS nameenddt FROM supplier, (VALUES (0), (1)) v(n)""",
    "listed": "SELECT * FROM nh WHERE shrcd IN (10, 11) AND exchcd IN (1, 2, 3)",
    "cl": """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS gvkey, CASE WHEN n = 0 THEN 'P' ELSE 'C' END AS linkprim,
        CASE WHEN n = 0 THEN 'LC' ELSE 'LU' END AS linktype, s_suppkey AS lpermno,
        CASE WHEN n = 0 THEN DATE '1995-01-01' WHEN s_suppkey % 7 = 0 THEN DATE '1998-01-01'
             ELSE DATE '1998-07-01' END AS linkdt,
        CASE WHEN n = 0 THEN DATE '1998-06-30' END AS linkenddt FROM supplier, (VALUES (0), (1)) v(n)""",
    "fq": """SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS gvkey, datadate,
        CASE WHEN k % 5 <> 0 THEN datadate + CAST(20 + k % 60 AS INTEGER) END AS rdq, revtq / 1000 AS niq, ceqq, revtq,
        ceqq * 3 AS atq, ceqq * 2 AS ltq, dlttq, CASE WHEN k % 3 <> 0 THEN dlttq / 2 END AS dlcq, cshoq,
        mean_price / 100 AS prccq, revtq / 1000 / cshoq AS epspxq
        FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS k,
              last_day(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) AS DATE) + INTERVAL 2 MONTH) AS datadate,
              sum(o_totalprice) AS revtq, max(o_totalprice) AS ceqq, min(o_totalprice) AS dlttq,
              CAST(count(*) AS DOUBLE) AS cshoq, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1, 2)""",
    "tl": """SELECT 'T' || s_suppkey AS ticker, s_suppkey AS permno, DATE '1995-01-01' AS sdate,
        CAST(s_suppkey % 3 AS DOUBLE) AS score FROM supplier""",
    "em": """SELECT 'T' || k AS ticker, statpers, d / n AS meanest,
        sqrt(CAST(n * dd - d * d AS DOUBLE) / nullif(n * (n - 1), 0)) AS stdev, CAST(n AS DOUBLE) AS numest, t / n AS actual,
        statpers + CAST(10 * (k % 3 - 1) AS INTEGER) AS known
        FROM (SELECT l_suppkey AS k, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) + 14 AS statpers,
              CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
              CAST(sum(pow(round(l_discount * 100), 2)) AS BIGINT) AS dd,
              CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
    "tm": """SELECT 'T' || l_suppkey AS ticker, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) + 14 AS statpers,
        avg(l_extendedprice) AS meanptg, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS up,
        CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS down, CAST(count(*) AS DOUBLE) AS numest
        FROM lineitem GROUP BY 1, 2""",
    "md": "SELECT CAST(o_orderdate AS DATE) AS date, " + ", ".join(
        f"avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}') AS {n}" for n, p in PRIORITIES.items()
    ) + " FROM orders GROUP BY 1",
    "lab": "SELECT *, lead(date) OVER (PARTITION BY permno ORDER BY date) AS forward_return_start, "
        "lead(date) OVER (PARTITION BY permno ORDER BY date) AS forward_return_end, "
        + ", ".join(_horizon(h) for h in (1, 3, 6)) + " FROM sm",
    "panel": f"""SELECT m.permno, m.permco, m.date AS formation_date, abs(m.prc) AS price, abs(m.prc) / m.cfacpr AS adjusted_price,
        m.ret AS ret_1m, m.shrout, m.vol, abs(m.prc) * m.shrout * 1000 AS market_cap, n.shrcd, n.exchcd,
        m.forward_return_start, m.forward_return_end, m.ret_1m_fwd, m.ret_3m_fwd, m.forward_return_end_3m,
        m.ret_6m_fwd, m.forward_return_end_6m
        FROM lab m JOIN listed n ON m.permno = n.permno AND m.date BETWEEN n.namedt AND coalesce(n.nameenddt, {OPEN})
        QUALIFY row_number() OVER (PARTITION BY m.permno, m.date ORDER BY n.namedt DESC) = 1""",
    "crsp": f"""SELECT permno, formation_date, {_momentum(11, 8)} AS crsp__mom_12_2, {_momentum(5, 4)} AS crsp__mom_6_2,
        ret_1m AS crsp__reversal_1m, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS crsp__log_size FROM panel""",
    "ratios": f"""SELECT gvkey, datadate, coalesce(rdq, datadate + 90) AS available_date,
        {div('prccq * cshoq', 'ceqq')} AS compustat__pb, {div('prccq', 'epspxq')} AS compustat__pe_proxy,
        {div('niq', 'ceqq')} AS compustat__roe,
        {div('coalesce(dlttq, 0) + coalesce(dlcq, 0)', 'atq')} AS compustat__debt_to_assets,
        {div('ltq', 'atq')} AS compustat__liabilities_to_assets, {_yoy('revtq')} AS compustat__revenue_yoy,
        {_yoy('niq')} AS compustat__net_income_yoy,
        CAST(coalesce(rdq, datadate + 90) - datadate AS DOUBLE) AS compustat__available_lag_days FROM fq""",
    "known_fund": f"""SELECT * FROM (SELECT x.*, l.lpermno AS permno FROM ratios x
        JOIN cl l ON x.gvkey = l.gvkey AND x.datadate BETWEEN l.linkdt AND coalesce(l.linkenddt, {OPEN})
        QUALIFY row_number() OVER (PARTITION BY x.gvkey, x.datadate, l.lpermno
            ORDER BY CASE l.linkprim WHEN 'P' THEN 0 WHEN 'C' THEN 1 ELSE 2 END) = 1)
        QUALIFY row_number() OVER (PARTITION BY permno, available_date ORDER BY datadate DESC, gvkey DESC) = 1""",
    "summ": f"""SELECT ticker, statpers AS available_date, meanest AS ibes__mean_estimate,
        {div('stdev', 'abs(meanest)')} AS ibes__estimate_dispersion, numest AS ibes__num_estimates,
        {div('meanest - prev', 'abs(prev)')} AS ibes__revision_1m,
        CASE WHEN known <= statpers THEN actual - meanest END AS ibes__surprise
        FROM (SELECT *, lag(meanest) OVER (PARTITION BY ticker ORDER BY statpers) AS prev FROM em)""",
    "targ": f"""SELECT ticker, statpers AS available_date, meanptg AS ibes__target_price_mean,
        {div('up - down', 'numest')} AS ibes__target_revision_balance_1m FROM tm""",
    "known_est": """SELECT l.permno, e.* EXCLUDE (ticker) FROM (SELECT * FROM summ FULL JOIN targ USING (ticker, available_date)) e
        JOIN tl l ON e.ticker = l.ticker AND l.sdate <= e.available_date""",
    "mm": "SELECT last_day(date) AS formation_date, " + ", ".join(
        f"arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS macro__{c}" for c in _MACRO
    ) + " FROM md GROUP BY 1",
    "with_comp": "SELECT p.*, " + ", ".join(f"f.{c}" for c in COMP_COLUMNS) + """ FROM panel p
        ASOF LEFT JOIN known_fund f ON p.permno = f.permno AND p.formation_date >= f.available_date""",
    "with_est": "SELECT p.*, " + ", ".join(f"f.{c}" for c in IBES_COLUMNS) + """ FROM with_comp p
        ASOF LEFT JOIN known_est f ON p.permno = f.permno AND p.formation_date >= f.available_date""",
    "fp": """SELECT w.*, c.* EXCLUDE (permno, formation_date), m.* EXCLUDE (formation_date) FROM with_est w
        JOIN crsp c USING (permno, formation_date) LEFT JOIN mm m ON last_day(w.formation_date) = m.formation_date""",
    "sig": _signal_rows(),
    "scored": """SELECT signal, formation_date, permno, ret_1m_fwd, CAST(CAST(raw AS FLOAT) AS DOUBLE) AS raw,
        CAST(CAST(greatest(-5e0, least(5e0, (raw - m) / s)) * dir AS FLOAT) AS DOUBLE) AS score
        FROM (SELECT *, avg(raw) OVER (PARTITION BY signal, formation_date, grp) AS m,
              stddev_samp(raw) OVER (PARTITION BY signal, formation_date, grp) AS s FROM sig WHERE grp IS NOT NULL)
        WHERE raw IS NOT NULL AND s > 1e-12""",
    "reg": "SELECT * FROM (VALUES " + _values(
        (f.factor_id, f.name_ko, f.family, f.scope, f.source_column, f.signal, n) for n, f in enumerate(COMPUTABLE, 1)
    ) + ") t(factor_id, factor_name_ko, factor_family, scope, source_column, signal, position)",
    "numbered": """SELECT signal, formation_date, score, ret_1m_fwd,
        row_number() OVER (PARTITION BY signal, formation_date ORDER BY score) AS rn,
        count(*) OVER (PARTITION BY signal, formation_date) AS n FROM scored WHERE ret_1m_fwd IS NOT NULL""",
    "qs": "SELECT * FROM (VALUES (0.1e0), (0.15e0), (0.2e0), (0.3e0)) t(q)",
    "cuts": f"""SELECT signal, formation_date, q, max(n) AS n, {quantile('score', '(1e0 - q)')} AS hi, {quantile('score', 'q')} AS lo
        FROM numbered, qs GROUP BY 1, 2, 3""",
    "legs": """SELECT g.signal, g.formation_date, g.q,
        CASE WHEN max(n) >= 10 THEN avg(ret_1m_fwd) FILTER (WHERE score >= hi) END AS long_return,
        CASE WHEN max(n) >= 10 THEN avg(ret_1m_fwd) FILTER (WHERE score <= lo) END AS short_return,
        CASE WHEN max(n) >= 10 THEN count(ret_1m_fwd) FILTER (WHERE score >= hi) ELSE 0 END AS long_count,
        CASE WHEN max(n) >= 10 THEN count(ret_1m_fwd) FILTER (WHERE score <= lo) ELSE 0 END AS short_count
        FROM (SELECT s.*, qs.q FROM scored s, qs) g LEFT JOIN cuts c
        ON g.signal = c.signal AND g.formation_date = c.formation_date AND g.q = c.q GROUP BY 1, 2, 3""",
    "all_fr": """SELECT formation_date, factor_id, q, long_return, short_return, long_return - short_return AS ls,
        long_count, short_count FROM legs JOIN reg USING (signal)""",
    "fr": "SELECT * FROM all_fr WHERE q = 0.2e0",
    # one row per panel date: the month-end snapshot of that date's month
    "pm": """SELECT d.formation_date, m.* EXCLUDE (formation_date) FROM (SELECT DISTINCT formation_date FROM panel) d
        LEFT JOIN mm m ON last_day(d.formation_date) = m.formation_date""",
    "galpha": """SELECT factor_id, m AS mean_return, v AS volatility, c AS observations,
        greatest(0e0, m / coalesce(nullif(v, 0), median(abs(m)) OVER () + 1e-9)) AS global_score
        FROM (SELECT factor_id, avg(ls) AS m, stddev_pop(ls) AS v, count(ls) AS c FROM fr WHERE ls IS NOT NULL GROUP BY 1)""",
    "states": " UNION ALL ".join(
        f"SELECT formation_date, '{c}' AS col, CASE WHEN macro__{c} >= (SELECT median(macro__{c}) FROM pm) "
        f"THEN 'high' ELSE 'low' END AS state FROM pm" for c in sorted(_MACRO)
    ),
    "lalpha": """SELECT factor_id, greatest(0e0, max(m)) AS local_score FROM (
        SELECT factor_id, col, state, avg(ls) AS m FROM fr JOIN states USING (formation_date) WHERE ls IS NOT NULL
        GROUP BY 1, 2, 3) GROUP BY 1""",
    "alpha": f"""SELECT *, (rank() OVER (ORDER BY global_score) + (count(*) OVER (PARTITION BY global_score) - 1) / 2e0
            + rank() OVER (ORDER BY local_score) + (count(*) OVER (PARTITION BY local_score) - 1) / 2e0)
            / count(*) OVER () AS combined_score
        FROM (SELECT g.* EXCLUDE (global_score), {r('global_score', 12)} AS global_score, {r('local_score', 12)} AS local_score
              FROM galpha g JOIN lalpha USING (factor_id))""",
    "dated": """SELECT formation_date, factor_id, ls, row_number() OVER (PARTITION BY factor_id ORDER BY formation_date) - 1 AS i,
        count(*) OVER (PARTITION BY factor_id) AS n FROM fr JOIN pm USING (formation_date) WHERE ls IS NOT NULL""",
    "folds": """SELECT d.*, s.start, CAST((s.start - 36) // 12 AS INTEGER) AS fold,
        CASE WHEN d.i >= s.start THEN 'holdout' WHEN d.i >= greatest(24, s.start - 12) THEN 'validation' ELSE 'train' END AS role
        FROM dated d JOIN (SELECT DISTINCT factor_id, unnest(range(36, n, 12)) AS start FROM dated) s
        ON d.factor_id = s.factor_id AND d.i < s.start + 12""",
    "fits": "SELECT factor_id, fold, avg(ls) AS prediction FROM folds WHERE role = 'train' GROUP BY 1, 2",
    "fitted": "SELECT f.*, prediction FROM folds f JOIN fits USING (factor_id, fold)",
    "fitmetrics": f"""SELECT factor_id, count(DISTINCT fold) AS fold_count, count(*) FILTER (WHERE role = 'train') AS train_rows,
        count(*) FILTER (WHERE role = 'validation') AS validation_rows, count(*) FILTER (WHERE role = 'holdout') AS holdout_rows,
        avg(abs(prediction - ls)) FILTER (WHERE role = 'validation') AS validation_mae,
        avg(abs(prediction - ls)) FILTER (WHERE role = 'holdout') AS holdout_mae,
        {role_correlation('validation')} AS validation_correlation, {role_correlation('holdout')} AS holdout_correlation
        FROM (SELECT *, {avg_rank('prediction', 'factor_id, role')} AS rp, {avg_rank('ls', 'factor_id, role')} AS rl FROM fitted)
        GROUP BY 1""",
    "alloc": """SELECT formation_date, factor_id, prediction, 'holdout' AS split,
        CASE WHEN t > 0 THEN greatest(prediction, 0) / t ELSE 1e0 / c END AS weight
        FROM (SELECT *, sum(greatest(prediction, 0)) OVER (PARTITION BY formation_date) AS t,
              count(*) OVER (PARTITION BY formation_date) AS c FROM fitted WHERE role = 'holdout')""",
    "port": """SELECT formation_date, split, pr AS portfolio_return,
        product(1 + pr) OVER (PARTITION BY split ORDER BY formation_date) - 1 AS cumulative_return
        FROM (SELECT a.formation_date, split, coalesce(sum(weight * ls), 0) AS pr FROM alloc a
              LEFT JOIN fr USING (formation_date, factor_id) GROUP BY 1, 2)""",
    "stock": """SELECT formation_date, permno, split, sum(score * weight) AS stock_score, count(DISTINCT factor_id) AS factors_used,
        max(weight) AS max_factor_weight, sum(weight * weight) AS herfindahl_weight
        FROM scored JOIN reg USING (signal) JOIN alloc USING (formation_date, factor_id) GROUP BY 1, 2, 3""",
    "held": """SELECT s.*, p.ret_1m_fwd AS fwd, row_number() OVER (PARTITION BY s.formation_date, split ORDER BY stock_score) AS rn,
        count(*) OVER (PARTITION BY s.formation_date, split) AS n
        FROM stock s JOIN panel p USING (formation_date, permno) WHERE p.ret_1m_fwd IS NOT NULL""",
    "hcuts": f"""SELECT formation_date, split, {quantile('stock_score', '(1e0 - 0.1e0)')} AS hi,
        {quantile('stock_score', '0.1e0')} AS lo FROM held GROUP BY 1, 2""",
    "members": """SELECT h.*, stock_score >= hi AS in_long, stock_score <= lo AS in_short FROM held h
        JOIN hcuts USING (formation_date, split)""",
    "qlegs": """SELECT formation_date, split, 'long' AS leg, permno, stock_score, fwd FROM members WHERE in_long
        UNION ALL SELECT formation_date, split, 'short', permno, stock_score, fwd FROM members WHERE in_short""",
    "turn": """SELECT formation_date, split, max(share) FILTER (WHERE leg = 'long') AS long_turnover,
        max(share) FILTER (WHERE leg = 'short') AS short_turnover FROM (
          SELECT a.formation_date, a.split, a.leg, CASE WHEN a.g = 1 THEN 1e0 ELSE 1 - count(b.permno) / count(*) END AS share
          FROM (SELECT *, dense_rank() OVER (ORDER BY formation_date, split) AS g FROM qlegs) a
          LEFT JOIN (SELECT *, dense_rank() OVER (ORDER BY formation_date, split) AS g FROM qlegs) b
          ON a.leg = b.leg AND a.permno = b.permno AND a.g = b.g + 1 GROUP BY 1, 2, 3, a.g) GROUP BY 1, 2""",
    "qport": """SELECT m.*, t.long_turnover, t.short_turnover, (t.long_turnover + t.short_turnover) / 2 AS turnover,
        product(1 + portfolio_return) OVER (PARTITION BY m.split ORDER BY m.formation_date) - 1 AS cumulative_return
        FROM (SELECT formation_date, split, avg(fwd) FILTER (WHERE in_long) - avg(fwd) FILTER (WHERE in_short) AS portfolio_return,
              count(*) FILTER (WHERE in_long) AS long_count, count(*) FILTER (WHERE in_short) AS short_count,
              max(max_factor_weight) AS max_factor_weight, avg(herfindahl_weight) AS mean_herfindahl_weight
              FROM members GROUP BY 1, 2) m JOIN turn t USING (formation_date, split)""",
    "months": """SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT date FROM sm WHERE ret IS NOT NULL)""",
    "splits": """SELECT date, CASE WHEN i <= n - 2 * greatest(1, CAST(round_even(n * 0.2e0, 0) AS BIGINT)) THEN 'train'
        WHEN i <= n - greatest(1, CAST(round_even(n * 0.2e0, 0) AS BIGINT)) THEN 'validation' ELSE 'holdout' END AS split
        FROM months""",
    "pred": """SELECT permno AS id, p.date AS period, split, actual, prediction FROM (
        SELECT permno, date, lead(ret) OVER (PARTITION BY permno ORDER BY date) AS actual, -ret AS prediction FROM sm) p
        JOIN splits s ON p.date = s.date""",
    "full_pred": "SELECT * FROM pred WHERE actual IS NOT NULL AND prediction IS NOT NULL",
    "ic": f"""SELECT split, period, count(*) AS rows, {correlation('rp', 'ra')} AS rank_ic,
        {correlation('prediction', 'actual')} AS pearson_ic FROM (SELECT *, {avg_rank('prediction', 'split, period')} AS rp,
        {avg_rank('actual', 'split, period')} AS ra FROM full_pred) GROUP BY 1, 2""",
    "ends": """SELECT *, row_number() OVER (PARTITION BY split, period ORDER BY prediction, id) AS rn,
        count(*) OVER (PARTITION BY split, period) AS n FROM full_pred""",
    "spread": """SELECT split, period, avg(actual) FILTER (WHERE rn > n - greatest(1, ceil(n * 0.1e0)))
        - avg(actual) FILTER (WHERE rn <= greatest(1, ceil(n * 0.1e0))) AS ls FROM ends WHERE n >= 2 GROUP BY 1, 2""",
    "dd": """SELECT split, min(e / peak - 1) AS max_drawdown FROM (
        SELECT *, max(e) OVER (PARTITION BY split ORDER BY period) AS peak FROM (
          SELECT *, product(1 + ls) OVER (PARTITION BY split ORDER BY period) AS e FROM spread WHERE ls IS NOT NULL)) GROUP BY 1""",
    "top": """SELECT split, period, id, dense_rank() OVER (PARTITION BY split ORDER BY period) AS g FROM (
        SELECT *, row_number() OVER (PARTITION BY split, period ORDER BY prediction, id) AS rn,
               count(*) OVER (PARTITION BY split, period) AS n FROM pred WHERE prediction IS NOT NULL)
        WHERE rn > n - greatest(1, ceil(n * 0.1e0))""",
    "tturn": """SELECT c.split, c.period, (c.s + p.s - 2 * coalesce(k, 0)) / greatest(1, c.s + p.s - coalesce(k, 0)) AS turnover
        FROM (SELECT split, period, g, count(*) AS s FROM top GROUP BY 1, 2, 3) c
        JOIN (SELECT split, g, count(*) AS s FROM top GROUP BY 1, 2) p ON c.split = p.split AND c.g = p.g + 1
        LEFT JOIN (SELECT a.split, a.g, count(*) AS k FROM top a JOIN top b ON a.split = b.split AND a.id = b.id AND a.g = b.g + 1
                   GROUP BY 1, 2) o ON c.split = o.split AND c.g = o.g""",
    "stab": """SELECT split, stddev_pop(rank_ic) AS ic_std, avg(CASE WHEN rank_ic > 0 THEN 1e0 ELSE 0e0 END) AS positive_ic_share,
        max(ys) AS yearly_ic_std FROM ic JOIN (SELECT split, CASE WHEN count(*) >= 2 THEN stddev_pop(m) END AS ys FROM (
          SELECT split, year(period) AS y, avg(rank_ic) AS m FROM ic WHERE rank_ic IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        USING (split) WHERE rank_ic IS NOT NULL GROUP BY 1""",
    "err": """SELECT split, avg(CASE WHEN actual <> 0 AND prediction <> 0 THEN CASE WHEN sign(actual) = sign(prediction) THEN 1e0 ELSE 0e0 END END) AS hit_rate,
        avg(pow(actual - prediction, 2)) AS mse, avg(abs(actual - prediction)) AS mae,
        count(*) FILTER (WHERE actual IS NOT NULL AND prediction IS NOT NULL) AS row_count,
        count(DISTINCT period) AS period_count FROM pred GROUP BY 1""",
    # three forecasters of next month's return: reversal, momentum and small size
    "models": """SELECT 'reversal' AS model, permno AS id, formation_date AS period, ret_1m_fwd AS actual, -ret_1m AS prediction FROM fp
        UNION ALL SELECT 'momentum', permno, formation_date, ret_1m_fwd, crsp__mom_12_2 FROM fp
        UNION ALL SELECT 'small_size', permno, formation_date, ret_1m_fwd, -crsp__log_size FROM fp""",
    "mfull": "SELECT * FROM models WHERE actual IS NOT NULL AND prediction IS NOT NULL",
    "mic": f"""SELECT model, avg(ic) AS rank_ic, avg(pic) AS pearson_ic FROM (SELECT model, period, {correlation('rp', 'ra')} AS ic,
        {correlation('prediction', 'actual')} AS pic FROM (
        SELECT *, {avg_rank('prediction', 'model, period')} AS rp, {avg_rank('actual', 'model, period')} AS ra FROM mfull)
        GROUP BY 1, 2) GROUP BY 1""",
    "merr": """SELECT model, avg(CASE WHEN actual <> 0 AND prediction <> 0 THEN CASE WHEN sign(actual) = sign(prediction) THEN 1e0 ELSE 0e0 END END) AS hit_rate,
        avg(pow(actual - prediction, 2)) AS mse, avg(abs(actual - prediction)) AS mae FROM mfull GROUP BY 1""",
    "runs": "SELECT model AS run_id, rank_ic, pearson_ic, hit_rate, mse, mae FROM mic JOIN merr USING (model)",
    "je": "SELECT user_id AS job_id, event_id, event_type, CASE WHEN event_type = 'error' AND event_id % 4 = 3 THEN 'DEAD_LETTER' ELSE CASE event_type "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATES.items()) + " END END AS to_state, ts FROM events",
    "jstate": "SELECT job_id, arg_max(to_state, event_id) AS state, max(event_id) AS last_event_id, count(*) AS events FROM je GROUP BY 1",
    "merged": f"""SELECT coalesce(s.run_id, l.run_id) AS run_id, coalesce(l.job_id, s.job_id) AS job_id, coalesce(l.total, s.total) AS total, j.state AS status
        FROM (SELECT o_orderkey AS run_id, o_custkey AS job_id, {r('o_totalprice', 2)} AS total FROM orders) l
        FULL JOIN (SELECT l_orderkey AS run_id, CAST(max(l_suppkey) AS BIGINT) AS job_id, {r('sum(l_extendedprice)', 2)} AS total FROM lineitem GROUP BY 1) s
        ON l.run_id = s.run_id LEFT JOIN jstate j ON j.job_id = coalesce(l.job_id, s.job_id)""",
    "legal": "SELECT * FROM (VALUES " + _values(
        (a, b) for a, targets in J.LEGAL_TRANSITIONS.items() for b in targets) + ") t(from_state, to_state)",
}

# Reused by several parts of one statement.
_MATERIALIZED = {"fp", "folds", "fitmetrics", "scored", "fr", "legs", "alpha", "fitted", "alloc", "members", "qlegs", "pred", "ends", "panel", "pm"}


def statement(select: str) -> str:
    """The select with the common table expressions it refers to, directly or not."""
    needed: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    parts = [f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({body})" for n, body in CTES.items() if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def _wide_design(series, suffixes) -> str:
    """Last filled value of each series and change in the month of each panel date."""
    values = ", ".join(
        f"{WIDE_SERIES[n]} AS {n}{x}" if not x else f"{WIDE_SERIES[n]} - lag({WIDE_SERIES[n]}, {CHANGES[x]}) OVER (ORDER BY date) AS {n}{x}"
        for n in series for x in suffixes
    )
    names = [f"{n}{x}" for n in series for x in suffixes]
    last = ", ".join(f"arg_max({n}, date) FILTER (WHERE {n} IS NOT NULL) AS macro__{n}" for n in names)
    return f"""SELECT d.formation_date, {_rounded([f"macro__{n}" for n in names], 3)} FROM (SELECT DISTINCT formation_date FROM panel) d
        LEFT JOIN (SELECT last_day(date) AS month_end, {last} FROM (SELECT date, {values} FROM md) GROUP BY 1) m
        ON last_day(d.formation_date) = m.month_end"""


_ORDER_HASH = "substr(sha256(o_orderkey || ':' || {}), 1, 16)"
_ORDER_MONTHS = """SELECT o_orderstatus AS state, strftime(o_orderdate, '%Y-%m') AS month, min(CAST(o_orderdate AS DATE)) AS opened,
    max(CAST(o_orderdate AS DATE)) + 45 AS closed FROM orders GROUP BY 1, 2"""


def _hash_leaves(depth: int) -> str:
    return f"""SELECT {depth} AS level, node, CAST(sum(copies) AS BIGINT) AS rows, sha256(string_agg('v' || h || ':' || copies, '|'
        ORDER BY 'v' || h || ':' || copies)) AS hash FROM (SELECT *, substr(sha256('v' || h), 1, {depth}) AS node FROM (
        SELECT {_ORDER_HASH.format('o_orderstatus')} AS h, count(*) AS copies FROM orders GROUP BY 1)) GROUP BY 2"""


def _hash_parents(children: str, level: int) -> str:
    return f"""SELECT {level} AS level, substr(node, 1, {level}) AS node, CAST(sum(rows) AS BIGINT) AS rows,
        sha256(string_agg(node || ':' || hash, '|' ORDER BY node || ':' || hash)) AS hash FROM {children} GROUP BY 2"""


def _rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns)


def _table_summary() -> str:
    parts = []
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"):
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing_values, count(*) AS row_count, "
            "6 AS column_count, count(*) FILTER (WHERE o_orderdate IS NULL) AS invalid_dates, "
            "CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date FROM orders"
        )
    return " UNION ALL ".join(parts)


def _profile(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS date_column, min({name}) AS min_date, max({name}) AS max_date, count({name}) AS non_null_count, "
        f"CAST(0 AS BIGINT) AS parse_failures, TRUE AS ok FROM {source}"
    )


def _overlaps(source: str, key: str, start: str, end: str) -> str:
    return f"""SELECT count(*) AS overlap_count FROM (SELECT {start} AS s, max(coalesce({end}, {OPEN})) OVER (
        PARTITION BY {key} ORDER BY {start}, coalesce({end}, {OPEN}) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e
        FROM {source} WHERE {start} IS NOT NULL) WHERE s <= e"""


_CUT = f"least(coalesce(l.linkenddt, {OPEN}), coalesce(n.nameenddt, {OPEN}))"
_LINKED = f"""cl l JOIN listed n ON l.lpermno = n.permno AND l.linkdt <= coalesce(n.nameenddt, {OPEN})
    AND n.namedt <= coalesce(l.linkenddt, {OPEN})"""
_FULL_DATES = "(SELECT permno, date FROM sm)"


def _findings(patterns, source: str, id_column: str, text_column: str, skip_comments: bool) -> str:
    strip = r"regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '')"
    guard = f" WHERE {strip} <> '' AND {strip} NOT LIKE '#%'" if skip_comments else ""
    lines = (
        f"(SELECT {id_column}, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT {id_column}, "
        f"regexp_split_to_array({text_column}, '\\r\\n|\\n|\\r') AS parts FROM {source}))"
    )
    hits = []
    for name, pattern in patterns:
        escaped = pattern.replace("'", "''")
        hits.append(
            f"SELECT {id_column}, n AS line, '{name}' AS pattern, {strip} AS text FROM lines WHERE regexp_matches(line, '{escaped}')"
        )
    return f"WITH lines AS (SELECT * FROM {lines}{guard}) " + " UNION ALL ".join(hits)


_MARKUP = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"
_HREF = Z._ANCHOR.replace("'", "''")


def _filled() -> str:
    """Number of values that are not missing, by feature column of the panel."""
    names = (COMP_COLUMNS + IBES_COLUMNS + ["crsp__mom_12_2", "crsp__mom_6_2", "crsp__reversal_1m", "crsp__log_size"]
             + [f"macro__{c}" for c in _MACRO])
    return ("SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS feature, unnest(["
            + ", ".join(f"count({n})" for n in names) + "]) AS filled FROM fp")


def statements() -> dict[str, str]:
    out = {
        "table_summary": _table_summary(),
        "contract_dates": " UNION ALL ".join(
            [_profile("namedt", "nh"), _profile("nameenddt", "nh")]
        ),
        "contract_table_dates": " UNION ALL ".join(
            f"SELECT '{table}' AS table_name, count(*) AS row_count, '{name}' AS date_column, min({name}) AS min_date, max({name}) AS max_date, "
            f"count({name}) AS non_null_count, CAST(0 AS BIGINT) AS parse_failures FROM {source}"
            for table, source, names in (("crsp_monthly", "sm", ("date",)), ("crsp_names", "nh", ("namedt", "nameenddt")),
                                         ("ccm_link", "cl", ("linkdt", "linkenddt")), ("ibes_link", "tl", ("sdate",)))
            for name in names
        ) + " UNION ALL SELECT 'ibes_link', count(*), 'edate', CAST(NULL AS DATE), CAST(NULL AS DATE), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM tl",
        "contract_duplicates": """SELECT CAST(sum(c) AS BIGINT) AS rows_checked, CAST(sum(c - 1) AS BIGINT) AS duplicate_count,
            CASE WHEN sum(c - 1) > 0 THEN 'warning' ELSE 'ok' END AS severity
            FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
        "prepared_feature_merge": f"""SELECT p.permno, p.formation_date, {_rounded(['crsp__mom_12_2', 'crsp__reversal_1m', 'compustat__pb', 'ibes__surprise'])}
            FROM crsp p LEFT JOIN (SELECT permno, formation_date, compustat__pb, ibes__surprise FROM fp) f USING (permno, formation_date)""",
        "universe_point_in_interval": f"SELECT permno, permco, formation_date, {_rounded(['price', 'adjusted_price', 'ret_1m'])}, "
            f"{r('market_cap', 1)} AS market_cap, shrout, vol, shrcd, exchcd FROM panel",
        "link_overlap_intervals": f"""SELECT l.gvkey, l.lpermno AS permno, l.linkprim, l.linktype, l.linkdt, l.linkenddt,
            greatest(l.linkdt, n.namedt) AS valid_start, CASE WHEN l.linkenddt IS NOT NULL OR n.nameenddt IS NOT NULL
            THEN {_CUT} END AS valid_end, n.shrcd, n.exchcd, n.namedt, n.nameenddt FROM {_LINKED}""",
        "estimate_link_intervals": f"""SELECT t.permno, t.score, t.sdate, greatest(t.sdate, n.namedt) AS valid_start,
            n.nameenddt AS valid_end, n.shrcd, n.exchcd, n.namedt, n.nameenddt FROM tl t JOIN listed n ON t.permno = n.permno
            AND t.sdate <= coalesce(n.nameenddt, {OPEN}) WHERE t.score <= 1""",
        "interval_overlap_count": "SELECT 'company_link' AS source, * FROM (" + _overlaps("cl", "gvkey", "linkdt", "linkenddt")
            + ") UNION ALL SELECT 'listing', * FROM (" + _overlaps("nh", "exchcd", "namedt", "nameenddt") + ")",
        "link_diagnostics": f"""SELECT t.total AS total_count, m.matched AS matched_count, t.total - m.matched AS unmatched_count,
            {r('(t.total - m.matched) / t.total')} AS unmatched_rate, o.overlap_count, o.overlap_count AS duplicate_active_link_count,
            m.rows AS resolved_row_count FROM (SELECT count(*) AS total FROM cl) t,
            (SELECT count(DISTINCT (l.gvkey, l.linkdt)) AS matched, count(*) AS rows FROM {_LINKED}) m,
            ({_overlaps("cl", "gvkey", "linkdt", "linkenddt")}) o""",
        "unmatched_security_months": f"""SELECT permno, date FROM sm s WHERE NOT EXISTS (SELECT 1 FROM listed n WHERE n.permno = s.permno
            AND s.date BETWEEN n.namedt AND coalesce(n.nameenddt, {OPEN}))""",
        "resolve_permno": f"""SELECT s.permno, s.date, n.shrcd, n.exchcd, n.namedt FROM {_FULL_DATES} s JOIN listed n ON n.permno = s.permno
            AND s.date BETWEEN n.namedt AND coalesce(n.nameenddt, {OPEN})
            QUALIFY row_number() OVER (PARTITION BY s.permno, s.date ORDER BY n.namedt) = 1""",
        "resolve_gvkey": f"""SELECT lpad(CAST(s.permno AS VARCHAR), 6, '0') AS gvkey, s.date, l.lpermno AS permno FROM {_FULL_DATES} s
            JOIN cl l ON l.lpermno = s.permno AND s.date BETWEEN l.linkdt AND coalesce(l.linkenddt, {OPEN})
            QUALIFY row_number() OVER (PARTITION BY s.permno, s.date ORDER BY l.linkdt) = 1""",
        "resolve_ticker": f"""SELECT 'T' || s.permno AS ticker, s.date, t.permno FROM {_FULL_DATES} s JOIN tl t ON t.permno = s.permno
            AND t.sdate <= s.date WHERE t.score <= 1""",
        "resolve_identifiers": f"""SELECT q.kind, q.identifier, q.date, CASE WHEN EXISTS (SELECT 1 FROM listed n WHERE n.permno = q.permno
            AND q.date BETWEEN n.namedt AND coalesce(n.nameenddt, {OPEN})) AND (q.kind <> 'ibes_ticker' OR q.permno % 3 <= 1)
            THEN q.permno END AS permno
            FROM (SELECT 'permno' AS kind, CAST(permno AS VARCHAR) AS identifier, date, permno FROM sm
                  UNION ALL SELECT 'gvkey', lpad(CAST(permno AS VARCHAR), 6, '0'), date, permno FROM sm
                  UNION ALL SELECT 'ibes_ticker', ' t' || permno, date, permno FROM sm) q""",
        "forward_returns": "SELECT permno, date AS formation_date, forward_return_start, forward_return_end, "
            f"{_rounded(['ret_1m_fwd', 'ret_3m_fwd', 'ret_6m_fwd'])}, forward_return_end_3m, forward_return_end_6m FROM lab",
        "monthly_panel": f"SELECT permno, formation_date, {_rounded(['price', 'ret_1m', 'ret_1m_fwd', 'ret_3m_fwd', 'ret_6m_fwd'])}, exchcd, "
            "forward_return_start, forward_return_end_6m, 'monthly_active_names' AS universe_source, 'monthly_returns' AS label_source FROM panel",
        "label_window_check": """SELECT count(*) AS rows, count(ret_1m_fwd) AS labelled_rows,
            count(*) FILTER (WHERE ret_1m_fwd IS NOT NULL AND (forward_return_start IS NULL OR forward_return_start <= formation_date)) AS early_windows,
            min(formation_date) AS start_date, max(formation_date) AS end_date FROM panel""",
        "cap_chronological": """SELECT permno, formation_date FROM panel
            QUALIFY row_number() OVER (ORDER BY formation_date, permno) <= (SELECT count(*) // 3 FROM panel)""",
        "cap_date_balanced": """SELECT permno, formation_date FROM (SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY permno) AS k FROM panel)
            QUALIFY row_number() OVER (ORDER BY k, formation_date) <= (SELECT count(*) // 3 FROM panel)""",
        "cap_whole_periods": """SELECT permno, formation_date FROM panel JOIN (SELECT formation_date,
              row_number() OVER (ORDER BY formation_date) AS i, sum(count(*)) OVER (ORDER BY formation_date) AS c FROM panel GROUP BY 1)
              USING (formation_date) WHERE i <= 6 OR c <= (SELECT count(*) // 3 FROM panel)""",
        "momentum_reversal_size": "SELECT permno, formation_date, "
            f"{_rounded(['crsp__mom_12_2', 'crsp__mom_6_2', 'crsp__reversal_1m', 'crsp__log_size'])} FROM crsp",
        "fundamental_ratios": f"SELECT gvkey, datadate, available_date, {_rounded(COMP_COLUMNS)} FROM ratios",
        "fundamentals_asof": f"SELECT permno, formation_date, {_rounded(COMP_COLUMNS)} FROM with_comp",
        "estimate_features_asof": f"SELECT permno, formation_date, {_rounded([c for c in IBES_COLUMNS if c != 'ibes__target_price_mean'])}, "
            f"{r('ibes__target_price_mean', 3)} AS ibes__target_price_mean FROM with_est",
        "macro_month_end": f"SELECT formation_date, {_rounded([f'macro__{c}' for c in _MACRO], 3)} FROM mm",
        "macro_on_trading_days": f"""SELECT permno, formation_date, {_rounded([f'macro__{c}' for c in _MACRO], 3)},
            {', '.join(f'CAST(NULL AS DOUBLE) AS end_macro__{c}' for c in _MACRO)}
            FROM (SELECT permno, formation_date - 2 AS formation_date FROM panel) p LEFT JOIN (SELECT day, {', '.join(
                f'arg_max({c}, date) FILTER (WHERE {c} IS NOT NULL) AS macro__{c}' for c in _MACRO)}
              FROM md JOIN (SELECT DISTINCT formation_date - 2 AS day FROM panel) d ON date <= day AND last_day(date) = last_day(day) GROUP BY 1
            ) m ON m.day = p.formation_date""",
        "narrowed_inputs": """SELECT 'comp_fundq' AS source, count(*) AS rows FROM fq WHERE datadate BETWEEN (SELECT min(formation_date) - 730 FROM panel)
              AND (SELECT max(formation_date) FROM panel) AND CAST(gvkey AS BIGINT) IN (SELECT permno FROM panel)
            UNION ALL SELECT 'ccm_link', count(*) FROM cl WHERE CAST(gvkey AS BIGINT) IN (SELECT permno FROM panel)
            UNION ALL SELECT 'ibes_link', count(*) FROM tl WHERE permno IN (SELECT permno FROM panel)
            UNION ALL SELECT 'ibes_summary', count(*) FROM em WHERE statpers BETWEEN (SELECT min(formation_date) - 730 FROM panel)
              AND (SELECT max(formation_date) FROM panel) AND ticker IN (SELECT 'T' || permno FROM panel)
            UNION ALL SELECT 'ibes_target', count(*) FROM tm WHERE statpers BETWEEN (SELECT min(formation_date) - 730 FROM panel)
              AND (SELECT max(formation_date) FROM panel) AND ticker IN (SELECT 'T' || permno FROM panel)""",
        "factor_registry": "SELECT t.*, coalesce(filled, 0) AS filled FROM (VALUES " + _values(
            (f.factor_id, f.family, f.scope, f.source_column, f.status) for f in FACTORS
            ) + ") t(factor_id, factor_family, scope, source_column, status) LEFT JOIN (" + _filled() + ") f ON f.feature = t.source_column",
        "factor_scores_global": f"""SELECT formation_date, permno, factor_id, factor_family, {r('raw', 4)} AS raw_value, {r('score')} AS factor_score
            FROM scored JOIN reg USING (signal) WHERE scope = 'global'""",
        "factor_scores_local": f"""SELECT formation_date, permno, factor_id, factor_family, {r('raw', 4)} AS raw_value, {r('score')} AS factor_score
            FROM scored JOIN reg USING (signal) WHERE scope = 'local'""",
        "factor_long_short_returns": f"""SELECT formation_date, factor_id, {_rounded(['long_return', 'short_return'])},
            {r('ls')} AS factor_long_short_ret_1m, long_count, short_count FROM fr""",
        "quantile_sweep": f"""SELECT formation_date, factor_id, q AS quantile, {r('ls')} AS factor_long_short_ret_1m, long_count, short_count FROM all_fr""",
        "alpha_global": f"SELECT factor_id, observations, {_rounded(['mean_return', 'volatility', 'global_score'])} FROM galpha",
        "alpha_local": f"SELECT factor_id, {r('local_score')} AS local_score FROM lalpha",
        "factor_universe_topk": f"""SELECT factor_id, {_rounded(['combined_score', 'global_score', 'local_score'])},
            row_number() OVER (ORDER BY combined_score DESC, global_score DESC, local_score DESC, factor_id) AS selection_rank
            FROM alpha QUALIFY selection_rank <= 13""",
        "score_row_estimate": f"SELECT count(*) AS panel_rows, count(*) * {len(COMPUTABLE)} AS score_rows FROM fp",
        "parameter_grid_returns": f"""SELECT q AS quantile, universe, count(*) AS factor_months, {r('avg(ls)')} AS mean_return,
            {r('stddev_pop(ls)')} AS volatility FROM all_fr JOIN (SELECT factor_id, 'all_implemented_current' AS universe FROM reg
            UNION ALL SELECT factor_id, 'selected_13_global_local' FROM alpha QUALIFY row_number() OVER (
              ORDER BY combined_score DESC, global_score DESC, local_score DESC, factor_id) <= 13) u USING (factor_id)
            WHERE ls IS NOT NULL GROUP BY 1, 2""",
        "label_stage_chunks": """SELECT CAST((place - 1) // 12 AS INTEGER) AS chunk, min(formation_date) AS first_date, max(formation_date) AS last_date,
              CAST(count(DISTINCT formation_date) AS INTEGER) AS dates, count(*) AS n_rows
            FROM (SELECT formation_date, dense_rank() OVER (ORDER BY formation_date) AS place FROM panel) GROUP BY 1""",
        "split_chronological": "SELECT date AS formation_date, split FROM splits",
        "walk_forward_folds": "SELECT factor_id, formation_date, fold, role FROM folds",
        "holdout_split": """SELECT factor_id, formation_date, CASE WHEN i < n - v - h THEN 'train' WHEN i < n - h THEN 'validation' ELSE 'holdout' END AS role
            FROM (SELECT *, greatest(1, CAST(round_even(n * 0.15e0, 0) AS INTEGER)) AS h, greatest(1, CAST(round_even(n * 0.15e0, 0) AS INTEGER)) AS v
                  FROM dated WHERE n >= 24)""",
        "ridge_normal_equations": f"""SELECT * FROM (WITH long AS (
              SELECT factor_id, fold, f.formation_date, ls, unnest([{", ".join(f"{{'name': 'macro__{c}', 'v': macro__{c}}}" for c in _MACRO)}], recursive := true)
              FROM folds f JOIN pm USING (formation_date) WHERE role = 'train'),
            filled AS (SELECT *, coalesce(v, median(v) OVER (PARTITION BY factor_id, fold, name)) AS x FROM long),
            z AS (SELECT *, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS z, ls - avg(ls) OVER w AS y
                  FROM filled WHERE x IS NOT NULL WINDOW w AS (PARTITION BY factor_id, fold, name))
            SELECT a.factor_id, a.fold, a.name AS feature_a, b.name AS feature_b,
              {r('sum(a.z * b.z) + CASE WHEN a.name = b.name THEN 1 ELSE 0 END')} AS gram, {r('sum(a.z * a.y)')} AS target_product
            FROM z a JOIN z b ON a.factor_id = b.factor_id AND a.fold = b.fold AND a.formation_date = b.formation_date GROUP BY 1, 2, 3, 4)""",
        "baseline_mean_forecast": f"""SELECT factor_id, formation_date, fold, {r('prediction')} AS prediction, {r('ls')} AS factor_long_short_ret_1m
            FROM fitted WHERE role = 'holdout'""",
        "factor_model_metrics": f"""SELECT factor_id, fold_count, train_rows, validation_rows, holdout_rows,
            {_rounded(['validation_mae', 'holdout_mae', 'validation_correlation', 'holdout_correlation'])} FROM fitmetrics""",
        "top_factor_models": f"""SELECT factor_id, {r('holdout_correlation')} AS holdout_correlation FROM (SELECT *, {r('holdout_correlation', 12)} AS c
            FROM fitmetrics) ORDER BY c DESC NULLS LAST, factor_id LIMIT 10""",
        "baseline_median_forecast": f"""SELECT f.factor_id, f.formation_date, min(f.formation_date) OVER (PARTITION BY f.factor_id, f.fold) AS fold_start,
            {r('m')} AS prediction, {r('ls')} AS factor_long_short_ret_1m FROM folds f JOIN (SELECT factor_id, fold, median(ls) AS m
              FROM folds WHERE role = 'train' GROUP BY 1, 2) t USING (factor_id, fold) WHERE role = 'holdout'""",
        "headline_summary": f"""SELECT 'holdout' AS surface, count(*) AS periods, {r('avg(portfolio_return)')} AS mean_monthly_return,
            {r('stddev_pop(portfolio_return)')} AS volatility_monthly, {r('min((1 + cumulative_return) / peak - 1)')} AS max_drawdown
            FROM (SELECT *, max(1 + cumulative_return) OVER (ORDER BY formation_date) AS peak FROM port WHERE split = 'holdout')
            HAVING count(*) > 0""",
        "weight_skill_correlation": f"""SELECT split, {r(correlation('w', 'holdout_correlation'))} AS weight_skill_correlation FROM (
            SELECT split, factor_id, avg(weight) AS w, any_value(holdout_correlation) AS holdout_correlation FROM alloc
            JOIN fitmetrics USING (factor_id) GROUP BY 1, 2) WHERE holdout_correlation IS NOT NULL GROUP BY 1""",
        "promotion_by_state": """SELECT status, CASE WHEN status IN ('FAILED', 'DEAD_LETTER', 'REJECTED') THEN 'not promoted'
              WHEN status = 'SUCCEEDED' AND total > 100000 THEN 'promoted' ELSE 'pending' END AS promotion_status, count(*) AS runs
            FROM merged GROUP BY 1, 2""",
        "contract_report": """SELECT t.name AS table_name, t.found, t.missing, CAST(0 AS BIGINT) AS parse_failures, d.duplicate_count,
            t.found AND t.missing = 0 AS ok
            FROM (VALUES ('crsp_monthly', TRUE, 0), ('crsp_names', TRUE, 0), ('ccm_link', TRUE, 0), ('comp_company', FALSE, 0),
              ('comp_fundq', TRUE, 15), ('ibes_link', TRUE, 0), ('ibes_summary', TRUE, 10), ('ibes_detail', FALSE, 0),
              ('ibes_actual', FALSE, 0), ('ibes_target', TRUE, 12), ('macro_features', TRUE, 4)) t(name, found, missing)
            LEFT JOIN (SELECT 'crsp_monthly' AS name, count(*) - count(DISTINCT (permno, date)) AS duplicate_count FROM sm
              UNION ALL SELECT 'crsp_names', count(*) - count(DISTINCT (permno, namedt)) FROM nh
              UNION ALL SELECT 'ccm_link', count(*) - count(DISTINCT (gvkey, linkdt)) FROM cl
              UNION ALL SELECT 'ibes_link', count(*) - count(DISTINCT permno) FROM tl) d ON t.name = d.name""",
        "macro_design_matrix": f"SELECT formation_date, {_rounded([f'macro__{c}' for c in _MACRO], 3)} FROM pm",
        "macro_design_25x3": _wide_design([n for n in WIDE_SERIES if n != "consumer_sentiment"], ["", "_c20", "_c60"]),
        "macro_design_expanded": _wide_design(WIDE_SERIES, ["", *CHANGES]),
        "estimate_link_diagnostics": f"""SELECT t.total AS total_count, m.matched AS matched_count, t.total - m.matched AS unmatched_count,
            {r('(t.total - m.matched) / t.total')} AS unmatched_rate, CAST(0 AS BIGINT) AS overlap_count, CAST(0 AS BIGINT) AS duplicate_active_link_count,
            m.rows AS resolved_row_count, t.dropped AS score_filtered_out_count
            FROM (SELECT count(*) FILTER (WHERE score <= 1) AS total, count(*) FILTER (WHERE score > 1) AS dropped FROM tl) t,
            (SELECT count(DISTINCT l.permno) AS matched, count(*) AS rows FROM tl l JOIN listed n ON l.permno = n.permno
             AND l.sdate <= coalesce(n.nameenddt, {OPEN}) WHERE l.score <= 1) m""",
        "period_runs": "SELECT formation_date, count(*) AS size, row_number() OVER (ORDER BY formation_date) AS run FROM panel GROUP BY 1",
        "ordinal_target_ranks": """SELECT permno, formation_date, row_number() OVER (PARTITION BY formation_date ORDER BY vol, permno) AS target_rank FROM panel""",
        "factor_allocations": f"SELECT formation_date, factor_id, split, {r('prediction')} AS prediction, {r('weight')} AS weight FROM alloc",
        "factor_portfolio": f"SELECT formation_date, split, {r('portfolio_return')} AS portfolio_return, {growth('cumulative_return')} AS cumulative_return FROM port",
        "portfolio_summary": f"""SELECT split, count(*) AS periods, {r('avg(portfolio_return)')} AS mean_monthly_return,
            {r('stddev_pop(portfolio_return)')} AS volatility_monthly, {growth('arg_max(cumulative_return, formation_date)')} AS cumulative_return,
            {r('min((1 + cumulative_return) / peak - 1)')} AS max_drawdown FROM (SELECT *, max(1 + cumulative_return) OVER (
              PARTITION BY split ORDER BY formation_date) AS peak FROM port) GROUP BY 1""",
        "stock_score": f"""SELECT formation_date, permno, split, factors_used, {_rounded(['stock_score', 'max_factor_weight', 'herfindahl_weight'])} FROM stock""",
        "qspread_portfolio": f"""SELECT formation_date, split, long_count, short_count, {growth('cumulative_return')} AS cumulative_return, {_rounded(['portfolio_return', 'long_turnover',
            'short_turnover', 'turnover', 'max_factor_weight', 'mean_herfindahl_weight'])} FROM qport""",
        "qspread_legs": f"SELECT formation_date, split, leg, permno, {r('stock_score')} AS stock_score, {r('fwd')} AS forward_return FROM qlegs",
        "leg_turnover": f"SELECT formation_date, split, {_rounded(['long_turnover', 'short_turnover'])} FROM turn",
        "ic_by_period": f"SELECT split, period, rows, {_rounded(['rank_ic', 'pearson_ic'])} FROM ic",
        "decile_long_short": f"SELECT split, period, {r('ls')} AS long_short_return FROM spread",
        "top_turnover": f"SELECT split, period, {r('turnover')} AS turnover FROM tturn",
        "drawdown": f"SELECT split, {r('max_drawdown')} AS max_drawdown FROM dd",
        "ic_stability": f"SELECT split, {_rounded(['ic_std', 'positive_ic_share', 'yearly_ic_std'])} FROM stab",
        "prediction_metrics": f"""SELECT split, row_count, period_count, {_rounded(['rank_ic', 'pearson_ic', 'decile_long_short_return', 'hit_rate', 'mse', 'mae',
            'turnover_proxy', 'max_drawdown', 'ic_std', 'positive_ic_share', 'yearly_ic_std'])} FROM err
            JOIN (SELECT split, avg(rank_ic) AS rank_ic, avg(pearson_ic) AS pearson_ic FROM ic GROUP BY 1) USING (split)
            JOIN (SELECT split, avg(ls) AS decile_long_short_return FROM spread GROUP BY 1) USING (split) JOIN dd USING (split)
            JOIN (SELECT split, avg(turnover) AS turnover_proxy FROM tturn GROUP BY 1) USING (split) JOIN stab USING (split)""",
        "feature_coverage": "SELECT exchcd, " + r("(" + " + ".join(f"avg(CASE WHEN {c} IS NOT NULL THEN 1e0 ELSE 0e0 END)"
            for c in COMP_COLUMNS + IBES_COLUMNS) + f") / {len(COMP_COLUMNS + IBES_COLUMNS)}") + " AS feature_coverage FROM fp GROUP BY 1",
        "select_by_validation": f"SELECT run_id AS model, 'rank_ic' AS selection_metric, {r('rank_ic')} AS validation_value FROM runs ORDER BY runs.rank_ic DESC, run_id LIMIT 1",
        "leaderboard": f"SELECT run_id, {_rounded(['rank_ic', 'mae'])}, row_number() OVER (ORDER BY runs.rank_ic DESC NULLS LAST, run_id) AS position FROM runs",
        "promotion_gate": f"""SELECT run_id, {r('rank_ic')} AS rank_ic, CASE WHEN runs.rank_ic IS NULL THEN 'pending' WHEN runs.rank_ic < 0 THEN 'not promoted'
            WHEN runs.hit_rate IS NULL THEN 'pending' WHEN runs.hit_rate < 0.5e0 THEN 'not promoted' ELSE 'promoted' END AS promotion_status FROM runs""",
        "metric_trend": "SELECT run_id, metric, " + r("value") + " AS value FROM (" + " UNION ALL ".join(
            f"SELECT run_id, '{m}' AS metric, {m} AS value FROM runs" for m in ("rank_ic", "pearson_ic", "hit_rate", "mse", "mae")
            ) + ") WHERE value IS NOT NULL",
        "run_metric_pivot": """SELECT user_id % 5 AS run_id, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS rank_ic,
            arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS hit_rate,
            arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS mse, arg_max(value, event_id) FILTER (WHERE event_type = 'signup') AS mae,
            arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS max_drawdown FROM events GROUP BY 1""",
        "merged_runs": "SELECT * FROM merged",
        "prediction_summary": f"""SELECT model AS run_id, count(*) AS rows, count(DISTINCT period) AS periods, min(period) AS first_period, max(period) AS last_period,
            {r('avg(actual)')} AS target_mean, {r('avg(prediction)')} AS prediction_mean FROM models GROUP BY 1""",
        "prediction_series": f"""SELECT model AS run_id, period AS date, {r('avg(prediction)')} AS prediction FROM models GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY model ORDER BY period DESC) <= 24""",
        "coverage_by_month": "SELECT strftime(period, '%Y-%m') AS month, count(DISTINCT (model, period)) AS run_observations FROM models GROUP BY 1",
        "feature_family_uses": "SELECT split_part(feature, '_', 1) AS family, count(*) AS feature_uses, CAST(sum(filled) AS BIGINT) AS filled_values FROM ("
            + _filled() + ") GROUP BY 1",
        "run_set_fingerprint": f"""SELECT substr(sha256(string_agg(h, '|' ORDER BY h)), 1, 16) AS run_set_hash16 FROM (
            SELECT substr(sha256(run_id || ':' || CAST(CAST(floor(rank_ic * 1e6 + 0.5001e0) AS BIGINT) AS VARCHAR)), 1, 16) AS h FROM runs)""",
        "run_set_hash_tree": f"""WITH leaves AS ({_hash_leaves(2)}), middle AS ({_hash_parents("leaves", 1)}), top AS ({_hash_parents("middle", 0)})
            SELECT * FROM leaves UNION ALL SELECT * FROM middle UNION ALL SELECT * FROM top""",
        "run_set_differences": f"""SELECT substr(sha256('v' || repro_hash), 1, 2) AS node, repro_hash, our_copies, their_copies FROM (
            SELECT coalesce(a.h, b.h) AS repro_hash, coalesce(a.n, 0) AS our_copies, coalesce(b.n, 0) AS their_copies
            FROM (SELECT {_ORDER_HASH.format('o_orderstatus')} AS h, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN
            (SELECT {_ORDER_HASH.format("CASE WHEN o_orderpriority = '1-URGENT' THEN 'P' ELSE o_orderstatus END")} AS h, count(*) AS n FROM orders GROUP BY 1) b
            ON a.h = b.h) WHERE our_copies <> their_copies""",
        "running_order_value": f"""SELECT o_orderkey, CAST(sum(cents) OVER w AS BIGINT) AS total_cents, max(cents) OVER w AS most_cents,
            last_value(urgent IGNORE NULLS) OVER w AS latest_urgent FROM (SELECT *, CAST(round({r('o_totalprice', 2)} * 100) AS BIGINT) AS cents,
            CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS urgent FROM orders)
            WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
        "order_value_drawdown": f"""SELECT o_orderstatus, {r('min(d)')} AS max_drawdown FROM (SELECT o_orderstatus,
            e / max(e) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS d FROM (SELECT *,
            product(1 + ((o_orderkey * 7919 + o_custkey * 104729) % 2001 - 1000) / 100000e0) OVER (PARTITION BY o_orderstatus
            ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS e FROM orders)) GROUP BY 1""",
        "shipment_asof_order_day": """SELECT l_orderkey, l_linenumber, l.state, l.day, order_day, orders, last_orderkey FROM (
            SELECT l_orderkey, l_linenumber, l_linestatus AS state, CAST(l_shipdate AS DATE) AS day FROM lineitem) l ASOF LEFT JOIN (
            SELECT o_orderstatus AS state, CAST(o_orderdate AS DATE) AS order_day, count(*) AS orders, max(o_orderkey) AS last_orderkey
            FROM orders GROUP BY 1, 2) o ON l.state = o.state AND l.day >= o.order_day""",
        "shipments_in_order_months": f"""SELECT m.state, month, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
            FROM lineitem JOIN ({_ORDER_MONTHS}) m ON l_linestatus = m.state AND CAST(l_shipdate AS DATE) BETWEEN opened AND closed GROUP BY 1, 2""",
        "shipment_spans_over_order_months": f"""SELECT m.state, month, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
            FROM lineitem JOIN ({_ORDER_MONTHS}) m ON l_linestatus = m.state AND CAST(l_shipdate AS DATE) <= closed
            AND opened <= CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) GROUP BY 1, 2""",
        "yearly_returns": f"SELECT split, year(formation_date) AS year, {growth('product(1 + portfolio_return) - 1')} AS year_return, count(*) AS months FROM qport GROUP BY 1, 2",
        "worst_months": f"""SELECT split, formation_date, {r('portfolio_return')} AS portfolio_return, position FROM (SELECT *, row_number() OVER (
            PARTITION BY split ORDER BY portfolio_return, formation_date) AS position FROM qport) WHERE position <= 4""",
        "cost_break_even": f"""SELECT split, {r('avg(portfolio_return)')} AS mean_return, {r('avg(turnover)')} AS mean_turnover,
            {r('avg(portfolio_return) / avg(turnover)')} AS break_even_cost FROM qport GROUP BY 1""",
        "leg_contribution": f"""SELECT split, leg, {r('avg(fwd)')} AS mean_forward_return, {r('avg(stock_score)')} AS mean_score, count(*) AS members FROM qlegs GROUP BY 1, 2""",
        "score_gap": f"""SELECT split, {r('avg(gap)')} AS mean_score_gap, {r(correlation('gap', 'portfolio_return'))} AS gap_return_correlation FROM (
            SELECT formation_date, split, avg(stock_score) FILTER (WHERE leg = 'long') - avg(stock_score) FILTER (WHERE leg = 'short') AS gap
            FROM qlegs GROUP BY 1, 2) JOIN qport USING (formation_date, split) GROUP BY 1""",
        "concentration_effect": f"""SELECT split, concentration, {r('avg(portfolio_return)')} AS mean_return, count(*) AS months FROM (
            SELECT *, CASE WHEN h >= median(h) OVER (PARTITION BY split) THEN 'high' ELSE 'low' END AS concentration
            FROM (SELECT *, {r('mean_herfindahl_weight', 10)} AS h FROM qport)) GROUP BY 1, 2""",
        "factor_weight_means": f"SELECT split, factor_id, {r('avg(weight)')} AS mean_weight, {r('max(weight)')} AS max_weight FROM alloc GROUP BY 1, 2",
        "job_current_state": "SELECT * FROM jstate",
        "job_transition_audit": """SELECT previous_state, to_state, CASE WHEN previous_state IS NULL THEN 'initial'
            WHEN event_id % 50 = 0 AND previous_state <> 'PROPOSED' THEN 'discontinuous' WHEN EXISTS (
              SELECT 1 FROM legal g WHERE g.from_state = previous_state AND g.to_state = e.to_state) THEN 'legal' ELSE 'illegal' END AS verdict,
            count(*) AS events FROM (SELECT *, lag(to_state) OVER (PARTITION BY job_id ORDER BY event_id) AS previous_state FROM je) e GROUP BY ALL""",
        "job_payloads": """SELECT event_id, CAST(json_object('event_type', event_type, 'job_id', job_id, 'to_state', to_state) AS VARCHAR) AS payload,
            CAST(job_id AS VARCHAR) AS job_field FROM je""",
        "features_on_panel_dates": f"""SELECT permno, formation_date, {_rounded(['crsp__reversal_1m'])} FROM fp
            WHERE formation_date IN (SELECT formation_date FROM panel WHERE month(formation_date) % 2 = 0)""",
        "job_failure_rate": f"""SELECT jobs, queue_factor, failure_rate, {r('0.3e0 * queue_factor + 0.4e0 * (1 - failure_rate) + 0.3e0')} AS adjustment,
            greatest(1, least(20, CAST(round_even(20 * (0.3e0 * queue_factor + 0.4e0 * (1 - failure_rate) + 0.3e0), 0) AS INTEGER))) AS trial_count
            FROM (SELECT count(*) AS jobs, {r("1 - count(*) FILTER (WHERE state = 'QUEUED') / count(*)")} AS queue_factor,
                  {r("count(*) FILTER (WHERE state IN ('FAILED', 'DEAD_LETTER')) / count(*) FILTER (WHERE state IN ('SUCCEEDED', 'FAILED', 'DEAD_LETTER'))")} AS failure_rate
                  FROM jstate)""",
        "expired_leases": """SELECT l.job_id, state, expires_at FROM (SELECT job_id, max(ts) + INTERVAL 60 MINUTE AS expires_at FROM je
            WHERE to_state IN ('CLAIMED', 'RUNNING') GROUP BY 1) l JOIN jstate USING (job_id) WHERE state IN ('CLAIMED', 'RUNNING')
            AND expires_at <= TIMESTAMP '2024-01-30 00:00:00'""",
        "dead_letter_listing": """SELECT f.job_id, f.reason, f.retry_count, f.failed_at, state FROM (SELECT job_id,
            arg_max(event_type, event_id) FILTER (WHERE to_state = 'DEAD_LETTER') AS reason, count(*) FILTER (WHERE to_state = 'FAILED') AS retry_count,
            arg_max(ts, event_id) FILTER (WHERE to_state = 'DEAD_LETTER') AS failed_at FROM je GROUP BY 1) f
            JOIN jstate USING (job_id) WHERE state = 'DEAD_LETTER'""",
        "text_pattern_findings": _findings(Z.SECRET_PATTERNS, "documents", "doc_id", "text", False),
        "network_pattern_findings": _findings(Z.NETWORK_PATTERNS, "documents", "doc_id", "text", True),
        "address_findings": _findings([("ipv4_address", r"\b\d{1,3}(?:\.\d{1,3}){3}\b")], "documents", "doc_id", "text", True),
        "page_structure": "SELECT page_id, has_html, has_title, has_body, has_html AND has_title AND has_body AS ok FROM (SELECT page_id, "
            + ", ".join(f"regexp_matches({_MARKUP}, '(?i)<{t}[\\s/>]') AS has_{t}" for t in ("html", "title", "body")) + " FROM pages)",
        "broken_links": f"""SELECT page_id, href, problem, count(*) AS links FROM (
              SELECT l.*, CASE WHEN p.path IS NULL THEN 'broken link' WHEN fragment <> '' AND NOT regexp_matches(p.html, 'id=["'']' || fragment || '["'']') THEN 'missing fragment' END AS problem
              FROM (SELECT page_id, href, lower(site) AS site, regexp_replace(href, '#.*$', '') AS path, regexp_extract(href, '#(.*)$', 1) AS fragment
                FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site,
                      {_resolved("href")} AS href FROM (SELECT page_id, url,
                        regexp_replace(unnest(regexp_extract_all({_MARKUP}, '{_HREF}', 1)), '^["'']|["'']$', '', 'g') AS href FROM pages))
                WHERE NOT regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') AND regexp_replace(href, '#.*$', '') <> '') l
              LEFT JOIN (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, any_value(html) AS html
                FROM pages GROUP BY 1, 2) p USING (site, path))
            WHERE problem IS NOT NULL GROUP BY 1, 2, 3""",
    }
    return {name: text if text.startswith(("WITH lines", "WITH leaves")) else statement(text) for name, text in out.items()}
