"""Drift and fairness queries (D*) with DuckDB oracles."""

from __future__ import annotations

from tabsmith.operators import monitor as MON
from tabsmith.plans.catalog import register, rnd
from tabsmith.plans.fixtures import (EVENTS_SPLIT, GROUP_ATTR_SQL, ORDERS_SPLIT, baseline_current, group_attr)


def _psi_sql(tbl, tcol, split, cols):
    parts = []
    for x in cols:
        e = [f"e[{i + 1}]" for i in range(11)]
        n_le = " + ".join(f"CASE WHEN v >= {ei} THEN 1 ELSE 0 END" for ei in e)
        parts.append(f"""SELECT '{x}' AS "column", * FROM (
  WITH b AS (SELECT CAST({x} AS DOUBLE) AS v FROM {tbl} WHERE {tcol} < TIMESTAMP '{split}' AND {x} IS NOT NULL
               AND isfinite(CAST({x} AS DOUBLE))),
       c AS (SELECT CAST({x} AS DOUBLE) AS v FROM {tbl} WHERE {tcol} >= TIMESTAMP '{split}' AND {x} IS NOT NULL
               AND isfinite(CAST({x} AS DOUBLE))),
       q AS (SELECT list_concat([qs[1] - 1e-9], qs[2:10], [qs[11] + 1e-9]) AS e
             FROM (SELECT quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qs FROM b)),
       bb AS (SELECT least({n_le} - 1, 9) AS bin, count(*)::DOUBLE AS n FROM b, q WHERE v >= e[1] AND v <= e[11] GROUP BY 1),
       cc AS (SELECT least({n_le} - 1, 9) AS bin, count(*)::DOUBLE AS n FROM c, q WHERE v >= e[1] AND v <= e[11] GROUP BY 1),
       g AS (SELECT unnest(range(10)) AS bin),
       j AS (SELECT g.bin, coalesce(bb.n, 0) AS a, coalesce(cc.n, 0) AS b FROM g LEFT JOIN bb USING (bin) LEFT JOIN cc USING (bin)),
       t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM j),
       p AS (SELECT least(greatest(a / greatest(ta, 1.0), 1e-6), 1.0) AS pa,
                    least(greatest(b / greatest(tb, 1.0), 1e-6), 1.0) AS pb FROM j, t)
  SELECT CASE WHEN (SELECT count(*) FROM b) >= 10 AND (SELECT count(*) FROM c) >= 10
              THEN round(sum((pb - pa) * ln(pb / pa)), 6) END AS psi FROM p)""")
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT "column", psi, CASE WHEN psi >= 0.25 THEN 'ALERT' WHEN psi >= 0.1 THEN 'WARN' ELSE '' END AS flag
FROM ({body})"""


@register("drift_psi_events", _psi_sql("events", "ts", EVENTS_SPLIT, ["user_id", "value", "event_id"]))
def q_psi_events(spark, sf):
    base, cur = baseline_current(spark, sf, "events")
    return rnd(MON.psi(base.select("user_id", "value", "event_id"), cur.select("user_id", "value", "event_id")),
               {"psi": 6})


@register("drift_psi_orders", _psi_sql("orders", "o_orderdate", ORDERS_SPLIT, ["o_totalprice", "o_custkey", "o_orderkey"]))
def q_psi_orders(spark, sf):
    base, cur = baseline_current(spark, sf, "orders")
    return rnd(MON.psi(base, cur), {"psi": 6})


@register("fair_demographic_parity", f"""SELECT grp, round(avg(CAST(prediction = 1 AS DOUBLE)), 6) AS positive_rate,
  count(*) AS n FROM {GROUP_ATTR_SQL} WHERE grp IS NOT NULL GROUP BY grp""")
def q_dp(spark, sf):
    return rnd(MON.demographic_parity(group_attr(spark, sf), "grp"), {"positive_rate": 6})


@register("fair_disparate_impact", f"""WITH d AS (SELECT grp, avg(CAST(prediction = 1 AS DOUBLE)) AS r
    FROM {GROUP_ATTR_SQL} WHERE grp IS NOT NULL GROUP BY grp)
SELECT grp, round(r, 6) AS positive_rate, round(r / greatest((SELECT r FROM d WHERE grp = 'BUILDING'), 1e-6), 6)
  AS disparate_impact, CASE WHEN r / greatest((SELECT r FROM d WHERE grp = 'BUILDING'), 1e-6) < 0.8 THEN 'ALERT'
  ELSE '' END AS flag FROM d""")
def q_di(spark, sf):
    return rnd(MON.disparate_impact(group_attr(spark, sf), "grp", "BUILDING"),
               {"positive_rate": 6, "disparate_impact": 6})


@register("fair_equalized_odds", f"""SELECT grp,
  round(count(*) FILTER (WHERE label = 1 AND prediction = 1) / greatest(1, count(*) FILTER (WHERE label = 1)), 6) AS tpr,
  round(count(*) FILTER (WHERE label <> 1 AND prediction = 1) / greatest(1, count(*) FILTER (WHERE label <> 1)), 6) AS fpr
FROM {GROUP_ATTR_SQL} WHERE grp IS NOT NULL GROUP BY grp""")
def q_eo(spark, sf):
    return rnd(MON.equalized_odds(group_attr(spark, sf), "grp"), {"tpr": 6, "fpr": 6})
