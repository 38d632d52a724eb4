"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string rebuilds the fixture views from the base tables as CTEs and
computes the same result with plain SQL (pair joins for the concordance
indices, window functions for ranks and positions).
"""
from __future__ import annotations

import math

from .context import TAU

FX = """fx_clinical AS (
  SELECT o.o_orderkey AS ID, concat('C', CAST(c.c_nationkey AS VARCHAR)) AS CENTER,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_totalprice / 5000.0 END AS BM_BLAST,
         c.c_acctbal / 1000.0 AS HB,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(o.o_custkey % 400 AS DOUBLE) END AS PLT,
         CASE CAST(o.o_orderkey % 12 AS INTEGER)
              WHEN 0 THEN NULL WHEN 1 THEN '46,XX' WHEN 2 THEN ' 46,XY ' WHEN 3 THEN '46,XX[20]'
              WHEN 4 THEN '45,XY,-7' WHEN 5 THEN '47,XX,+8' WHEN 6 THEN '46,XY,del(5)(q13q33)'
              WHEN 7 THEN '46,XX,t(8;21)(q22;q22)' WHEN 8 THEN 'complex' WHEN 9 THEN '46,XX,inv(16)(p13q22)'
              WHEN 10 THEN '45,XY,-17,+8,del(20q)' ELSE '46,XX,del(13q)' END AS CYTOGENETICS
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
fx_molecular AS (
  SELECT l.l_orderkey AS ID, p.p_brand AS GENE, p.p_type AS EFFECT,
         CASE WHEN (l.l_orderkey + l.l_linenumber) % 13 = 0 THEN NULL ELSE l.l_quantity / 50.0 END AS VAF,
         l.l_extendedprice AS DEPTH
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
fx_target AS (
  SELECT o.o_orderkey AS ID,
         (date_diff('day', CAST(o.o_orderdate AS DATE), DATE '2001-08-01') + 1) / CAST(365.25 AS DOUBLE) AS OS_YEARS,
         CASE WHEN o.o_orderkey % 23 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS OS_STATUS
  FROM orders o WHERE o.o_orderkey % 17 <> 0),
lab AS (SELECT ID, OS_YEARS, CAST(OS_STATUS AS INTEGER) AS OS_STATUS FROM fx_target
        WHERE OS_YEARS IS NOT NULL AND OS_STATUS IS NOT NULL)"""


def H(expr: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}|' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT)"


def TEST(col="ID") -> str:
    return f"({H(col)} % 10 >= 8)"


def R(x: str, alias: str) -> str:
    return f"round({x}, 6) AS {alias}"


CYTO_SQL = """
  regexp_matches(s, '^46,(xx|xy)$')::INTEGER AS cyto_is_normal_karyotype,
  contains(s, 'del(')::INTEGER AS cyto_has_deletion,
  (contains(s, '-7') OR contains(s, 'monosomy 7'))::INTEGER AS cyto_has_monosomy_7,
  (contains(s, '+8') OR contains(s, 'trisomy 8'))::INTEGER AS cyto_has_trisomy_8,
  contains(s, 't(')::INTEGER AS cyto_has_translocation,
  len(regexp_extract_all(s, 'del\\(|inv\\(|dup\\(|t\\(|\\+\\d+|-\\d+'))::INTEGER AS cyto_n_abnormalities"""

RULE_SQL = """
  (contains(t, 'complex') OR contains(t, 'cx') OR contains(t, '≥3') OR contains(t, '>=3'))::INTEGER AS cyto_has_complex,
  (contains(t, 'monosomal') OR contains(t, 'mk'))::INTEGER AS cyto_has_monosomal_karyotype,
  (contains(t, 'del(5q') OR contains(t, '-5') OR contains(t, '5q-'))::INTEGER AS cyto_has_del5q,
  (contains(t, '-7') OR contains(t, 'del(7q') OR contains(t, '7q-'))::INTEGER AS cyto_has_mono7_or_del7q,
  (contains(t, '+8') OR contains(t, 'trisomy8'))::INTEGER AS cyto_has_trisomy8,
  (contains(t, 'inv(16') OR contains(t, 't(16;16'))::INTEGER AS cyto_has_inv16,
  contains(t, 't(8;21')::INTEGER AS cyto_has_t8_21,
  contains(t, 't(15;17')::INTEGER AS cyto_has_t15_17,
  (contains(t, '11q23') OR contains(t, 'kmt2a') OR contains(t, 'mll'))::INTEGER AS cyto_has_11q23_kmt2a,
  (contains(t, '3q') OR contains(t, 'inv(3') OR contains(t, 't(3;3'))::INTEGER AS cyto_has_3q_abn,
  (contains(t, '17p') OR contains(t, 'del(17p'))::INTEGER AS cyto_has_17p,
  (contains(t, 'del(20q') OR contains(t, '20q-'))::INTEGER AS cyto_has_20q_del,
  (contains(t, '12p') OR contains(t, 'del(12p'))::INTEGER AS cyto_has_12p_abn,
  len(regexp_extract_all(t, '(del\\(|inv\\(|t\\(|dup\\(|\\+\\d+|-\\d+)'))::INTEGER AS cyto_abn_count_proxy"""

S_EXPR = "lower(regexp_replace(coalesce(CYTOGENETICS, ''), '^\\s+|\\s+$', '', 'g'))"
T_EXPR = "replace(lower(coalesce(CYTOGENETICS, '')), ' ', '')"


def AGG_SQL(rel: str, rounded: bool) -> str:
    r = (lambda x, a: R(x, a)) if rounded else (lambda x, a: f"{x} AS {a}")
    return f"""SELECT ID, count(*) AS n_mut, count(DISTINCT GENE) AS n_unique_genes,
  count(DISTINCT EFFECT) AS n_unique_effects, {r('coalesce(avg(VAF), 0)', 'vaf_mean')},
  {r('coalesce(stddev_samp(VAF), 0)', 'vaf_std')}, {r('coalesce(max(VAF), 0)', 'vaf_max')},
  {r('coalesce(quantile_cont(VAF, 0.9), 0)', 'vaf_p90')}, {r('coalesce(sum(VAF), 0)', 'vaf_sum')},
  count(*) FILTER (WHERE VAF > 0.30) AS n_vaf_gt_30, count(*) FILTER (WHERE VAF < 0.10) AS n_vaf_lt_10,
  {r('coalesce(avg(DEPTH), 0)', 'depth_mean')}, {r('coalesce(max(DEPTH), 0)', 'depth_max')}
FROM {rel} GROUP BY ID"""


def FEATS_SQL(rel: str, ents: str, binary: bool, value_type: str, genes_only: bool = False) -> str:
    """CTEs feats / cnt / ind: (ID, feature, value) for every entity of ``ents`` and every listed gene and effect."""
    value = "CASE WHEN x.n > 0 THEN 1 ELSE 0 END" if binary else "coalesce(x.n, 0)"
    effects = "" if genes_only else " UNION ALL SELECT 'EFFECT__' || EFFECT FROM te"
    return f"""feats AS (SELECT 'GENE__' || GENE AS feature FROM tg{effects}),
cnt AS (SELECT ID, 'GENE__' || GENE AS feature, count(*) AS n FROM {rel} GROUP BY 1, 2
        UNION ALL SELECT ID, 'EFFECT__' || EFFECT AS feature, count(*) AS n FROM {rel} GROUP BY 1, 2),
ind AS (SELECT e.ID, f.feature, CAST({value} AS {value_type}) AS value FROM (SELECT DISTINCT ID FROM {ents}) e CROSS JOIN feats f
        LEFT JOIN cnt x ON x.ID = e.ID AND x.feature = f.feature)"""


TOPLISTS = """mt AS (SELECT * FROM fx_molecular WHERE ID IN (SELECT ID FROM fx_target)),
tg AS (SELECT GENE FROM mt WHERE GENE IS NOT NULL GROUP BY GENE ORDER BY count(*) DESC, GENE ASC LIMIT 10),
te AS (SELECT EFFECT FROM mt WHERE EFFECT IS NOT NULL GROUP BY EFFECT ORDER BY count(*) DESC, EFFECT ASC LIMIT 25)"""

def WIDE_SQL(clin: str, mol: str, with_target: bool) -> str:
    """The numeric columns of the train / scoring table as (ID, feature, value)."""
    tgt = "JOIN fx_target t USING (ID)" if with_target else ""
    where = "WHERE t.OS_YEARS IS NOT NULL AND t.OS_STATUS IS NOT NULL" if with_target else ""
    tcols = ", t.OS_YEARS, t.OS_STATUS" if with_target else ""
    return f"""
agg AS ({AGG_SQL(mol, False)}),
fl AS (SELECT ID, {CYTO_SQL.strip()}, {RULE_SQL.strip()}
       FROM (SELECT ID, CYTOGENETICS, {S_EXPR} AS s, {T_EXPR} AS t FROM {clin})),
base AS (SELECT c.ID, coalesce(c.BM_BLAST, 0) AS BM_BLAST, coalesce(c.HB, 0) AS HB, coalesce(c.PLT, 0) AS PLT, fl.* EXCLUDE (ID),
  coalesce(a.n_mut, 0) AS n_mut, coalesce(a.n_unique_genes, 0) AS n_unique_genes,
  coalesce(a.n_unique_effects, 0) AS n_unique_effects, coalesce(a.vaf_mean, 0) AS vaf_mean, coalesce(a.vaf_std, 0) AS vaf_std,
  coalesce(a.vaf_max, 0) AS vaf_max, coalesce(a.vaf_p90, 0) AS vaf_p90, coalesce(a.vaf_sum, 0) AS vaf_sum,
  coalesce(a.n_vaf_gt_30, 0) AS n_vaf_gt_30, coalesce(a.n_vaf_lt_10, 0) AS n_vaf_lt_10,
  coalesce(a.depth_mean, 0) AS depth_mean, coalesce(a.depth_max, 0) AS depth_max {tcols}
  FROM {clin} c JOIN fl USING (ID) LEFT JOIN agg a USING (ID) {tgt} {where}),
{FEATS_SQL(mol, 'base', True, 'DOUBLE')},
stat AS (SELECT ID, feature, value FROM (SELECT ID, CAST(COLUMNS(* EXCLUDE (ID)) AS DOUBLE) FROM base)
         UNPIVOT (value FOR feature IN (COLUMNS(* EXCLUDE (ID)))))
SELECT ID, feature, round(value, 6) AS value FROM stat UNION ALL SELECT ID, feature, value FROM ind"""


def CINDEX_SQL(test_rel: str, risk: str, train_groups=(), test_groups=(), tau=TAU) -> str:
    """CTEs km / curve / tw and a final SELECT of (groups..., cindex) by an explicit pair join.

    ``train_rel`` must be a CTE named ``tr`` (time, event[, groups]); ``test_rel``
    has (time, event, <risk expr cols>, groups).
    """
    tg = list(train_groups)
    g = list(test_groups)
    gsel = "".join(f"{c}, " for c in tg)
    part = f"PARTITION BY {', '.join(tg)}" if tg else ""
    on = " AND ".join([f"te.{c} = cv.{c}" for c in tg] + ["te.time >= cv.time"])
    jg = " AND ".join([f"i.{c} = j.{c}" for c in g] + ["(j.time > i.time OR (j.time = i.time AND NOT j.event))"])
    gout = ", ".join(f"i.{c} AS {c}" for c in g)
    gby = f"GROUP BY {', '.join('i.' + c for c in g)}" if g else ""
    return f"""
km0 AS (SELECT {gsel}time, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN event THEN 1 ELSE 0 END) AS DOUBLE) AS d
        FROM tr GROUP BY {gsel}time),
km AS (SELECT {gsel}time, n, d, n - d AS c, sum(n) OVER ({part} ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS r FROM km0),
km2 AS (SELECT {gsel}time, CASE WHEN c = 0 THEN 0.0 ELSE c / (r - d) END AS ratio FROM km),
curve AS (SELECT {gsel}time,
  CASE WHEN sum(CASE WHEN ratio >= 1 THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
       ELSE exp(sum(CASE WHEN ratio < 1 THEN ln(1 - ratio) ELSE 0 END) OVER w) END AS G
  FROM km2 WINDOW w AS ({part} ORDER BY time ROWS UNBOUNDED PRECEDING)),
tw AS (SELECT te.*, {risk} AS risk,
  CASE WHEN te.event AND te.time < {float(tau)} THEN 1.0 / coalesce(cv.G, 1.0) ELSE 0.0 END AS ipcw
  FROM {test_rel} te ASOF LEFT JOIN curve cv ON {on}),
cidx AS (SELECT {gout + ', ' if g else ''}
  0.5 * sum(i.ipcw * i.ipcw * ((j.risk < i.risk - 1e-8)::INTEGER + (j.risk <= i.risk + 1e-8)::INTEGER))
      / sum(i.ipcw * i.ipcw) AS cindex
  FROM tw i JOIN tw j ON {jg} WHERE i.event AND i.ipcw > 0 {gby})"""


HOLDOUT = f"""lc AS (SELECT l.ID, l.OS_YEARS, l.OS_STATUS, c.CENTER, c.BM_BLAST, c.HB, c.PLT, {TEST('l.ID')} AS is_test
       FROM lab l JOIN fx_clinical c USING (ID)),
sv AS (SELECT *, OS_STATUS = 1 AS event, OS_YEARS AS time FROM lc),
tr AS (SELECT * FROM sv WHERE NOT is_test),
ts AS (SELECT * FROM sv WHERE is_test)"""


def RANKS(rel: str, cols) -> str:
    parts = []
    for c in cols:
        x = f"coalesce({c}, 0.0)"
        parts.append(f"CASE WHEN count(*) OVER () <= 1 THEN 0.0 ELSE (rank() OVER (ORDER BY {x}) "
                     f"+ (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 - 1) / (count(*) OVER () - 1) END AS r_{c}")
    return f"SELECT *, {', '.join(parts)} FROM {rel}"


def POS(part: str, order: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {order})"


SQL: dict[str, str] = {}

SQL["validate"] = f"""WITH {FX},
c AS (SELECT count(*) AS n_clinical, count(DISTINCT ID) AS n_clinical_ids FROM fx_clinical),
t AS (SELECT count(*) AS n_target, count(DISTINCT ID) AS n_target_ids,
        count(*) FILTER (WHERE OS_YEARS IS NULL) AS n_missing_time,
        count(*) FILTER (WHERE OS_STATUS IS NULL) AS n_missing_status,
        avg(CAST(OS_STATUS AS DOUBLE)) AS event_rate FROM fx_target),
m AS (SELECT count(*) AS n_without_target FROM (SELECT DISTINCT ID FROM fx_clinical) x
      WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = x.ID))
SELECT CAST(n_clinical AS BIGINT) AS n_clinical, CAST(n_clinical_ids AS BIGINT) AS n_clinical_ids,
  CAST(n_clinical - n_clinical_ids AS BIGINT) AS n_duplicate_clinical, CAST(n_target AS BIGINT) AS n_target,
  CAST(n_target - n_target_ids AS BIGINT) AS n_duplicate_target, CAST(n_without_target AS BIGINT) AS n_without_target,
  CAST(n_missing_time AS BIGINT) AS n_missing_time, CAST(n_missing_status AS BIGINT) AS n_missing_status,
  round(event_rate, 6) AS event_rate, round(1.0 - event_rate, 6) AS censoring_rate FROM c, t, m"""

SQL["semi_entities"] = f"WITH {FX} SELECT ID, CENTER FROM fx_clinical WHERE ID IN (SELECT ID FROM fx_target)"

SQL["anti_missing_target"] = f"""WITH {FX} SELECT CENTER, count(DISTINCT ID) AS n_missing_target FROM fx_clinical c
WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = c.ID) GROUP BY CENTER"""

SQL["entity_features"] = f"WITH {FX} {AGG_SQL('fx_molecular', True)}"

SQL["top_values"] = f"""WITH {FX} SELECT GENE, count(*) AS count FROM fx_molecular
WHERE ID IN (SELECT ID FROM fx_target) AND GENE IS NOT NULL GROUP BY GENE ORDER BY count DESC, GENE ASC LIMIT 10"""

SQL["indicator_pivot_binary"] = f"""WITH {FX}, {TOPLISTS},
{FEATS_SQL('mt', 'mt', True, 'BIGINT')} SELECT ID, feature, value FROM ind"""

SQL["indicator_pivot_count"] = f"""WITH {FX}, {TOPLISTS},
{FEATS_SQL('mt', 'mt', False, 'BIGINT')} SELECT ID, feature, value FROM ind"""

SQL["group_sum"] = f"""WITH {FX} SELECT c.ID, round(coalesce(s.vaf_sum, 0), 6) AS vaf_sum
FROM (SELECT DISTINCT ID FROM fx_clinical) c
LEFT JOIN (SELECT ID, sum(VAF) AS vaf_sum FROM fx_molecular WHERE VAF IS NOT NULL GROUP BY ID) s USING (ID)"""

SQL["group_count"] = f"""WITH {FX} SELECT c.ID, coalesce(s.n_events, 0) AS n_events
FROM (SELECT DISTINCT ID FROM fx_clinical) c
LEFT JOIN (SELECT ID, count(*) AS n_events FROM fx_molecular GROUP BY ID) s USING (ID)"""

SQL["group_stats"] = f"""WITH {FX} SELECT c.ID, round(coalesce(s.mean, 0), 6) AS mean, round(coalesce(s.std, 0), 6) AS std,
  round(coalesce(s.max, 0), 6) AS max FROM (SELECT DISTINCT ID FROM fx_clinical) c
LEFT JOIN (SELECT ID, avg(VAF) AS mean, stddev_samp(VAF) AS std, max(VAF) AS max FROM fx_molecular GROUP BY ID) s
USING (ID)"""

SQL["describe"] = f"""WITH {FX},
j AS (SELECT l.*, c.BM_BLAST, c.HB, c.PLT FROM lab l JOIN fx_clinical c USING (ID)),
lg AS (SELECT * FROM (SELECT 'BM_BLAST' AS "column", CAST(BM_BLAST AS DOUBLE) AS value FROM j
                      UNION ALL SELECT 'HB', CAST(HB AS DOUBLE) FROM j
                      UNION ALL SELECT 'PLT', CAST(PLT AS DOUBLE) FROM j
                      UNION ALL SELECT 'OS_YEARS', CAST(OS_YEARS AS DOUBLE) FROM j)
       WHERE value IS NOT NULL AND NOT isnan(value))
SELECT "column", CAST(count(*) AS BIGINT) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM lg GROUP BY "column\""""

SQL["value_counts"] = f"""WITH {FX} SELECT CENTER, count(*) AS count FROM fx_clinical WHERE CENTER IS NOT NULL
GROUP BY CENTER ORDER BY count DESC, CENTER"""

SQL["histogram_by_outcome"] = f"""WITH {FX},
st AS (SELECT min(OS_YEARS) AS mn, max(OS_YEARS) AS mx FROM lab),
b AS (SELECT OS_STATUS, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((OS_YEARS - mn) * (30.0 / (mx - mn))), 29) END
      AS INTEGER) AS bin, mn, mx FROM lab, st)
SELECT -1 AS OS_STATUS, bin, round(mn + bin * ((mx - mn) / 30.0), 6) AS lo,
  round(mn + (bin + 1) * ((mx - mn) / 30.0), 6) AS hi, CAST(count(*) AS BIGINT) AS count FROM b GROUP BY bin, mn, mx
UNION ALL
SELECT OS_STATUS, bin, round(mn + bin * ((mx - mn) / 30.0), 6) AS lo,
  round(mn + (bin + 1) * ((mx - mn) / 30.0), 6) AS hi, CAST(count(*) AS BIGINT) AS count FROM b
GROUP BY OS_STATUS, bin, mn, mx"""

SQL["median_events_per_entity"] = f"""WITH {FX} SELECT round(quantile_cont(n, 0.5), 6) AS median_events
FROM (SELECT ID, count(*) AS n FROM fx_molecular GROUP BY ID)"""

SQL["cluster_summary"] = f"""WITH {FX} SELECT c.CENTER, count(*) AS n, round(avg(CAST(l.OS_STATUS AS DOUBLE)), 6) AS event_rate,
  round(quantile_cont(l.OS_YEARS, 0.5), 6) AS median_time, round(avg(l.OS_YEARS), 6) AS mean_time
FROM lab l JOIN fx_clinical c USING (ID) GROUP BY c.CENTER"""

SQL["group_median_risk"] = f"""WITH {FX} SELECT c.CENTER, round(-quantile_cont(l.OS_YEARS, 0.5), 6) AS risk
FROM lab l JOIN fx_clinical c USING (ID) GROUP BY c.CENTER"""

SQL["fold_summary"] = f"""WITH {FX},
f AS (SELECT *, CAST(({POS('OS_STATUS', H('ID') + ', ID')} - 1) % 3 AS INTEGER) AS fold FROM lab),
per AS (SELECT fold, avg(CAST(OS_STATUS AS DOUBLE)) AS event_rate, avg(OS_YEARS) AS mean_time FROM f GROUP BY fold),
lg AS (SELECT fold, 'event_rate' AS metric, event_rate AS value FROM per
       UNION ALL SELECT fold, 'mean_time', mean_time FROM per)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, CAST(count(*) AS BIGINT) AS n_folds
FROM lg GROUP BY metric"""

SQL["text_flags"] = f"""WITH {FX} SELECT ID, {CYTO_SQL.strip()} FROM (SELECT ID, {S_EXPR} AS s FROM fx_clinical)"""

SQL["rule_flags"] = f"""WITH {FX} SELECT ID, {RULE_SQL.strip()} FROM (SELECT ID, {T_EXPR} AS t FROM fx_clinical)"""

SQL["comutation"] = f"""WITH {FX},
g AS (SELECT ID, max(CASE WHEN GENE = 'Brand#11' THEN 1 ELSE 0 END) AS a11, max(CASE WHEN GENE = 'Brand#12' THEN 1 ELSE 0 END) AS a12,
        max(CASE WHEN GENE = 'Brand#21' THEN 1 ELSE 0 END) AS a21, max(CASE WHEN GENE = 'Brand#33' THEN 1 ELSE 0 END) AS a33,
        max(CASE WHEN GENE = 'Brand#44' THEN 1 ELSE 0 END) AS a44, max(CASE WHEN GENE = 'Brand#55' THEN 1 ELSE 0 END) AS a55
      FROM fx_molecular GROUP BY ID)
SELECT ID, (a11 > 0 AND a12 > 0)::INTEGER AS "COMUT__Brand#11_Brand#12",
  (a21 > 0 AND a33 > 0)::INTEGER AS "COMUT__Brand#21_Brand#33",
  (a44 > 0 AND a55 > 0)::INTEGER AS "COMUT__Brand#44_Brand#55" FROM g"""

SQL["train_table"] = f"""WITH {FX}, {TOPLISTS},
ct AS (SELECT * FROM fx_clinical WHERE ID IN (SELECT ID FROM fx_target)),
{WIDE_SQL('ct', 'mt', True)}"""

SQL["aligned_test_table"] = f"""WITH {FX}, {TOPLISTS},
cu AS (SELECT * FROM fx_clinical c WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = c.ID)),
mu AS (SELECT * FROM fx_molecular m WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = m.ID)),
{WIDE_SQL('cu', 'mu', False)}"""

SQL["rank01"] = f"""WITH {FX}, j AS (SELECT l.ID, c.HB FROM lab l JOIN fx_clinical c USING (ID))
SELECT ID, round(HB, 6) AS HB, round(CASE WHEN count(*) OVER () <= 1 THEN 0.0 ELSE
  (rank() OVER (ORDER BY HB) + (count(*) OVER (PARTITION BY HB) - 1) / 2.0 - 1) / (count(*) OVER () - 1) END, 6) AS rank01
FROM j"""

SQL["minmax"] = f"""WITH {FX}, st AS (SELECT min(BM_BLAST) AS mn, max(BM_BLAST) AS mx FROM fx_clinical)
SELECT ID, round(BM_BLAST, 6) AS BM_BLAST,
  round(CASE WHEN mx - mn = 0 THEN 0.0 ELSE (BM_BLAST - mn) / (mx - mn) END, 6) AS bm_blast_mm FROM fx_clinical, st"""

STRATA = """q AS (SELECT min(OS_YEARS) AS mn, max(OS_YEARS) AS mx, quantile_cont(OS_YEARS, 1.0 / 3) AS e1,
               quantile_cont(OS_YEARS, 2.0 / 3) AS e2 FROM lab),
st AS (SELECT lab.*, concat_ws('_', CAST(OS_STATUS AS VARCHAR), CAST(
         (OS_YEARS > e1 AND e1 <> mn AND e1 <> mx)::INTEGER
       + (OS_YEARS > e2 AND e2 <> e1 AND e2 <> mn AND e2 <> mx)::INTEGER AS VARCHAR)) AS stratum FROM lab, q)"""

SQL["quantile_strata"] = f"WITH {FX}, {STRATA} SELECT ID, stratum FROM st"

SQL["stratified_split"] = f"""WITH {FX} SELECT ID, {POS('OS_STATUS', H('ID') + ', ID')}
  <= ceil(count(*) OVER (PARTITION BY OS_STATUS) * CAST(0.2 AS DOUBLE)) AS is_test FROM lab"""

SQL["holdout_split"] = f"""WITH {FX} SELECT ID, CAST({H('ID')} AS DOUBLE) / CAST(4294967296.0 AS DOUBLE)
  < CAST(0.3 AS DOUBLE) AS is_test FROM lab"""

SQL["kfold"] = f"""WITH {FX}, {STRATA}
SELECT ID, CAST(({POS('', H('ID') + ', ID')} - 1) % 3 AS INTEGER) AS fold,
  CAST(({POS('OS_STATUS', H('ID') + ', ID')} - 1) % 3 AS INTEGER) AS fold_event,
  CAST(({POS('stratum', H('ID') + ', ID')} - 1) % 3 AS INTEGER) AS fold_strata FROM st"""

SQL["dense_codes"] = f"""WITH {FX} SELECT ID, CENTER, CAST(dense_rank() OVER (ORDER BY CENTER) - 1 AS BIGINT) AS center_code
FROM fx_clinical"""

SQL["random_baseline"] = f"""WITH {FX} SELECT ID, round(CAST({H('ID')} AS DOUBLE) / CAST(4294967296.0 AS DOUBLE), 6) AS risk_score
FROM fx_clinical c WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = c.ID)"""

SQL["km_censoring"] = f"""WITH {FX}, {HOLDOUT},
{CINDEX_SQL('ts', 'HB').split('tw AS')[0].rstrip().rstrip(',')}
SELECT km.time AS time, CAST(km.r AS BIGINT) AS n_at_risk, CAST(km.d AS BIGINT) AS n_events,
  CAST(km.c AS BIGINT) AS n_censored, round(curve.G, 6) AS G FROM km JOIN curve USING (time)"""

SQL["ipcw_weights"] = f"""WITH {FX}, {HOLDOUT},
{CINDEX_SQL('ts', 'HB').split(',' + chr(10) + 'cidx AS')[0]}
SELECT ID, round(time, 6) AS time, event, round(ipcw, 6) AS ipcw FROM tw"""

SQL["ipcw_cindex"] = f"""WITH {FX}, {HOLDOUT}, {CINDEX_SQL('ts', 'HB')}
SELECT round(cindex, 6) AS cindex FROM cidx"""

SQL["harrell_cindex"] = f"""WITH {FX}, {HOLDOUT},
p AS (SELECT CAST(sum((j.HB < i.HB)::INTEGER) AS BIGINT) AS concordant,
             CAST(sum((j.HB > i.HB)::INTEGER) AS BIGINT) AS discordant,
             CAST(sum((j.HB = i.HB)::INTEGER) AS BIGINT) AS tied
      FROM ts i JOIN ts j ON j.time > i.time WHERE i.event)
SELECT concordant, discordant, tied, round(CASE WHEN concordant + discordant + tied = 0 THEN 0.5
  ELSE (concordant + 0.5 * tied) / (concordant + discordant + tied) END, 6) AS cindex FROM p"""

SQL["rank_ensemble"] = f"""WITH {FX}, j AS (SELECT l.ID, c.HB, c.BM_BLAST, c.PLT FROM lab l JOIN fx_clinical c USING (ID)),
rk AS ({RANKS('j', ['HB', 'BM_BLAST', 'PLT'])})
SELECT ID, round((r_HB + r_BM_BLAST + r_PLT) / 3.0, 6) AS ens3, round(0.5 * r_HB + 0.5 * r_BM_BLAST, 6) AS ens2 FROM rk"""

SQL["weight_sweep"] = f"""WITH {FX}, {HOLDOUT},
rk AS ({RANKS('ts', ['HB', 'BM_BLAST', 'PLT'])}),
sw AS (SELECT rk.*, w.weight, w.weight * r_HB + (1 - w.weight) * (r_BM_BLAST + r_PLT) / 2.0 AS ens
       FROM rk CROSS JOIN (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS weight) w),
{CINDEX_SQL('sw', 'te.ens', (), ['weight'])}
SELECT round(weight, 6) AS weight, round(cindex, 6) AS cindex,
  row_number() OVER (ORDER BY round(cindex, 6) DESC, weight) = 1 AS is_best FROM cidx"""

SQL["permutation_importance"] = f"""WITH {FX}, {HOLDOUT},
base AS (SELECT ID, time, event, coalesce(HB, 0.0) AS HB, coalesce(PLT, 0.0) AS PLT FROM ts),
plan AS (SELECT c.col AS "column", r.rep AS "repeat" FROM (SELECT unnest(['HB', 'PLT']) AS col) c,
         (SELECT unnest([0, 1, 2, 3, 4]) AS rep) r),
copies AS (SELECT b.*, p."column", p."repeat", CASE p."column" WHEN 'HB' THEN b.HB ELSE b.PLT END AS v,
           {H("concat_ws('|', p.\"column\", CAST(p.\"repeat\" AS VARCHAR), CAST(b.ID AS VARCHAR))")} AS h
           FROM base b, plan p),
pid AS (SELECT *, {POS('"column", "repeat"', 'ID')} AS pos FROM copies),
ph AS (SELECT "column", "repeat", v AS perm, {POS('"column", "repeat"', 'h, ID')} AS pos FROM copies),
perm AS (SELECT pid.ID, pid.time, pid.event, pid."column", pid."repeat",
           CASE WHEN pid."column" = 'HB' THEN ph.perm ELSE pid.HB END AS HB,
           CASE WHEN pid."column" = 'PLT' THEN ph.perm ELSE pid.PLT END AS PLT
         FROM pid JOIN ph ON pid."column" = ph."column" AND pid."repeat" = ph."repeat" AND pid.pos = ph.pos),
allc AS (SELECT * FROM perm UNION ALL SELECT ID, time, event, '__base__', -1, HB, PLT FROM base),
{CINDEX_SQL('allc', 'te.HB - te.PLT / 100.0', (), ['"column"', '"repeat"'])}
SELECT c."column", round(avg(b.cindex - c.cindex), 6) AS importance
FROM cidx c, (SELECT cindex FROM cidx WHERE "column" = '__base__') b WHERE c."column" <> '__base__'
GROUP BY c."column\""""

SQL["target_encode"] = f"""WITH {FX},
l2 AS (SELECT l.ID, c.CENTER, l.OS_STATUS, {TEST('l.ID')} AS is_test FROM lab l JOIN fx_clinical c USING (ID)),
g AS (SELECT avg(CAST(OS_STATUS AS DOUBLE)) AS gm FROM l2 WHERE NOT is_test),
m AS (SELECT CENTER, avg(CAST(OS_STATUS AS DOUBLE)) AS mm FROM l2 WHERE NOT is_test GROUP BY CENTER)
SELECT l2.ID, round(coalesce(m.mm, g.gm), 6) AS CENTER_TE, l2.is_test FROM l2 LEFT JOIN m USING (CENTER), g"""

SQL["impute_scale"] = f"""WITH {FX},
l2 AS (SELECT l.ID, c.BM_BLAST, c.HB, c.PLT, {TEST('l.ID')} AS is_test FROM lab l JOIN fx_clinical c USING (ID)),
md AS (SELECT quantile_cont(BM_BLAST, 0.5) AS m1, quantile_cont(HB, 0.5) AS m2, quantile_cont(PLT, 0.5) AS m3
       FROM l2 WHERE NOT is_test),
im AS (SELECT ID, is_test, coalesce(BM_BLAST, m1) AS BM_BLAST, coalesce(HB, m2) AS HB, coalesce(PLT, m3) AS PLT
       FROM l2, md),
sd AS (SELECT avg(BM_BLAST) AS a1, stddev_pop(BM_BLAST) AS s1, avg(HB) AS a2, stddev_pop(HB) AS s2,
              avg(PLT) AS a3, stddev_pop(PLT) AS s3 FROM im WHERE NOT is_test)
SELECT ID, round((BM_BLAST - a1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1.0 ELSE s1 END, 6) AS BM_BLAST,
  round((HB - a2) / CASE WHEN s2 = 0 OR s2 IS NULL THEN 1.0 ELSE s2 END, 6) AS HB,
  round((PLT - a3) / CASE WHEN s3 = 0 OR s3 IS NULL THEN 1.0 ELSE s3 END, 6) AS PLT FROM im, sd WHERE is_test"""

SQL["onehot"] = f"""WITH {FX},
tr AS (SELECT c.CENTER FROM lab l JOIN fx_clinical c USING (ID) WHERE NOT {TEST('l.ID')}),
cats AS (SELECT DISTINCT CENTER FROM tr WHERE CENTER IS NOT NULL),
md AS (SELECT CENTER AS mode FROM tr WHERE CENTER IS NOT NULL GROUP BY CENTER ORDER BY count(*) DESC, CENTER LIMIT 1),
u AS (SELECT ID, coalesce(CENTER, (SELECT mode FROM md)) AS CENTER FROM fx_clinical c
      WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = c.ID))
SELECT u.ID, 'CENTER_' || cats.CENTER AS feature, CAST(u.CENTER = cats.CENTER AS INTEGER) AS value FROM u CROSS JOIN cats"""

SQL["char_ngram_tfidf"] = f"""WITH {FX},
docs AS (SELECT ID, lower(regexp_replace(coalesce(CYTOGENETICS, '0'), '\\s\\s+', ' ', 'g')) AS s FROM fx_clinical
         WHERE ID IN (SELECT ID FROM fx_target)),
grams AS (SELECT ID, unnest(list_transform(range(0, length(s) - n + 1), lambda i: substr(s, i + 1, n))) AS term
          FROM docs, (SELECT unnest([3, 4, 5, 6]) AS n) ns WHERE length(s) >= n),
tf AS (SELECT ID, term, count(*) AS tf FROM grams GROUP BY ID, term),
vocab AS (SELECT term FROM tf GROUP BY term ORDER BY sum(tf) DESC, term ASC LIMIT 50),
tf2 AS (SELECT * FROM tf WHERE term IN (SELECT term FROM vocab)),
nd AS (SELECT count(DISTINCT ID) AS N FROM docs),
idf AS (SELECT term, ln((1.0 + N) / (1.0 + count(*))) + 1.0 AS idf FROM tf2, nd GROUP BY term, N),
w AS (SELECT ID, term, tf * idf AS w FROM tf2 JOIN idf USING (term)),
nrm AS (SELECT ID, sqrt(sum(w * w)) AS nrm FROM w GROUP BY ID)
SELECT ID, term, round(w / nrm, 6) AS weight FROM w JOIN nrm USING (ID)"""


SQL["mae"] = f"""WITH {FX},
l2 AS (SELECT l.ID, l.OS_YEARS, c.CENTER, {TEST('l.ID')} AS is_test FROM lab l JOIN fx_clinical c USING (ID)),
g AS (SELECT avg(OS_YEARS) AS gm FROM l2 WHERE NOT is_test),
m AS (SELECT CENTER, avg(OS_YEARS) AS mm FROM l2 WHERE NOT is_test GROUP BY CENTER)
SELECT round(avg(abs(OS_YEARS - coalesce(m.mm, g.gm))), 6) AS mae FROM l2 LEFT JOIN m USING (CENTER), g WHERE is_test"""

SQL["score_range"] = f"""WITH {FX},
l2 AS (SELECT l.ID, c.HB, {TEST('l.ID')} AS is_test FROM lab l JOIN fx_clinical c USING (ID))
SELECT count(*) AS n_labeled, count(*) FILTER (WHERE is_test) AS n_test, count(*) FILTER (WHERE NOT is_test) AS n_train,
  round(min(HB), 6) AS min_score, round(max(HB), 6) AS max_score FROM l2"""

SQL["top_results"] = f"""WITH {FX} SELECT c.CENTER, round(avg(CAST(l.OS_STATUS AS DOUBLE)), 6) AS event_rate, count(*) AS n
FROM lab l JOIN fx_clinical c USING (ID) GROUP BY c.CENTER
ORDER BY avg(CAST(l.OS_STATUS AS DOUBLE)) DESC, c.CENTER ASC LIMIT 5"""

SQL["score_gap"] = f"""WITH {FX}, {HOLDOUT}, {CINDEX_SQL('ts', 'HB')}
SELECT round(cindex, 6) AS cindex, round(cindex - 0.7744, 6) AS gap FROM cidx"""

SQL["preview"] = f"""WITH {FX} SELECT ID, CENTER, round(HB, 6) AS HB FROM fx_clinical ORDER BY ID LIMIT 5"""

SQL["gene_column_sums"] = f"""WITH {FX}, {TOPLISTS}, {FEATS_SQL('mt', 'mt', True, 'BIGINT', genes_only=True)}
SELECT feature, CAST(sum(value) AS BIGINT) AS total FROM ind GROUP BY feature"""

SQL["train_table_text"] = f"""WITH {FX} SELECT c.ID, coalesce(c.CENTER, '0') AS CENTER, coalesce(c.CYTOGENETICS, '0') AS CYTOGENETICS
FROM fx_clinical c JOIN lab l USING (ID)"""

SQL["csv_roundtrip"] = f"""WITH {FX},
un AS (SELECT * FROM fx_clinical c WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = c.ID)),
mu AS (SELECT * FROM fx_molecular m WHERE NOT EXISTS (SELECT 1 FROM fx_target t WHERE t.ID = m.ID)),
v AS (SELECT 'clinical_train' AS part, CAST(BM_BLAST AS DOUBLE) AS x FROM fx_clinical WHERE ID IN (SELECT ID FROM fx_target)
  UNION ALL SELECT 'clinical_test', PLT FROM un
  UNION ALL SELECT 'molecular_train', VAF FROM fx_molecular WHERE ID IN (SELECT ID FROM fx_target)
  UNION ALL SELECT 'molecular_test', DEPTH FROM mu
  UNION ALL SELECT 'target_train', OS_YEARS FROM fx_target
  UNION ALL SELECT 'target_status', OS_STATUS FROM fx_target
  UNION ALL SELECT 'risk_table', HB FROM un
  UNION ALL SELECT 'results', n FROM (SELECT CENTER, count(*) AS n FROM fx_clinical GROUP BY CENTER))
SELECT part, count(*) AS n_rows, count(x) AS n_values, round(sum(x), 6) AS total FROM v GROUP BY part"""

SQL["minmax_pair_sweep"] = f"""WITH {FX}, {HOLDOUT},
mm AS (SELECT ts.*, coalesce(PLT, 0.0) AS pl FROM ts),
st AS (SELECT min(HB) AS a0, max(HB) AS a1, min(pl) AS b0, max(pl) AS b1 FROM mm),
sc AS (SELECT mm.*, CASE WHEN a1 - a0 = 0 THEN 0.0 ELSE (HB - a0) / (a1 - a0) END AS mm_a,
              CASE WHEN b1 - b0 = 0 THEN 0.0 ELSE (pl - b0) / (b1 - b0) END AS mm_b FROM mm, st),
sw AS (SELECT sc.*, w.weight, w.weight * mm_a + (1 - w.weight) * mm_b AS ens
       FROM sc CROSS JOIN (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS weight) w),
{CINDEX_SQL('sw', 'te.ens', (), ['weight'])}
SELECT round(weight, 6) AS weight, round(cindex, 6) AS cindex,
  row_number() OVER (ORDER BY round(cindex, 6) DESC, weight) = 1 AS is_best FROM cidx"""


SQL["cv_fixed_scores"] = f"""WITH {FX},
j AS (SELECT l.ID, l.OS_YEARS AS time, l.OS_STATUS = 1 AS event, c.HB, c.PLT,
        CAST(({POS('l.OS_STATUS', H('l.ID') + ', l.ID')} - 1) % 3 AS INTEGER) AS fold
      FROM lab l JOIN fx_clinical c USING (ID)),
tr AS (SELECT f.k AS fold, j.time, j.event FROM j, (SELECT unnest([0, 1, 2]) AS k) f WHERE j.fold <> f.k),
te AS (SELECT ID, time, event, fold, 'HB' AS model, HB AS rsk FROM j
       UNION ALL SELECT ID, time, event, fold, 'neg_PLT' AS model, -coalesce(PLT, 0.0) AS rsk FROM j),
{CINDEX_SQL('te', 'te.rsk', ['fold'], ['fold', 'model'])}
SELECT fold, model, round(cindex, 6) AS cindex FROM cidx"""


SMALL = """sm AS (SELECT l.ID, l.OS_YEARS AS time, l.OS_STATUS AS d, c.HB / 10.0 AS x1, coalesce(c.BM_BLAST, 0.0) / 100.0 AS x2,
  coalesce(c.PLT, 0.0) / 400.0 AS x3 FROM lab l JOIN fx_clinical c USING (ID))"""

_PAIRS = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
_NL = ",\n  "
SQL["cox_terms"] = f"""WITH {FX}, {SMALL},
e AS (SELECT *, 0.05 * x1 - 0.02 * x2 + 0.03 * x3 AS eta, exp(0.05 * x1 - 0.02 * x2 + 0.03 * x3) AS e FROM sm),
g AS (SELECT time, sum(d) AS d, sum(d * eta) AS de, {', '.join(f'sum(d * x{i}) AS dx{i}' for i in (1, 2, 3))}, sum(e) AS e0,
  {', '.join(f'sum(e * x{i}) AS e{i}' for i in (1, 2, 3))}, {', '.join(f'sum(e * x{i} * x{j}) AS e{i}{j}' for i, j in _PAIRS)}
  FROM e GROUP BY time),
s AS (SELECT *, {', '.join(f'sum(e{k}) OVER w AS s{k}' for k in ['0', '1', '2', '3', *[f'{i}{j}' for i, j in _PAIRS]])}
  FROM g WINDOW w AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
n AS (SELECT count(*) AS n FROM sm),
v AS (SELECT 'loglik' AS term, sum(de - d * ln(s0)) AS value FROM s
  {' '.join(f"UNION ALL SELECT 'g{i}', sum(dx{i} - d * s{i} / s0) FROM s" for i in (1, 2, 3))}
  {' '.join(f"UNION ALL SELECT 'h{i}{j}', sum(d * (s{i}{j} / s0 - s{i} * s{j} / (s0 * s0))) FROM s" for i, j in _PAIRS)})
SELECT term, round(value / n, 6) AS value FROM v, n"""

SQL["boost_first_residuals"] = f"""WITH {FX}, {SMALL},
g AS (SELECT time, count(*) AS n, sum(d) AS d FROM sm GROUP BY time),
r AS (SELECT time, d, sum(n) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM g),
h AS (SELECT time, sum(CASE WHEN d > 0 THEN CAST(d AS DOUBLE) / at_risk ELSE 0.0 END) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS hz FROM r)
SELECT ID, round(d - hz, 6) AS residual FROM sm JOIN h USING (time)"""


_COARSE = ("floor(HB)", "floor(coalesce(BM_BLAST, 0.0) / 10)", "floor(coalesce(PLT, 0.0) / 10)")
SQL["boost_first_tree"] = f"""WITH {FX},
sm AS (SELECT l.ID, l.OS_YEARS AS time, l.OS_STATUS AS d, {', '.join(f'{x} AS f{i}' for i, x in enumerate(_COARSE))} FROM lab l JOIN fx_clinical c USING (ID)),
g AS (SELECT time, count(*) AS n, sum(d) AS d FROM sm GROUP BY time),
r AS (SELECT time, d, sum(n) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM g),
h AS (SELECT time, sum(CASE WHEN d > 0 THEN CAST(d AS DOUBLE) / at_risk ELSE 0.0 END) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS hz FROM r),
x AS (SELECT sm.*, sm.d - hz AS res FROM sm JOIN h USING (time)),
v AS (SELECT unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS v, res FROM x),
b AS (SELECT f, v, sum(res) AS s, count(*) AS n FROM v GROUP BY f, v),
c AS (SELECT f, v, lead(v) OVER w AS nxt, sum(s) OVER (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING) AS sl,
  sum(n) OVER (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING) AS nl, sum(s) OVER (PARTITION BY f) AS st, sum(n) OVER (PARTITION BY f) AS nt
  FROM b WINDOW w AS (PARTITION BY f ORDER BY v)),
best AS (SELECT *, sl / nl AS lv, (st - sl) / (nt - nl) AS rv FROM c WHERE nxt IS NOT NULL AND nl >= 5 AND nt - nl >= 5
  ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, f, v LIMIT 1)
SELECT 'feature' AS term, CAST(f AS DOUBLE) AS value FROM best UNION ALL SELECT 'cut', (v + nxt) / 2.0 FROM best
UNION ALL SELECT 'left', round(lv, 6) FROM best UNION ALL SELECT 'right', round(rv, 6) FROM best
UNION ALL SELECT 'loglik', round(-sum(d * ln(at_risk)) / 1000.0, 6) FROM r"""

SQL["svd_trace"] = f"""WITH {FX}
SELECT 'trace' AS term, CAST(count(*) AS DOUBLE) AS value FROM lab JOIN fx_clinical USING (ID) WHERE NOT {TEST()}
AND length(coalesce(CYTOGENETICS, '0')) >= 3"""

SQL["gene_filter"] = f"""WITH {FX},
top AS (SELECT GENE FROM fx_molecular WHERE GENE IS NOT NULL GROUP BY GENE ORDER BY count(*) DESC, GENE ASC LIMIT 3)
SELECT GENE, EFFECT, count(*) AS n_list, count(*) AS n_table FROM fx_molecular WHERE GENE IN (SELECT GENE FROM top) GROUP BY GENE, EFFECT"""

_NUMBER = r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*"
SQL["lenient_numbers"] = f"""WITH {FX},
t AS (SELECT ID, CASE ID % 9 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(VAF AS VARCHAR) || 'd' WHEN 2 THEN ' +' || CAST(VAF AS VARCHAR) || ' ' WHEN 3 THEN ''
  WHEN 4 THEN 'nan' WHEN 5 THEN '1e-2' WHEN 6 THEN '.5' ELSE CAST(VAF AS VARCHAR) END AS vt,
  CASE ID % 9 WHEN 7 THEN 'n/a' ELSE CAST(DEPTH AS VARCHAR) END AS dt FROM fx_molecular),
n AS (SELECT ID, CASE WHEN regexp_full_match(vt, '{_NUMBER}') THEN TRY_CAST(ltrim(trim(vt), '+') AS DOUBLE) END AS VAF,
  CASE WHEN regexp_full_match(dt, '{_NUMBER}') THEN TRY_CAST(trim(dt) AS DOUBLE) END AS DEPTH FROM t)
SELECT ID, count(*) AS n_mut, round(coalesce(avg(VAF), 0), 6) AS vaf_mean, round(coalesce(max(VAF), 0), 6) AS vaf_max,
  round(coalesce(quantile_cont(VAF, 0.9), 0), 6) AS vaf_p90, round(coalesce(sum(VAF), 0), 6) AS vaf_sum,
  count(*) FILTER (WHERE VAF > 0.3) AS n_vaf_gt_30, round(coalesce(avg(DEPTH), 0), 6) AS depth_mean, round(coalesce(max(DEPTH), 0), 6) AS depth_max
FROM n GROUP BY ID"""

SQL["entity_sketches"] = f"""WITH {FX} SELECT ID, count(*) AS n_mut, count(DISTINCT GENE) AS n_unique_genes, count(DISTINCT EFFECT) AS n_unique_effects,
  round(coalesce(quantile_disc(VAF, 0.9), 0), 6) AS vaf_p90 FROM fx_molecular GROUP BY ID"""


def _poisson_case(u: str, lam: float = 1.0) -> str:
    cdf, p, k, out = 0.0, math.exp(-lam), 0, []
    while True:
        cdf += p
        out.append(f"WHEN {u} < CAST({cdf!r} AS DOUBLE) THEN {k}")
        p, k = p * lam / (k + 1), k + 1
        if 1.0 - cdf < 2.0 ** -33 and k > lam:
            return f"CASE {' '.join(out)} ELSE {k} END"


SQL["rf_weights"] = f"""WITH {FX},
u AS (SELECT ID, CAST(tree AS INTEGER) AS tree,
  CAST(('0x' || substr(md5('42|' || CAST(tree AS VARCHAR) || '|' || CAST(ID AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / CAST(4294967296.0 AS DOUBLE) AS u
  FROM lab, (SELECT unnest([0, 1, 2, 3]) AS tree) t)
SELECT ID, tree, CAST({_poisson_case('u')} AS INTEGER) AS weight FROM u"""

SQL["ridge_small"] = f"""WITH {FX}, {SMALL},
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(time) AS my FROM sm),
c AS (SELECT x1 - m1 AS a, x2 - m2 AS b, time - my AS y FROM sm, m),
q AS (SELECT sum(a * a) + 1.0 AS aa, sum(a * b) AS ab, sum(b * b) + 1.0 AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM c),
w AS (SELECT (bb * ay - ab * yb) / (aa * bb - ab * ab) AS w1, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS w2 FROM q)
SELECT 'w1' AS term, round(w1, 6) AS value FROM w UNION ALL SELECT 'w2', round(w2, 6) FROM w
UNION ALL SELECT 'intercept', round(my - w1 * m1 - w2 * m2, 6) FROM w, m"""


def oracle_sql() -> dict:
    return dict(SQL)
