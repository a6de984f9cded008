"""Problem 2: profile of every column of feature_shift, load by load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastglass.operators.profile import findings, profile
from pastglass.sources.tables import table

RANGES = {"ks": (0.0, 1.0), "missing_from": (0.0, 1.0), "psi": (0.0, None)}
PATTERNS = {"feature": r"\A[a-z0-9_]*\z"}
COLUMNS = ["feature", "from_season", "to_season", "ks", "psi", "mean_from", "mean_to", "median_from", "median_to", "missing_from", "missing_to", "loaded_at"]
KEYS = {"load": "load_id", "feed": "feed_id", "number": "load_no"}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of a load with values out of range, one value only, more nulls, another distribution or bad names."""
    rows = table(spark, folder, "feature_shift")
    told = profile(rows, **KEYS, columns=[*RANGES, "feature"], ranges=RANGES, patterns=PATTERNS)
    return findings(told, measured=list(RANGES), named=["feature"], null_rise=0.10, drift=0.2537).select("load_id", "column_name", "finding")


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of every load."""
    told = profile(table(spark, folder, "feature_shift"), **KEYS, columns=COLUMNS, ranges=RANGES, patterns=PATTERNS)
    return told.select(
        "load_id", "column_name", "n_rows", "n_null", "n_distinct", "min_num", "max_num", "min_txt", "max_txt", "n_unusable", "n_malformed",
        *[F.round(c, 6).alias(c) for c in ("null_share", "null_share_before", "ks_before", "psi_before", "chi2_before")],
    )


def _long(columns: list[str]) -> str:
    numbers = {"from_season", "to_season", "ks", "psi", "mean_from", "mean_to", "median_from", "median_to", "missing_from", "missing_to"}
    text = lambda c: "strftime(loaded_at, '%Y-%m-%d %H:%M:%S')" if c == "loaded_at" else c
    return " UNION ALL ".join(f"SELECT load_id, feed_id, load_no, '{c}' AS column_name, {f'{c}::DOUBLE' if c in numbers else 'NULL::DOUBLE'} AS num, {'NULL::VARCHAR' if c in numbers else text(c)} AS txt FROM feature_shift" for c in columns)


def _sql(columns: list[str], rest: str) -> str:
    return f"""
WITH l AS ({_long(columns)}),
vc AS (SELECT load_id, feed_id, load_no, column_name, num, txt, count(*) AS cnt,
  coalesce(num IS NOT NULL AND isfinite(num) AND (column_name NOT IN ('ks', 'missing_from') OR num BETWEEN 0 AND 1) AND (column_name <> 'psi' OR num >= 0), false) AS ok
  FROM l GROUP BY ALL),
own AS (SELECT load_id, feed_id, load_no, column_name, sum(cnt)::BIGINT AS n_rows, sum(CASE WHEN num IS NULL AND txt IS NULL THEN cnt ELSE 0 END)::BIGINT AS n_null,
  count(CASE WHEN num IS NOT NULL OR txt IS NOT NULL THEN 1 END) AS n_distinct, min(CASE WHEN NOT isnan(num) THEN num END) AS min_num, max(CASE WHEN NOT isnan(num) THEN num END) AS max_num,
  min(txt) AS min_txt, max(txt) AS max_txt, sum(CASE WHEN ok THEN cnt ELSE 0 END)::BIGINT AS n_usable, count(CASE WHEN ok THEN 1 END) AS distinct_usable,
  sum(CASE WHEN num IS NOT NULL AND NOT ok THEN cnt ELSE 0 END)::BIGINT AS n_unusable,
  sum(CASE WHEN column_name = 'feature' AND txt IS NOT NULL AND NOT regexp_full_match(txt, '[a-z0-9_]*') THEN cnt ELSE 0 END)::BIGINT AS n_malformed
  FROM vc GROUP BY ALL),
g AS (SELECT feed_id, load_no, column_name, num, txt, cnt FROM vc WHERE ok OR txt IS NOT NULL),
m AS (SELECT feed_id, load_no, column_name, num, txt, sum(c) AS c, sum(p) AS p FROM
  (SELECT feed_id, load_no, column_name, num, txt, cnt AS c, 0 AS p FROM g UNION ALL SELECT feed_id, load_no + 1, column_name, num, txt, 0, cnt FROM g) GROUP BY ALL),
f AS (SELECT *, sum(c) OVER w AS cc, sum(p) OVER w AS cp, sum(c) OVER e AS nc, sum(p) OVER e AS np FROM m
  WINDOW w AS (PARTITION BY feed_id, load_no, column_name ORDER BY num, txt), e AS (PARTITION BY feed_id, load_no, column_name)),
t AS (SELECT feed_id, load_no, column_name, CASE WHEN num IS NOT NULL THEN least(greatest(ceil(cp::DOUBLE / np * 10) - 1, 0), 9) END AS tenth,
  max(CASE WHEN num IS NOT NULL THEN abs(cc::DOUBLE / nc - cp::DOUBLE / np) END) AS ks, sum(pow(sqrt(np::DOUBLE / nc) * c - sqrt(nc::DOUBLE / np) * p, 2) / (c + p)) AS chi2,
  sum(CASE WHEN num IS NOT NULL THEN c END)::DOUBLE AS c, sum(CASE WHEN num IS NOT NULL THEN p END)::DOUBLE AS p, max(nc) AS nc, max(np) AS np FROM f WHERE nc > 0 AND np > 0 GROUP BY ALL),
ch AS (SELECT feed_id, load_no, column_name, max(ks) AS ks_before, sum((greatest(c / nc, 1e-6) - greatest(p / np, 1e-6)) * ln(CASE WHEN c IS NOT NULL THEN greatest(c / nc, 1e-6) / greatest(p / np, 1e-6) END)) AS psi_before, sum(chi2) AS chi2_before FROM t GROUP BY ALL),
r AS (SELECT own.*, own.n_null::DOUBLE / own.n_rows AS null_share, b.n_null::DOUBLE / b.n_rows AS null_share_before, ks_before, CASE WHEN ks_before IS NOT NULL THEN psi_before END AS psi_before, chi2_before
  FROM own LEFT JOIN own b ON b.feed_id = own.feed_id AND b.load_no = own.load_no - 1 AND b.column_name = own.column_name
  LEFT JOIN ch ON ch.feed_id = own.feed_id AND ch.load_no = own.load_no AND ch.column_name = own.column_name)
{rest}"""


SQL = {
    "p2_found": _sql(
        [*RANGES, "feature"],
        """SELECT load_id, column_name, 'range' AS finding FROM r WHERE column_name <> 'feature' AND n_unusable > 0
UNION ALL SELECT load_id, column_name, 'distinct' FROM r WHERE column_name <> 'feature' AND n_usable >= 2 AND distinct_usable = 1
UNION ALL SELECT load_id, column_name, 'nulls' FROM r WHERE column_name <> 'feature' AND null_share - null_share_before > 0.10
UNION ALL SELECT load_id, column_name, 'drift' FROM r WHERE column_name <> 'feature' AND ks_before > 0.2537
UNION ALL SELECT load_id, column_name, 'pattern' FROM r WHERE column_name = 'feature' AND n_malformed > 0""",
    ),
    "p2_profile": _sql(
        COLUMNS,
        """SELECT load_id, column_name, n_rows, n_null, n_distinct, min_num, max_num, min_txt, max_txt, n_unusable, n_malformed, round(null_share, 6) AS null_share,
  round(null_share_before, 6) AS null_share_before, round(ks_before, 6) AS ks_before, round(psi_before, 6) AS psi_before, round(chi2_before, 6) AS chi2_before FROM r""",
    ),
}

QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile}
