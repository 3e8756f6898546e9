"""What the query modules share: the voxel view and confusion counts as SQL, and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOX = """
vox AS (
  SELECT l_suppkey AS case_id, l_linenumber - 1 AS x, l_partkey % 8 AS y, CAST(floor(l_quantity) AS BIGINT) % 8 AS z,
         max(l_orderkey % 4) AS gt, min((l_orderkey + l_linenumber) % 4) AS pred
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def confusion_sql(labels: tuple[int, ...] = (1, 2, 3), where: str = "true") -> str:
    """``cm(case_id, label, tp, fp, fn, tn)`` as a WITH clause."""
    return f"""
WITH {VOX},
cls AS (SELECT unnest({list(labels)})::BIGINT AS label),
cm AS (
  SELECT v.case_id, k.label,
         count(*) FILTER (WHERE gt = k.label AND pred = k.label) AS tp, count(*) FILTER (WHERE gt <> k.label AND pred = k.label) AS fp,
         count(*) FILTER (WHERE gt = k.label AND pred <> k.label) AS fn, count(*) FILTER (WHERE gt <> k.label AND pred <> k.label) AS tn
  FROM vox v CROSS JOIN cls k WHERE {where} GROUP BY 1, 2)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` with its doubles rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
