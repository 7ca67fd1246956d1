"""Input views: the business tables the operators expect, over the given star schema.

Each view is one SELECT that means the same in Spark SQL and in DuckDB, so the Spark query
and its SQL twin start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# One row per order line, with exact decimal money
SALES = """
SELECT s.*, CAST(s.total_revenue - s.refund_amount AS DECIMAL(18,2)) AS net_revenue
FROM (
  SELECT b.*, CAST(ROUND(b.is_returned * b.total_revenue * CAST(0.90 AS DECIMAL(3,2)), 2)
                   AS DECIMAL(18,2)) AS refund_amount
  FROM (
    SELECT l_orderkey AS order_id, o_custkey AS customer_id,
           CAST(o_orderdate AS DATE) AS order_date, l_partkey AS product_id,
           CASE p_type WHEN 'STANDARD' THEN 'Electronics' WHEN 'ECONOMY' THEN 'Fashion'
                       WHEN 'MEDIUM' THEN 'Books' WHEN 'SMALL' THEN 'Sports'
                       WHEN 'LARGE' THEN 'Beauty' ELSE 'Home & Kitchen' END AS product_category,
           r_name AS customer_region, o_orderpriority AS payment_method,
           CAST(p_retailprice AS DECIMAL(12,2)) AS price,
           CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DOUBLE) AS discount_percent,
           CAST(l_quantity AS INT) AS quantity_sold,
           p_retailprice * (1 - l_discount) AS discounted_price,
           CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2))
                * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS total_revenue,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_returned,
           CAST(1 + p_size % 5 AS INT) AS rating, CAST(p_size AS INT) AS review_count
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  ) b
) s
"""

# One row per order
TX = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS category,
       o_orderstatus AS status
FROM orders
"""

# The same orders with their dates pressed into a short and into a refused span of history
PRESSED = """CAST(DATE '2000-08-01' + CAST(floor(((year(o_orderdate) - 1995) * 365 + month(o_orderdate) * 30
         + day(o_orderdate)) / {days}) AS INT) AS DATE) AS order_date"""
TX_SHORT = TX.replace("CAST(o_orderdate AS DATE) AS order_date", PRESSED.format(days=7))
TX_TINY = TX.replace("CAST(o_orderdate AS DATE) AS order_date", PRESSED.format(days=20))

VIEWS = {"sales": SALES, "tx": TX, "tx_short": TX_SHORT, "tx_tiny": TX_TINY}


def rounded(expr: str, digits: int) -> str:
    """SQL rounding half away from zero on the decimal digits, as Spark rounds doubles."""
    return f"CAST(ROUND(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,19)), {digits}) AS DOUBLE)"


def typed(sql: str, **kinds: str) -> str:
    """Give result columns of a twin the types Spark has: ``typed(sql, INT="year month")``."""
    casts = ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for kind, names in kinds.items()
                      for c in names.split())
    return f"SELECT * REPLACE ({casts}) FROM ({sql.strip()})"


def with_views(sql: str) -> str:
    """Prepend the views a SQL text names as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Inputs:
    """Tables and views of one data folder."""

    _cache: dict[tuple[str, str, str], DataFrame] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        df = self._cache.get(key)
        if df is None or df.sparkSession.sparkContext._jsc is None:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            self._cache[key] = df
        return df

    def sql(self, text: str) -> DataFrame:
        """Run a SELECT over the given tables."""
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def scratch(self) -> str:
        """A fresh folder next to the session's checkpoints (a temporary one in tests)."""
        import uuid

        from tillwise.session import checkpoint_folder

        return f"{checkpoint_folder(self.spark)}/run-{uuid.uuid4().hex}"
