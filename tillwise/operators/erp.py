"""ERP records (landed as files): source filters, common schema, union, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import col

# Field lists and base filters of the four record kinds (fixed values)
FIELDS = {
    "leads": ["id", "name", "partner_id", "expected_revenue", "probability", "stage_id",
              "date_deadline", "date_open", "date_conversion", "date_closed", "user_id", "team_id",
              "type", "active", "create_date", "write_date"],
    "orders": ["id", "name", "partner_id", "amount_total", "amount_untaxed", "amount_tax",
               "date_order", "state", "team_id", "user_id", "payment_term_id", "currency_id",
               "company_id", "create_date", "write_date"],
    "invoices": ["id", "name", "partner_id", "amount_total", "amount_untaxed", "amount_residual",
                 "invoice_date", "invoice_date_due", "payment_state", "state", "move_type",
                 "currency_id", "create_date", "write_date"],
    "partners": ["id", "name", "customer_rank", "supplier_rank", "country_id", "industry_id",
                 "city", "email", "is_company", "active", "create_date", "write_date"],
}
NEWEST = {"leads": "create_date", "orders": "date_order", "invoices": "invoice_date",
          "partners": "create_date"}
CHANGED = {"leads": "write_date", "orders": "date_order", "invoices": "invoice_date"}


def base_filter(kind: str, counting: bool = False) -> Column:
    if kind == "leads":
        return col("active")
    if kind == "orders":
        return col("state").isin("sale", "done")
    if kind == "invoices":
        posted = F.lit(True) if counting else col("state") == "posted"
        return col("move_type").isin("out_invoice", "out_refund") & posted
    if kind == "partners":
        return col("customer_rank") > 0 if counting else col("active") & (col("customer_rank") > 0)
    raise ValueError(f"unknown record kind: {kind}")


def erp_scan(df: DataFrame, kind: str, since=None, limit: int | None = None) -> DataFrame:
    """Base filter, fixed fields, changed since a time; newest first when limited."""
    out = df.where(base_filter(kind))
    if since is not None and kind in CHANGED:
        value = since if isinstance(since, Column) else F.lit(since)
        if kind == "invoices":
            value = value.cast("date")
        out = out.where(col(CHANGED[kind]) >= value)
    out = out.select(*[c for c in FIELDS[kind] if c in df.columns])
    return out.orderBy(F.desc(NEWEST[kind]), F.desc("id")).limit(limit) if limit else out


def erp_preview(df: DataFrame, kind: str, n: int = 20) -> DataFrame:
    """Newest rows (1..200) of one record kind."""
    return erp_scan(df, kind, limit=max(1, min(n, 200)))


def erp_model_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in tables.items():
        one = df.where(base_filter(kind, counting=True)).agg(F.count("*").alias("records")).select(
            F.lit(kind).alias("model"), "records")
        out = one if out is None else out.unionByName(one)
    return out


def ref_id(c) -> Column:
    """Id of a many-to-one field: ``[id, name]``, or ``false`` when unset."""
    return F.try_variant_get(F.try_parse_json(col(c)), "$[0]", "bigint")


def ref_name(c) -> Column:
    return F.try_variant_get(F.try_parse_json(col(c)), "$[1]", "string")


def _money(c: str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def _common(df: DataFrame, source: str, given: dict[str, Column]) -> DataFrame:
    text, num, big = "string", "double", "bigint"
    shape = [("source", text), ("order_id", big), ("order_name", text), ("order_date", text),
             ("amount", num), ("amount_untaxed", num), ("amount_tax", num), ("state", text),
             ("payment_state", text), ("customer_id", big), ("customer_name", text),
             ("salesperson_id", big), ("salesperson_name", text), ("team_id", big),
             ("team_name", text), ("expected_revenue", num), ("probability", num),
             ("stage", text), ("create_date", text)]
    base = {"source": F.lit(source), "order_id": col("id"), "order_name": col("name"),
            "customer_id": ref_id("partner_id"), "customer_name": ref_name("partner_id"),
            "create_date": col("create_date"), **given}
    return df.select(*[base.get(n, F.lit(None)).cast(t).alias(n) for n, t in shape])


def erp_normalise_orders(df: DataFrame) -> DataFrame:
    return _common(df, "sale.order", {
        "order_date": col("date_order"), "amount": _money("amount_total"),
        "amount_untaxed": _money("amount_untaxed"), "amount_tax": _money("amount_tax"),
        "state": col("state"), "salesperson_id": ref_id("user_id"),
        "salesperson_name": ref_name("user_id"), "team_id": ref_id("team_id"),
        "team_name": ref_name("team_id")})


def erp_normalise_invoices(df: DataFrame) -> DataFrame:
    return _common(df, "account.move", {
        "order_date": col("invoice_date"), "amount": _money("amount_total"),
        "amount_untaxed": _money("amount_untaxed"),
        "amount_tax": _money("amount_total") - _money("amount_untaxed"),
        "state": col("state"), "payment_state": col("payment_state")})


def erp_normalise_leads(df: DataFrame) -> DataFrame:
    return _common(df, "crm.lead", {
        "order_date": F.coalesce("date_open", "create_date"),
        "amount": _money("expected_revenue"), "amount_untaxed": _money("expected_revenue"),
        "amount_tax": F.lit(0.0),
        "state": F.when(col("type") == "lead", "lead").otherwise("opportunity"),
        "salesperson_id": ref_id("user_id"), "salesperson_name": ref_name("user_id"),
        "team_id": ref_id("team_id"), "team_name": ref_name("team_id"),
        "expected_revenue": _money("expected_revenue"), "probability": _money("probability"),
        "stage": ref_name("stage_id")})


def erp_union(orders: DataFrame | None = None, invoices: DataFrame | None = None,
              leads: DataFrame | None = None) -> DataFrame:
    """The given record kinds in one common schema."""
    parts = [f(d) for f, d in ((erp_normalise_orders, orders), (erp_normalise_invoices, invoices),
                               (erp_normalise_leads, leads)) if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def erp_partner_enrich(df: DataFrame, partners: DataFrame) -> DataFrame:
    """Country, industry and company flag by customer.

    No hint: the partner table grows with the business, so its measured size decides the join.
    """
    look = partners.select(col("id").alias("customer_id"), ref_name("country_id").alias("country"),
                           ref_name("industry_id").alias("industry"),
                           F.coalesce("is_company", F.lit(False)).alias("is_company"))
    return df.join(look, "customer_id", "left")


def erp_derived_columns(df: DataFrame) -> DataFrame:
    """Parsed date and its parts, unit quantity, price."""
    day = F.try_to_timestamp(col("order_date")).cast("timestamp_ntz")
    out = df.withColumn("order_date", day)
    return out.withColumns({
        "month": F.month("order_date"), "quarter": F.quarter("order_date"),
        "year": F.year("order_date"), "quantity_sold": F.lit(1), "price": F.col("amount")})


def last_sync(uploads: DataFrame, category: str = "erp") -> Column:
    """Time of the last completed sync, as a column for ``since``."""
    return uploads.where((col("category") == category) & (col("status") == "completed")).agg(
        F.max("uploaded_at")).scalar()
