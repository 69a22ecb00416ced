"""Warehouse aggregates and dashboard summaries.

Sums of money run on decimals and become doubles only in the result; every
aggregate is a plain hash aggregation with a map-side partial step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.columns import col, dbl, percent, ratio, text



def _in_range(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Half-open ``[start, end)`` filter; both ends optional."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end))
    return df


def max_of(df: DataFrame, c: str | Column) -> Column:
    """Largest value of a column (default of ``as_of``) as a literal.

    It is asked for first, so that filters built on it, with any arithmetic or
    cast around it, fold to constants and reach the file statistics. Null where
    there are no rows.
    """
    top = F.max(col(c)).alias("as_of")
    kind = df.select(col(c)).dtypes[0][1]
    if kind == "timestamp":
        return F.timestamp_micros(F.lit(df.agg(F.unix_micros(top)).first()[0]).cast("bigint"))
    return F.lit(df.agg(top).first()[0]).cast(kind)


def daily_sales(sales, sources=("pos", "api_sales"), start=None, end=None) -> DataFrame:
    picked = _in_range(sales.where(F.col("source").isin(*sources)), "ts", start, end)
    return picked.groupBy(text("sale_date").alias("sale_date"), "branch_id").agg(
        dbl(F.sum("amount")).alias("total_sales"),
        F.count("*").alias("transaction_count"),
        ratio(F.sum("amount"), F.count("*")).alias("avg_sale"),
    )


def monthly_sales(sales, sources=("pos", "api_sales"), approximate=False, start=None, end=None):
    picked = _in_range(sales.where(F.col("source").isin(*sources)), "ts", start, end)
    distinct = F.approx_count_distinct("customer_id", 0.02) if approximate else F.count_distinct("customer_id")
    return picked.groupBy(text(F.trunc("sale_date", "month")).alias("month"), "branch_id").agg(
        dbl(F.sum("amount")).alias("total_sales"),
        F.count("*").alias("transaction_count"),
        distinct.alias("unique_customers"),
    )


def daily_customer_sketches(sales) -> DataFrame:
    """HLL sketch of the customers per day and branch. Sketches are small and
    merge over any coarser group, so no later count reads the sales again."""
    return sales.groupBy("sale_date", "branch_id").agg(F.hll_sketch_agg("customer_id", 12).alias("customers"))


def store_customer_sketches(spark, path: str, sales, months: list | None = None) -> None:
    """Write the sketches per day and branch of these months (first days; all, if
    none are named) into a table by month; months written again are replaced."""
    month = F.trunc("sale_date", "month").alias("month")
    picked = sales if months is None else sales.where(F.trunc("sale_date", "month").isin(*months))
    # A month is some thousand bytes per day and branch: one writer each.
    kept = daily_customer_sketches(picked).select(month, "*").repartition("month")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def customers_of(sketches, keys) -> DataFrame:
    """Estimated different customers per group of stored sketches."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers"))


def inventory_snapshot(readings, as_of: Column, days=7) -> DataFrame:
    """Last reading per day, branch and product in the last days. ``max_by``
    keeps one row per key before the shuffle."""
    recent = readings.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    last = recent.groupBy(F.to_date("ts").alias("day"), "branch_id", "product_id").agg(
        F.max_by(F.struct("stock", "unit_price"), F.struct("ts", "event_id")).alias("r")
    )
    return last.select(
        text("day").alias("snapshot_date"),
        "branch_id",
        "product_id",
        F.col("r.stock").alias("current_stock"),
        dbl(F.col("r.stock") * F.col("r.unit_price")).alias("stock_value"),
    )


def staff_performance(sales, hours, default_hours=8) -> DataFrame:
    """Sales per day, staff and branch joined with hours summed per staff day."""
    per_day = hours.where(F.col("staff_id").isNotNull()).groupBy("work_date", "staff_id").agg(
        F.sum("hours_worked").alias("hours")
    )
    sold = sales.where(F.col("staff_id").isNotNull()).groupBy("sale_date", "staff_id", "branch_id").agg(
        F.sum("amount").alias("total"), F.count("*").alias("transaction_count")
    )
    joined = sold.join(
        per_day, (sold.sale_date == per_day.work_date) & (sold.staff_id == per_day.staff_id), "left"
    )
    h = F.coalesce(F.col("hours"), F.lit(default_hours)).cast("long")
    return joined.select(
        text(sold.sale_date).alias("work_date"),
        sold.staff_id,
        "branch_id",
        dbl("total").alias("total_sales"),
        "transaction_count",
        h.alias("hours_worked"),
        ratio("total", h, 0).alias("sales_per_hour"),
    )


AGG_FUNCTIONS = ("sum", "avg", "min", "max", "count", "count_distinct", "stddev_pop", "median")


def generic(df, aggregates: list[dict], group: list[str], ts=None, start=None, end=None) -> DataFrame:
    """``aggregates``: dicts with function, field and alias."""
    picked = _in_range(df, ts, start, end) if ts else df
    cols = []
    for a in aggregates:
        if a["function"] not in AGG_FUNCTIONS:
            raise ValueError(f"unknown aggregate {a['function']}")
        cols.append(getattr(F, a["function"])(a["field"]).alias(a["alias"]))
    return picked.groupBy(*group).agg(*cols)


def rule_set(df, rules: list[dict]) -> DataFrame:
    """Rows made by every aggregate rule of a source, from one aggregation.

    ``rules``: dicts with name and key columns. All rules share one scan
    through grouping sets instead of one pass per rule.
    """
    names = sorted({k for r in rules for k in r["keys"]})
    sets = [[F.col(k) for k in r["keys"]] for r in rules]
    grouped = df.groupingSets(sets, *[F.col(n) for n in names]).agg(
        F.count("*").alias("n"), F.grouping_id(*[F.col(n) for n in names]).alias("gid")
    )
    label = None
    for r in rules:
        gid = sum(0 if n in r["keys"] else 1 << (len(names) - 1 - i) for i, n in enumerate(names))
        label = F.when(F.col("gid") == gid, r["name"]) if label is None else label.when(F.col("gid") == gid, r["name"])
    return grouped.groupBy(label.alias("rule_name")).agg(
        F.count("*").alias("records_created"), F.sum("n").alias("records_processed")
    )


def customer_behavior(sales, lines) -> DataFrame:
    """Per day, customer and branch, with the days since the previous visit.

    Lines are summed per sale first; the window runs over customer days, whose
    number per customer is bounded by the calendar.
    """
    per_sale = lines.groupBy("sale_id").agg(F.sum("qty").alias("items"))
    day = (
        sales.join(per_sale, "sale_id", "left")
        .groupBy("sale_date", "customer_id", "branch_id")
        .agg(
            F.count("*").alias("transactions"),
            F.sum("amount").alias("spend"),
            F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        )
    )
    w = Window.partitionBy("customer_id", "branch_id").orderBy("sale_date")
    return day.select(
        text("sale_date").alias("visit_date"),
        "customer_id",
        "branch_id",
        "transactions",
        dbl("spend").alias("total_spend"),
        "items",
        ratio("spend", "transactions").alias("avg_basket"),
        F.datediff("sale_date", F.lag("sale_date").over(w)).alias("days_since_last_visit"),
    )


def monthly_retention(sales) -> DataFrame:
    """New and returning customers per month and branch; retention rate is the
    share of returning customers."""
    months = sales.groupBy(
        "branch_id", "customer_id", F.trunc("sale_date", "month").alias("month")
    ).agg(F.count("*").alias("n"))
    first = F.min("month").over(Window.partitionBy("branch_id", "customer_id"))
    return (
        months.withColumn("is_new", F.col("month") == first)
        .groupBy(text("month").alias("month"), "branch_id")
        .agg(
            F.count_if("is_new").alias("new_customers"),
            F.count_if(~F.col("is_new")).alias("returning_customers"),
            percent(F.count_if(~F.col("is_new")), F.count("*")).alias("retention_rate"),
        )
    )


def daily_sales_full(sales, lines) -> DataFrame:
    per_sale = lines.groupBy("sale_id").agg(
        F.sum("qty").alias("items"),
        F.sum(F.col("line_total") * F.col("discount_rate")).alias("discount"),
        F.sum(F.col("line_total") * F.col("tax_rate")).alias("tax"),
    )
    return (
        sales.join(per_sale, "sale_id", "left")
        .groupBy("sale_date", "branch_id")
        .agg(
            dbl(F.sum("amount")).alias("total_sales"),
            F.count("*").alias("total_transactions"),
            F.coalesce(F.sum("items"), F.lit(0)).alias("total_items"),
            F.count_distinct("customer_id").alias("unique_customers"),
            ratio(F.sum("items"), F.count("*")).alias("items_per_transaction"),
            F.coalesce(dbl(F.sum("discount")), F.lit(0.0)).alias("total_discount"),
            F.coalesce(dbl(F.sum("tax")), F.lit(0.0)).alias("total_tax"),
        )
        .withColumn("sale_date", text("sale_date"))
    )


MOVEMENTS = ("received", "sold", "adjusted", "transferred", "damaged", "expired")


def inventory_movement(moves, opening: DataFrame) -> DataFrame:
    """Daily stock card: ``moves(product_id, day, kind, qty)`` with signed
    effect received/adjusted +, all others -. The window runs over product
    days, after the movements of a day are summed."""
    day = moves.groupBy("product_id", "day").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("qty"))), F.lit(0)).alias(k) for k in MOVEMENTS]
    )
    net = F.col("received") + F.col("adjusted") - F.col("sold") - F.col("transferred") - F.col("damaged") - F.col("expired")
    w = Window.partitionBy("product_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    card = day.withColumn("net", net).withColumn("run", F.sum("net").over(w))
    return card.join(opening, "product_id").select(
        "product_id",
        text("day").alias("movement_date"),
        (F.col("opening_stock") + F.col("run") - F.col("net")).alias("opening_stock"),
        *MOVEMENTS,
        (F.col("opening_stock") + F.col("run")).alias("closing_stock"),
        dbl((F.col("opening_stock") + F.col("run")) * F.col("unit_cost")).alias("closing_value"),
    )


def days_of_supply(stock, lines, as_of: Column, days=30, overstock_factor=3) -> DataFrame:
    sold = (
        lines.where(F.col("ship_date") > F.date_sub(as_of, days))
        .groupBy("product_id")
        .agg(F.sum("qty").alias("sold"))
    )
    minimum = F.col("reorder_level")
    return stock.join(sold, "product_id", "left").select(
        "product_id",
        "stock_quantity",
        F.coalesce("sold", F.lit(0)).alias("sold_in_period"),
        ratio(F.col("stock_quantity") * days, "sold").alias("days_of_supply"),
        F.when(F.col("stock_quantity") <= minimum, "low")
        .when(F.col("stock_quantity") > minimum * overstock_factor, "overstock")
        .otherwise("normal")
        .alias("stock_status"),
    )


def inventory_trends(lines, stock, as_of: Column, days=30) -> DataFrame:
    """Level of every product per day: stock plus what is sold later in the period."""
    day = (
        lines.where(F.col("ship_date") > F.date_sub(as_of, days))
        .groupBy("product_id", "ship_date")
        .agg(F.sum("qty").alias("sold"))
    )
    later = Window.partitionBy("product_id").orderBy(F.col("ship_date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        day.withColumn("later", F.coalesce(F.sum("sold").over(later), F.lit(0)))
        .join(stock, "product_id")
        .select(
            "product_id",
            text("ship_date").alias("day"),
            (F.col("stock_quantity") + F.col("later")).alias("stock_level"),
            "reorder_level",
        )
    )


def staff_fact(lines, shifts, scheduled_hours=8) -> DataFrame:
    per_day = lines.groupBy("staff_id", "ship_date").agg(F.sum("qty").alias("items"))
    joined = shifts.join(
        per_day,
        (shifts.staff_id == per_day.staff_id) & (shifts.shift_date == per_day.ship_date),
        "left",
    )
    hours = F.col("hours_worked")
    return joined.select(
        shifts.staff_id,
        text("shift_date").alias("work_date"),
        hours,
        F.greatest(hours - scheduled_hours, F.lit(0)).cast("long").alias("overtime_hours"),
        ratio("items", "orders_served").alias("items_per_transaction"),
        ratio("sales_generated", "orders_served").alias("avg_transaction"),
        percent(F.least(hours, F.lit(scheduled_hours)), F.lit(scheduled_hours)).alias("attendance_rate"),
    )


def product_margin(products, unit_price: Column, cost: Column) -> DataFrame:
    return products.select(
        "product_id",
        dbl(unit_price).alias("unit_price"),
        dbl(cost).alias("cost_price"),
        F.when(unit_price > 0, dbl(unit_price - cost) * 100 / dbl(unit_price)).alias("margin_percentage"),
    )


def top_products(lines, products, n=10) -> DataFrame:
    """Products by revenue. Sums come first, so the ranking window sees only
    the n rows that TakeOrdered keeps."""
    best = (
        lines.groupBy("product_id")
        .agg(F.sum("line_total").alias("revenue"), F.sum("qty").alias("units"))
        .orderBy(F.desc("revenue"), "product_id")
        .limit(n)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("revenue"), "product_id"))
    return best.join(products, "product_id").select(
        "product_id", "item_name", dbl("revenue").alias("revenue"), "units", rank.alias("sales_rank")
    )


def branch_performance(branches, sales, shifts, stock, start, end) -> DataFrame:
    """Three summaries by branch, each aggregated before the joins."""
    s = _in_range(sales.where("is_active"), "sale_date", start, end).groupBy("branch_id").agg(
        F.count("*").alias("sales_count"),
        dbl(F.sum("amount")).alias("revenue"),
        ratio(F.sum("amount"), F.count("*")).alias("avg_sale"),
    )
    p = _in_range(shifts, "shift_date", start, end).groupBy("branch_id").agg(
        F.count("*").alias("shift_count"),
        F.sum("hours_worked").alias("hours"),
        ratio(F.sum(F.col("feedback").cast("decimal(6,1)")), F.count("feedback")).alias("avg_rating"),
    )
    i = stock.where("is_active").groupBy("branch_id").agg(
        F.count("*").alias("item_count"),
        F.count_if(F.col("stock_quantity") <= F.col("reorder_level")).alias("low_stock_count"),
        dbl(F.sum(F.col("stock_quantity") * F.col("unit_cost"))).alias("stock_value"),
    )
    joined = branches.join(s, "branch_id", "left").join(p, "branch_id", "left").join(i, "branch_id", "left")
    return joined.na.fill(0, [c for c in joined.columns if c not in branches.columns])


def daily_summary(sales, day: Column) -> DataFrame:
    def n(method):
        return F.count_if(F.lower("payment_method") == method)

    return sales.where("is_active").where(F.col("sale_date") == day).agg(
        F.count("*").alias("total_sales"),
        dbl(F.sum("amount")).alias("total_revenue"),
        ratio(F.sum("amount"), F.count("*")).alias("avg_order_value"),
        n("cash").alias("cash_sales"),
        n("card").alias("card_sales"),
        n("mobile").alias("mobile_sales"),
    )


def sales_by_hour(sales) -> DataFrame:
    return sales.where("is_active").groupBy(F.hour("ts").alias("hour")).agg(
        F.count("*").alias("sales_count"), dbl(F.sum("amount")).alias("revenue")
    ).orderBy("hour")


def revenue_trends(sales, as_of: Column, days=30) -> DataFrame:
    recent = sales.where("is_active").where(F.col("sale_date") >= F.date_sub(as_of, days))
    return recent.groupBy("sale_date").agg(
        dbl(F.sum("amount")).alias("revenue"),
        F.count("*").alias("sales_count"),
        ratio(F.sum("amount"), F.count("*")).alias("avg_order_value"),
    ).orderBy("sale_date").withColumn("sale_date", text("sale_date"))


PERIODS = ("hour", "day", "week", "month", "quarter", "year")
METRICS = {
    "revenue": lambda: dbl(F.sum("amount")),
    "sales": lambda: F.count("*"),
    "customers": lambda: F.count_distinct("customer_id"),
    "average": lambda: ratio(F.sum("amount"), F.count("*")),
}


def sales_pivot(sales, group_by="day", metrics=("revenue", "sales"), dims=()) -> DataFrame:
    if group_by not in PERIODS:
        raise ValueError(f"unknown period {group_by}")
    return sales.groupBy(text(F.date_trunc(group_by, "ts")).alias("period"), *dims).agg(
        *[METRICS[m]().alias(m) for m in metrics]
    )


def low_stock(stock) -> DataFrame:
    """Items at or below their reorder level, with the number of such items per branch."""
    items = stock.where("is_active").where(F.col("stock_quantity") <= F.col("reorder_level"))
    counts = items.groupBy("branch_id").agg(F.count("*").alias("branch_low_stock"))
    return items.join(counts, "branch_id").select(
        "product_id", "branch_id", "stock_quantity", "reorder_level", "branch_low_stock"
    )


def expiring(stock, today: Column, days=30) -> DataFrame:
    return (
        stock.where("is_active")
        .where(F.col("expiry_date").between(today, F.date_add(today, days)))
        .orderBy("expiry_date", "product_id")
        .select("product_id", text("expiry_date").alias("expiry_date"), F.datediff("expiry_date", today).alias("days_left"))
    )


# Loyalty thresholds on the amount spent.
TIERS = (("gold", 1000), ("silver", 500), ("bronze", 100))


def tier(spent: str | Column) -> Column:
    c = col(spent)
    out = F.when(c >= TIERS[0][1], TIERS[0][0])
    for name, least in TIERS[1:]:
        out = out.when(c >= least, name)
    return out.otherwise("none")


def loyalty_tiers(clients) -> DataFrame:
    """Customers per tier, exclusive and cumulative (at or above the threshold)."""
    counts = clients.where("is_active").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("total_spent") >= least).alias(name) for name, least in TIERS],
    )
    rows = []
    above = F.lit(0)
    for name, _ in TIERS:
        rows.append(F.struct(F.lit(name).alias("tier"), (F.col(name) - above).alias("members"), F.col(name).alias("at_least")))
        above = F.col(name)
    rows.append(F.struct(F.lit("none").alias("tier"), (F.col("total") - above).alias("members"), F.col("total").alias("at_least")))
    return counts.select(F.inline(F.array(*rows)))


def staff_rankings(shifts, as_of: Column, days=30) -> DataFrame:
    recent = shifts.where(F.col("shift_date") >= F.date_sub(as_of, days))
    return recent.groupBy("staff_id").agg(
        F.sum("hours_worked").alias("total_hours"),
        dbl(F.sum("sales_generated")).alias("total_sales"),
        F.sum("orders_served").alias("total_orders"),
        ratio(F.sum(F.col("feedback").cast("decimal(6,1)")), F.count("feedback")).alias("avg_feedback"),
        F.count("*").alias("shift_count"),
        ratio(F.sum("sales_generated"), F.sum("hours_worked"), 0).alias("sales_per_hour"),
        ratio(F.sum("orders_served"), F.sum("hours_worked"), 0).alias("orders_per_hour"),
    ).orderBy(F.desc("sales_per_hour"), "staff_id")


def staff_score(sales_per_hour: Column, feedback: Column, orders_per_hour: Column) -> Column:
    """0 to 100 points."""
    s = F.when(sales_per_hour >= 100, 30).when(sales_per_hour >= 50, 20).when(sales_per_hour >= 25, 10).otherwise(0)
    f = F.coalesce((feedback.cast("decimal(6,2)") * 10).cast("int"), F.lit(0))
    o = F.when(orders_per_hour >= 10, 20).when(orders_per_hour >= 5, 10).otherwise(0)
    return F.least(s + f + o, F.lit(100))


def staff_rating(sales_per_hour: Column, feedback: Column, orders_per_hour: Column) -> Column:
    points = (
        F.when(sales_per_hour >= 100, 2).when(sales_per_hour >= 50, 1).otherwise(0)
        + F.when(feedback >= 4.5, 2).when(feedback >= 3.5, 1).otherwise(0)
        + F.when(orders_per_hour >= 10, 1).otherwise(0)
    )
    return F.when(points >= 4, "Excellent").when(points >= 2, "Good").otherwise("Needs Improvement")


def activity_summary(events, as_of: Column, days=30, top=10) -> DataFrame:
    """Total, by action, by resource and the top users: one scan, grouping sets."""
    recent = events.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    a, r, u = F.col("action"), F.col("resource_type"), F.col("user_id").cast("string")
    flat = recent.select(a.alias("action"), r.alias("resource"), u.alias("user"))
    sets = flat.groupingSets(
        [[F.col("action")], [F.col("resource")], [F.col("user")], []],
        F.col("action"), F.col("resource"), F.col("user"),
    ).agg(F.count("*").alias("n"), F.grouping_id(F.col("action"), F.col("resource"), F.col("user")).alias("gid"))
    labelled = sets.select(
        F.when(F.col("gid") == 3, "action").when(F.col("gid") == 5, "resource").when(F.col("gid") == 6, "user").otherwise("total").alias("section"),
        F.coalesce("action", "resource", "user", F.lit("all")).alias("item"),
        "n",
    )
    w = Window.partitionBy("section").orderBy(F.desc("n"), "item")
    best = labelled.where("section = 'user'").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top)
    return labelled.where("section <> 'user'").unionByName(best.drop("rk"))


def audit_summary(events, as_of: Column, days=30) -> DataFrame:
    recent = events.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    sets = recent.groupingSets(
        [[F.col("action")], [F.col("severity")], []], F.col("action"), F.col("severity")
    ).agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.grouping_id(F.col("action"), F.col("severity")).alias("gid"),
    )
    return sets.select(
        F.when(F.col("gid") == 1, "action").when(F.col("gid") == 2, "severity").otherwise("total").alias("section"),
        F.coalesce("action", "severity", F.lit("all")).alias("item"),
        "total",
        "successful",
        "failed",
        F.round(percent("successful", "total", 0), 2).alias("success_rate"),
    )


def dq_rule_summary(rules, runs, as_of: Column) -> DataFrame:
    """Rule counts by severity and check type in one pass, plus runs of the last day."""
    sets = rules.groupingSets(
        [[F.col("severity")], [F.col("check_type")], [F.col("enabled")], []],
        F.col("severity"), F.col("check_type"), F.col("enabled"),
    ).agg(
        F.count("*").alias("n"),
        F.grouping_id(F.col("severity"), F.col("check_type"), F.col("enabled")).alias("gid"),
    )
    gid = F.col("gid")
    by_rule = sets.select(
        F.when(gid == 3, "severity").when(gid == 5, "check_type").when(gid == 6, "enabled").otherwise("total").alias("section"),
        F.coalesce("severity", "check_type", text("enabled"), F.lit("all")).alias("item"),
        "n",
    )
    recent = runs.where(F.col("finished_at") >= as_of - F.expr("INTERVAL 24 HOURS")).agg(F.count("*").alias("n"))
    return by_rule.unionByName(recent.select(F.lit("runs_24h").alias("section"), F.lit("all").alias("item"), "n"))


def dq_run_summary(runs, as_of: Column, days=7) -> DataFrame:
    recent = runs.where(F.col("finished_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return recent.agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("status") == "SUCCESS").alias("successful_runs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_runs"),
        percent(F.count_if(F.col("status") == "SUCCESS"), F.count("*"), 0).alias("success_rate"),
        F.sum("violations_count").alias("total_violations"),
        ratio(F.sum(F.col("duration_seconds").cast("decimal(18,2)")), F.count("duration_seconds")).alias("avg_duration"),
    )


def top_violating_rules(runs, as_of: Column, days=7, top=10) -> DataFrame:
    recent = runs.where(F.col("finished_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy("rule_id").agg(F.sum("violations_count").alias("violations")).orderBy(F.desc("violations"), "rule_id").limit(top)


def dq_batch_summary(runs, batch: Column) -> DataFrame:
    failed = F.count_if(F.col("status") == "FAILED")
    violations = F.sum("violations_count")
    return runs.groupBy(batch.alias("batch")).agg(
        F.count_distinct("rule_id").alias("rules"),
        F.count_if(F.col("status") == "SUCCESS").alias("successes"),
        failed.alias("failures"),
        violations.alias("violations"),
        ((failed > 0) | (violations > 10)).alias("needs_alert"),
    )


def dq_weekly_review(runs, as_of: Column) -> DataFrame:
    recent = runs.where(F.col("finished_at") >= as_of - F.expr("INTERVAL 7 DAYS"))
    return (
        recent.groupBy("rule_id")
        .agg(F.count_if(F.col("status") == "FAILED").alias("failed_runs"), F.count("*").alias("total_runs"))
        .where("failed_runs > 0")
        .orderBy(F.desc("failed_runs"), "rule_id")
    )


SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def dq_violation_summary(violations, as_of: Column) -> DataFrame:
    day = F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS")
    return violations.groupBy("rule_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
        F.count_if(day).alias("last_24h"),
    )


def dq_health(runs, as_of: Column) -> DataFrame:
    recent = runs.where(F.col("finished_at") >= as_of - F.expr("INTERVAL 24 HOURS"))
    rate = percent(F.col("failed_runs"), F.col("total_runs"), 0)
    return recent.agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("status") == "FAILED").alias("failed_runs")
    ).select(
        "total_runs",
        "failed_runs",
        rate.alias("failure_rate"),
        F.when(F.col("total_runs") == 0, "degraded").when(rate > 20, "unhealthy").otherwise("healthy").alias("health"),
    )


def customer_rollup(clients, sales) -> DataFrame:
    sums = sales.where("is_active").groupBy("customer_id").agg(
        F.sum("amount").alias("spent"),
        F.count("*").alias("visits"),
        F.max("sale_date").alias("last"),
        F.sum(F.floor("amount").cast("long")).alias("points"),
    )
    return clients.select("customer_id").join(sums, "customer_id", "left").select(
        "customer_id",
        F.coalesce(dbl("spent"), F.lit(0.0)).alias("total_spent"),
        F.coalesce("visits", F.lit(0)).alias("visit_count"),
        text("last").alias("last_visit"),
        F.coalesce("points", F.lit(0)).alias("loyalty_points"),
    )


def staff_rollup(sales, default_hours=8) -> DataFrame:
    return sales.groupBy("staff_id", "branch_id", "sale_date").agg(
        dbl(F.sum("amount")).alias("sales_generated"),
        F.count_distinct("sale_id").alias("orders_served"),
        F.lit(default_hours).alias("hours_worked"),
    ).withColumn("sale_date", text("sale_date"))


def monthly_staff(shifts, year: int, month: int) -> DataFrame:
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    picked = shifts.where((F.col("shift_date") >= first) & (F.col("shift_date") < F.add_months(first, 1)))
    return picked.groupBy("staff_id").agg(
        ratio(F.sum("sales_generated"), F.count("*")).alias("avg_sales"),
        F.sum("hours_worked").alias("total_hours"),
        ratio(F.sum(F.col("feedback").cast("decimal(6,1)")), F.count("feedback")).alias("avg_feedback"),
    )


def change(current: Column, previous: Column) -> Column:
    """Percent change; null when there is no previous value."""
    return percent(current - previous, previous)


def _two_periods(df, day: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col(day) > F.date_sub(as_of, 2 * days)).withColumn(
        "_cur", F.col(day) > F.date_sub(as_of, days)
    )


def dashboard_kpis(sales, as_of: Column, days=30) -> DataFrame:
    """Totals of the current period and their change on the one before; one
    conditional aggregate over both periods."""
    two = _two_periods(sales, "sale_date", as_of, days)
    cur, prev = F.col("_cur"), ~F.col("_cur")
    t = two.agg(
        dbl(F.sum(F.when(cur, F.col("amount")))).alias("revenue"),
        dbl(F.sum(F.when(prev, F.col("amount")))).alias("_revenue"),
        F.count_if(cur).alias("transactions"),
        F.count_if(prev).alias("_transactions"),
        F.count_distinct(F.when(cur, F.col("customer_id"))).alias("customers"),
        F.count_distinct(F.when(prev, F.col("customer_id"))).alias("_customers"),
    )
    return t.select(
        "revenue",
        "transactions",
        "customers",
        ratio("revenue", "transactions").alias("avg_order_value"),
        change(F.col("revenue"), F.col("_revenue")).alias("revenue_change"),
        change(F.col("transactions"), F.col("_transactions")).alias("transactions_change"),
        change(F.col("customers"), F.col("_customers")).alias("customer_growth"),
    )


def branch_comparison(sales, as_of: Column, days=30) -> DataFrame:
    two = _two_periods(sales, "sale_date", as_of, days)
    return two.groupBy("branch_id").agg(
        dbl(F.sum(F.when(F.col("_cur"), F.col("amount")))).alias("revenue"),
        dbl(F.sum(F.when(~F.col("_cur"), F.col("amount")))).alias("previous_revenue"),
        F.count_if("_cur").alias("transactions"),
    ).withColumn("revenue_change", change(F.col("revenue"), F.col("previous_revenue")))


def alert_counts(events, as_of: Column, days=7) -> DataFrame:
    start = as_of - F.expr(f"INTERVAL {days} DAYS")
    before = as_of - F.expr(f"INTERVAL {2 * days} DAYS")
    return events.where(F.col("ts") > before).groupBy("severity").agg(
        F.count_if(F.col("ts") > start).alias("alerts"),
        F.count_if(F.col("ts") <= start).alias("previous_alerts"),
    ).withColumn("alerts_change", change(F.col("alerts"), F.col("previous_alerts")))


def category_share(lines, products) -> DataFrame:
    """Value per category and percent of the total; the window sees one row
    per category."""
    per_product = lines.groupBy("product_id").agg(F.sum("line_total").alias("v"))
    by_cat = per_product.join(products, "product_id").groupBy("category").agg(F.sum("v").alias("v"))
    total = F.sum("v").over(Window.partitionBy())
    return by_cat.select("category", dbl("v").alias("value"), percent("v", total).alias("share"))
