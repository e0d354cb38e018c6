"""Exports of evaluated listings and reference prices, and imports of the latter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmint.functions import labels, shown
from parcelmint.functions.compat import js_round
from parcelmint.operators import references


def _columns() -> dict[str, Column]:
    """The columns of an export, in their order."""
    yes = lambda c: F.when(F.col(c), "YES").otherwise("NO")
    money = lambda c: js_round(F.col(c) * 100) / 100
    of = lambda c: F.col(f"product.{c}")
    return {
        "Product": F.coalesce("product.standard_key", "title"),
        "Condition": F.coalesce(labels.label(of("condition"), labels.CONDITIONS), F.lit("Used")),
        "Price_CNY": F.col("price"),
        "Acquisition_EUR": money("landed.acquisition"),
        "Agent_Fee_EUR": money("landed.agent"),
        "Inspection_EUR": money("landed.inspection"),
        "CN_Domestic_EUR": money("landed.source_shipping"),
        "Insurance_EUR": money("landed.insurance"),
        "Intl_Shipping_EUR": money("landed.freight"),
        "Customs_Clearance_EUR": money("landed.customs"),
        "Import_Duty_EUR": money("landed.duty"),
        "Import_VAT_EUR": money("landed.vat"),
        "PT_Domestic_EUR": money("landed.home_shipping"),
        "Total_Landed_EUR": money("landed.total"),
        "EU_Baseline_EUR": money("profit.resale"),
        "Resale_Fee_EUR": money("profit.fee"),
        "Net_Resale_EUR": money("profit.net_resale"),
        "Net_Profit_EUR": money("profit.profit"),
        "Margin_Pct": js_round(F.col("profit.margin") * 10) / 10,
        "Risk_Score": F.col("risk.score"),
        "Dropped": yes("risk.dropped"),
        "Hidden": yes("hidden"),
        "Hidden_Reason": F.coalesce("hidden_reason", F.lit("")),
        "Seller_Location": F.col("location"),
        "Seller_Verified": yes("verified"),
        "Seller_Transactions": F.col("transactions"),
        "Seller_Rating": F.col("rating"),
        "Wants_Count": F.col("wants"),
        "Image_Count": F.col("images"),
        "Condition_Flags": F.array_join("condition_flags", " | "),
        "Region_Version": of("region_version"),
        "Lock_Status": of("lock_status"),
        "Storage_GB": of("storage_gb"),
        "Color": of("color"),
        "Chip": of("chip"),
        "RAM_GB": of("ram_gb"),
        "Display_Inch": of("display_inch"),
        "Battery_Health": of("battery_health"),
        "Release_Year": of("release_year"),
        "Form_Factor": of("form_factor"),
        "Drive_Config": of("drive_config"),
        "Goofish_Href": F.col("href"),
        "EU_Comps_Count": F.coalesce("offers", F.lit(0)),
        "Goofish_Title": F.col("title"),
        "Description": F.col("description"),
    }


#: What an evaluated listing may lack, with its kind.
_OPTIONAL = {"location": "string", "wants": "int", "condition_flags": "array<string>", "href": "string", "offers": "bigint"}


def flat(evaluated: DataFrame) -> DataFrame:
    """The columns of an export for each evaluated listing: money with two decimals, the margin with one, flags as YES and NO."""
    for c, kind in _OPTIONAL.items():
        if c not in evaluated.columns:
            evaluated = evaluated.withColumn(c, F.lit(None).cast(kind))
    return evaluated.select("id", *[v.alias(k) for k, v in _columns().items()])


def write_csv(evaluated: DataFrame, path: str) -> None:
    """Files that begin with a byte order mark, as spreadsheets want them: it stands before the first name of the header."""
    rows = flat(evaluated).drop("id").withColumnRenamed("Product", "\ufeffProduct")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def meta(evaluated: DataFrame, query: str) -> DataFrame:
    """One row on an export: query, total_listings, viable_listings."""
    return evaluated.agg(F.count(F.lit(1)).alias("total_listings"), F.count_if(~F.col("hidden")).alias("viable_listings")).select(F.lit(query).alias("query"), "total_listings", "viable_listings")


def write_json(evaluated: DataFrame, path: str) -> None:
    """Nested listings, with nulls as they are."""
    evaluated.write.option("ignoreNullFields", False).json(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(standard_key, category, new, excellent, very_good, good, fair) of a CSV: names in any case, blank keys left out, unknown categories as iphone, what is no number as 0."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return references.parsed(raw.toDF(*[c.strip().lower() for c in raw.columns]))


def _lines(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _line(*parts: Column | str) -> Column:
    """A line of a sheet; what is null is left out."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _named() -> tuple[Column, Column]:
    return F.coalesce("product.standard_key", "title"), F.coalesce(labels.label(F.col("product.condition"), labels.CONDITIONS), F.lit("Used"))


def blueprint(source: str = "Source", by: str = "parcelmint") -> Column:
    """An evaluated listing as a sheet of plain text: source, landed cost, resale, profit. source, by: what the source and the tool are called."""
    exact, whole = (lambda c: shown.euros(F.coalesce(F.col(c), F.lit(0.0)), 2)), (lambda c: shown.euros(F.coalesce(c, F.lit(0.0))))
    product, condition = _named()
    fees = F.col("landed.agent") + F.col("landed.inspection") + F.col("landed.source_shipping") + F.col("landed.insurance")
    return _lines(
        "=== LISTING BLUEPRINT ===", _line("Product: ", product), _line("Condition: ", condition), "",
        f"-- {source} --", _line("Title: ", F.col("title")), _line("Price: ", shown.yuan(F.col("price")), " (¥", F.col("price"), ")"), _line("Seller: ", F.when(F.col("verified"), "Verified").otherwise("Unverified"), " · ", F.col("transactions"), " txns"), "",
        "-- Landed Cost --", _line("Acquisition: ", exact("landed.acquisition")), _line("Agent + inspection + shipping + insurance: ", shown.euros(fees, 2)), _line("Intl shipping + customs: ", whole(F.col("landed.freight") + F.col("landed.customs"))),
        _line("Import duty: ", exact("landed.duty")), _line("Import VAT: ", exact("landed.vat")), _line("Domestic shipping: ", whole(F.col("landed.home_shipping"))), _line("TOTAL LANDED: ", exact("landed.total")), "",
        "-- EU Resale --", _line("Expected resale: ", whole(F.col("profit.resale"))), _line("Platform fee: ", exact("profit.fee")), _line("Net resale: ", exact("profit.net_resale")), "",
        "-- Profitability --", _line("NET PROFIT: ", exact("profit.profit")), _line("MARGIN: ", F.format_string("%.1f", F.coalesce("profit.margin", F.lit(0.0))), "%"), _line("RISK SCORE: ", F.coalesce("risk.score", F.lit(0)), "/100"), "", f"Generated by {by}",
    )


def markdown(by: str = "parcelmint") -> Column:
    """An evaluated listing as Markdown: a heading and a table of what it costs and brings; bars in its title are escaped."""
    exact, whole = (lambda c: shown.euros(F.col(c), 2)), (lambda c: shown.euros(F.col(c)))
    row = lambda name, *value: _line(f"| **{name}** | ", *value, " |")
    product, condition = _named()
    costs = {"Acquisition (EUR)": exact("landed.acquisition"), "Agent service fee": exact("landed.agent"), "Inspection fee": whole("landed.inspection"), "Source domestic shipping": whole("landed.source_shipping"), "Insurance": exact("landed.insurance"), "International shipping": whole("landed.freight"), "Customs clearance": whole("landed.customs"), "Import duty": exact("landed.duty"), "Import VAT": exact("landed.vat"), "Domestic shipping": whole("landed.home_shipping")}
    return _lines(
        _line("## ", product), "", _line("> ", F.col("id"), " · ", condition), "", "| Field | Value |", "|-------|-------|",
        row("Source title", F.regexp_replace("title", r"\|", r"\\\\|")), row("Source price", shown.yuan(F.col("price")), " (¥", F.col("price"), ")"), *[row(k, v) for k, v in costs.items()], row("Total landed cost", "**", exact("landed.total"), "**"),
        row("Expected resale (EU)", whole("profit.resale")), row("Resale platform fee", exact("profit.fee")), row("Net resale", exact("profit.net_resale")), row("Net profit", "**", exact("profit.profit"), "**"), row("Margin", "**", F.format_string("%.1f", F.col("profit.margin")), "%**"),
        row("Risk score", F.col("risk.score"), "/100", F.when(F.col("risk.dropped"), " · ⚠️ auto-dropped").otherwise("")), row("Seller", F.when(F.col("verified"), "✅ verified").otherwise("⚠️ unverified"), " · ", F.col("transactions"), " txns"), "", f"_Generated by {by}_",
    )
