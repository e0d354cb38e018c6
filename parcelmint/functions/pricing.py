"""Landed cost, resale value and profit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmint.functions.compat import js_round
from parcelmint.functions.config import BOUNDS, Config

#: Euros for each gigabyte by which storage differs.
PER_GB = 0.25


def landed_cost(price: Column, config: Config, rate: Column | None = None) -> Column:
    """Everything that an import costs, as a struct; sums are taken term by term in the order of the fields."""
    rate = F.lit(config.rate) if rate is None else rate
    acquisition = price * rate * F.lit(1 + config.exchange_fee)
    agent, insurance = acquisition * F.lit(config.agent_fee), acquisition * F.lit(config.insurance)
    base = acquisition + agent + F.lit(config.inspection) + F.lit(config.source_shipping) + insurance + F.lit(config.freight)
    duty = base * F.lit(config.duty)
    vat = (base + F.lit(config.customs) + duty) * F.lit(config.vat)
    parts = {
        "acquisition": acquisition,
        "agent": agent,
        "inspection": F.lit(config.inspection),
        "source_shipping": F.lit(config.source_shipping),
        "insurance": insurance,
        "freight": F.lit(config.freight),
        "customs": F.lit(config.customs),
        "duty": duty,
        "vat": vat,
        "home_shipping": F.lit(config.home_shipping),
        "total": base + F.lit(config.customs) + duty + vat + F.lit(config.home_shipping),
    }
    return F.struct(*[v.cast("double").alias(k) for k, v in parts.items()])


def bounded(name: str, value: Column) -> Column:
    """An override within its bounds."""
    low, high = BOUNDS[name]
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value.cast("double")))


def storage_adjusted(price: Column, have: Column, want: Column) -> Column:
    """A price for other storage, at least half of it."""
    return F.when(have.isNotNull() & want.isNotNull() & (have != want), F.greatest(price * 0.5, price + (want - have) * PER_GB)).otherwise(price)


def reference_adjusted(price: Column, have: Column, want: Column) -> Column:
    return js_round(F.greatest(price * 0.5, price + (want - have) * PER_GB)).cast("double")


def platform_fee(platform: Column, config: Config) -> Column:
    return F.when(platform == "olx", config.fee_olx).when(platform == "vinted", config.fee_vinted).when(platform == "kuantokusta", config.fee_kuantokusta).when(platform == "amazon", config.fee_amazon).otherwise(0.0)


def blended_fee(platform: Column, config: Config) -> Column:
    """The mean of a group's platform fees, from the share that each platform has of it.

    The last digits of a sum over rows depend on the order in which rows come; shares do not, so groups of the same
    offers have the same fee, and profits that are equal tie.
    """
    parts = [F.count_if(platform == name) / F.count(F.lit(1)) * platform_fee(F.lit(name), config) for name in ("olx", "vinted", "kuantokusta", "amazon")]
    return sum(parts[1:], parts[0])


def tier_price(condition: Column, prices: dict[str, Column]) -> Column:
    """The reference price for a condition; prices: new, excellent, very_good, good, fair."""
    fair = F.coalesce(prices["fair"], js_round(prices["good"] * 0.75).cast("double"))
    return F.when(condition.isin("new", "open_box"), prices["new"]).when(condition == "excellent", prices["excellent"]).when(condition == "good", prices["good"]).when(condition == "fair", fair).otherwise(prices["very_good"])


def profit(resale: Column, fee_rate: Column, landed_total: Column, config: Config) -> Column:
    """resale, fee, net, profit, margin (percent of the landed cost), the two gates and whether a listing is hidden by them."""
    fee = resale * fee_rate
    net = (resale - fee) - landed_total
    margin = F.when(landed_total > 0, net / landed_total * 100).otherwise(0.0)
    enough_margin, enough_profit = margin >= config.min_margin * 100, net >= config.min_profit
    return F.struct(resale.alias("resale"), fee.alias("fee"), (resale - fee).alias("net_resale"), net.alias("profit"), margin.alias("margin"), enough_margin.alias("enough_margin"), enough_profit.alias("enough_profit"), (~enough_margin | ~enough_profit).alias("hidden"))


def exchange_rate(cached: Column, valid: Column, fetched: Column, own: Column, default: float) -> Column:
    """(rate, source): a cached rate while it is valid, else a fetched one, else the user's, else the default; rates that are not above 0 do not count."""
    some = {"cache": F.when(valid & (cached > 0), cached), "api": F.when(fetched > 0, fetched), "user": F.when(own > 0, own), "default": F.lit(default)}
    first = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.cast("double").alias("rate"), F.lit(k).alias("source"))) for k, v in some.items()])
    return first


def scan_seconds(pages: Column, enrich: Column, pasted: Column | None = None, sources: Column | None = None) -> Column:
    """How long a scan takes, as it is told before: by its pages and whether listings are enriched; a pasted page by the other sources that are asked."""
    live = F.greatest(F.lit(12), js_round(pages * 4.5 + F.when(enrich, 6).otherwise(2) + 6))
    if pasted is None:
        return live.cast("int")
    return F.when(pasted, F.greatest(F.lit(6), sources * 2 + 4)).otherwise(live).cast("int")


def pages_asked(own: Column, default: int = 3) -> Column:
    """The pages of a scan: those asked for if there are any, else the default."""
    return F.when(own > 0, own).otherwise(default).cast("int")
