"""Matching at scale: slices of large scans, listings without a product."""

from pyspark.sql import functions as F

from parcelmint.functions.config import Config
from parcelmint.operators import evaluate

WANTED = ["iPhone 15 Pro 256G", "iPhone 15 128G", "iPhone 15 Pro Max 512G", "iPhone 15 Pro 128G"]


def made(spark, titles):
    """One large scan with `titles` different titles of one tier, small ones beside it, and listings that are no known product."""
    listings = [(i, i % 3, WANTED[i % 4] if i % 5 else "木头椅子", "", 1000.0 + i) for i in range(30)]
    large = [(i, 0, f"iPhone 15 Pro {[128, 256, 512][i % 3]}GB nr {i}", "olx", 300.0 + i) for i in range(titles)]
    few = [(titles + i, 1 + i % 2, ["iPhone 15 128GB", "iPhone 15 Pro Max 512GB", "iPhone 15 Pro 256GB", "sofa"][i % 4], "vinted", 400.0 + i) for i in range(24)]
    rows = spark.createDataFrame(listings, "id long, task long, title string, description string, price double")
    return evaluate.with_product(rows), spark.createDataFrame(large + few, "offer long, task long, title string, platform string, euros double")


def test_slices_lose_and_repeat_nothing(spark):
    rows, offers = made(spark, 300)
    wants, facts = evaluate.with_want(rows), evaluate.title_facts(offers)
    whole = sorted(map(tuple, evaluate.scored_titles(wants, facts, slice_titles=10_000).collect()), key=str)
    cut = sorted(map(tuple, evaluate.scored_titles(wants, facts, slice_titles=7).collect()), key=str)
    assert cut == whole and len({x[:2] + x[3:4] for x in cut}) == len(cut)
    products = {x[1] for x in whole if x[0] == 0}
    assert len(products) == 2 and len([x for x in whole if x[0] == 0]) >= 300


def test_a_large_scan_is_cut_and_small_ones_are_not(spark):
    rows, offers = made(spark, 300)
    wants = evaluate.with_want(rows).where("want is not null").select("task", "want").distinct().withColumn("tier", F.lit("pro"))
    wanted, facts = evaluate._sliced(wants, evaluate.title_facts(offers), 10)
    sizes = {(r.task, r.slice): r.n for r in facts.where("tier = 'pro'").groupBy("task", "slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len([k for k in sizes if k[0] == 0]) == 30 and max(sizes.values()) < 40
    assert {k[1] for k in sizes if k[0] != 0} == {0}
    each = wanted.groupBy("task", "want").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.task == 0, r.n) for r in each} == {(True, 30), (False, 1)}


def test_listings_without_a_product_are_paired_on_demand_only(spark):
    rows, offers = made(spark, 20)
    known = evaluate.matches(rows, offers).collect()
    both = evaluate.matches(rows, offers, unknown=True).collect()
    assert known and all(r.id % 5 for r in known)
    assert sorted(map(str, known)) == sorted(str(r) for r in both if r.id % 5)
    in_scan = {r.task: r.n for r in offers.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
    others = [r for r in both if r.id % 5 == 0]
    assert len(others) == sum(in_scan[i % 3] for i in range(0, 30, 5)) and all(r.score is None for r in others)
    of_pairs = {r.id: (r.offers, r.resale) for r in evaluate.resale_values(evaluate.matches(rows, offers, unknown=True), Config()).collect()}
    valued = {r.id: (r.offers, r.resale) for r in evaluate.with_value(rows, offers, Config()).collect() if r.offers is not None}
    assert of_pairs == valued
    # equal when no offer has the scan of a listing
    assert evaluate.matches(rows, offers.where("task > 2"), unknown=True).count() == 0
