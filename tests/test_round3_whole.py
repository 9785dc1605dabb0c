"""Queries whose SQL had become smaller do their whole job again."""

from collections import Counter

from folioweave.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_components_follow_the_links_of_customers_and_suppliers(spark):
    customers = {r["c_custkey"]: r["c_nationkey"] for r in spark.read.parquet(f"{FOLDER}/customer.parquet").collect()}
    suppliers = {r["s_suppkey"] for r in spark.read.parquet(f"{FOLDER}/supplier.parquet").collect()}
    root = {c: c for c in customers}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, nation in customers.items():
        b = nation * 60 + a % 97 % 60
        if a % 97 in suppliers and b in customers:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert sorted(map(tuple, QUERIES["components"](spark, FOLDER).collect())) == sorted((c, find(c)) for c in customers)


def test_all_pairs_of_a_brand_and_size_are_adjudicated(spark):
    sizes = Counter((r["p_brand"], r["p_size"]) for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect())
    assert QUERIES["adjudicated"](spark, FOLDER).count() == sum(n * (n - 1) // 2 for n in sizes.values())
