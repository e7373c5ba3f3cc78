"""A method's context tells assertions by their whole expressions."""

import re

from tessera.plans import trees


def test_expressions_are_whole(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus").collect()
    whole = {f"{r['o_orderstatus']}{r['o_orderkey']}" * (r["o_orderkey"] % 400) for r in orders}
    told = [e for r in trees.method_contexts(spark, sf_dir).collect() for e in re.findall("eq: ([^;#&]*)", r["tests"])]
    assert told and set(told) <= whole
    assert max(map(len, told)) > 1000
