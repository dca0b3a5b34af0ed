"""Who was on an address when, against a look at all objects for every moment."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowtide.operators import enrich

OBJECT = "kind string, namespace string, name string, host_network boolean, ips array<binary>, valid_from long, valid_to long"


def packed(text):
    return bytearray(ipaddress.ip_address(text).packed)


def test_a_former_nodes_address(spark):
    """An ordinary pod is found on an address that was a node's before."""
    ip = packed("10.0.0.1")
    objects = spark.createDataFrame([("Node", "", "node", False, [ip], 0, 100), ("Pod", "n", "pod", False, [ip], 50, 300)], OBJECT)
    flows = spark.createDataFrame([(ip, packed("9.9.9.9"), t) for t in (10, 60, 99, 100, 250, 300)], "src_ip binary, dst_ip binary, at long")
    got = {r.at: (r.src_name, r.decorator_status) for r in enrich.decorate(flows, enrich.ip_index(objects), "at").collect()}
    assert got == {10: ("node", "partial"), 60: ("node", "partial"), 99: ("node", "partial"), 100: ("pod", "partial"), 250: ("pod", "partial"), 300: (None, "undecorated")}


def world(seed, n=300):
    r, out = random.Random(seed), []
    for i in range(n):
        start = r.randrange(200)
        kind = r.choice(["Pod", "Pod", "Pod", "Service", "Node", "EndpointSlice"])
        out.append((kind, "n" if kind != "Node" else "", f"{kind}{i}", r.random() < 0.3, [packed(f"10.0.0.{r.randrange(6)}")], start, r.choice([start, start + r.randrange(1, 60), 10**6])))
    return out


def owner(objects, ip, at):
    there = [o for o in objects if o[4][0] == ip and o[5] <= at < o[6]]
    if any(o[0] == "Node" for o in there):
        there = [o for o in there if o[0] == "Node" or o[0] == "Pod" and o[3]]
    return min(there, key=lambda o: (enrich.PREFERENCE[o[0]], o[1], o[2]), default=(None,) * 3)[2]


@pytest.mark.parametrize("page", [2, 1024])
def test_moments(spark, page):
    objects = world(3)
    index = enrich.ip_index(spark.createDataFrame(objects, OBJECT))
    moments = [(packed(f"10.0.0.{k}"), t) for k in range(8) for t in range(0, 320, 3)]
    flows = spark.createDataFrame(moments, "src_ip binary, at long")
    paged = enrich.pages(enrich.timeline(index), page)
    for known in (paged, enrich.histories(enrich.timeline(index))):
        got = {(bytes(r.src_ip), r.at): r.src_name for r in enrich.attribute(flows, known, "src", "at", page).collect()}
        assert got == {(bytes(ip), t): owner(objects, ip, t) for ip, t in moments}


def test_many_owners_of_one_address(spark):
    """100,000 past owners: pages of bounded size, in each of which a flow takes a few steps."""
    ip = packed("10.0.0.1")
    days = spark.range(100_000).select(F.lit("Pod").alias("kind"), F.lit("n").alias("namespace"), F.concat(F.lit("p"), "id").alias("name"), F.lit(False).alias("host_network"), F.array(F.lit(ip)).alias("ips"), (F.col("id") * 10).alias("valid_from"), (F.col("id") * 10 + 9).alias("valid_to"))
    roots, others = enrich.pages(enrich.timeline(enrich.ip_index(days)))
    sizes = others.select(F.size("items").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    assert sizes.most == enrich.PAGE and sizes["all"] == 100_000 - enrich.PAGE
    flows = spark.createDataFrame([(ip, t) for t in (-1, 0, 8, 9, 10_239, 10_240, 555_555, 999_998, 999_999)], "src_ip binary, at long")
    for known in ((roots, others), enrich.histories(enrich.timeline(enrich.ip_index(days)))):
        got = {r.at: r.src_name for r in enrich.attribute(flows, known, "src", "at").collect()}
        assert got == {-1: None, 0: "p0", 8: "p0", 9: None, 10_239: None, 10_240: "p1024", 555_555: "p55555", 999_998: "p99999", 999_999: None}


def test_text_addresses_are_refused(spark):
    objects = spark.createDataFrame([("Pod", "p", ["10.0.0.1"])], "kind string, name string, ips array<string>")
    with pytest.raises(TypeError):
        enrich.ip_index(objects)


def test_many_pods_of_one_node(spark):
    """What a flow gets of an address doesn't grow with the pods on it, and the first of each port is among it."""
    ip = packed("10.0.0.1")
    ports = F.array(F.struct(F.lit("tcp").alias("protocol"), (F.col("id") % 3).cast("int").alias("port")), F.struct(F.lit(None).cast("string").alias("protocol"), F.lit(9).alias("port")))
    pods = spark.range(100, 1000).select(F.lit("Pod").alias("kind"), F.lit("n").alias("namespace"), F.concat(F.lit("p"), "id").alias("name"), F.array(F.lit(ip)).alias("ips"), ports.alias("ports"))
    intervals = enrich.timeline(enrich.ip_index(pods)).collect()
    assert [[b.name for b in r.best] for r in intervals] == [["p100", "p101", "p102"]]
    flows = spark.createDataFrame([(ip, packed("9.9.9.9"), 6, p, 1, 5) for p in (0, 1, 2, 9, 7)], "src_ip binary, dst_ip binary, proto int, src_port int, dst_port int, at long")
    got = {r.src_port: r.src_name for r in enrich.decorate(flows, enrich.ip_index(pods), "at").collect()}
    assert got == {0: "p102", 1: "p100", 2: "p101", 9: "p100", 7: "p100"}


def test_addresses_of_one_object(spark):
    """Objects alone on their addresses and others, in batches that end amid an address; equal to a sweep over all."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        objects = [("Pod", "n", f"p{i}", False, [packed(f"10.0.1.{i % 60 if i % 4 else i % 9}")], i % 5, 90 - 90 * (i % 7 == 0)) for i in range(100)]
        moments = [(packed(f"10.0.1.{k}"), t) for k in range(60) for t in (0, 2, 4, 50, 90)]
        flows = spark.createDataFrame(moments, "src_ip binary, at long")
        known = enrich.histories(enrich.timeline(enrich.ip_index(spark.createDataFrame(objects, OBJECT))))
        got = {(bytes(r.src_ip), r.at): r.src_name for r in enrich.attribute(flows, known, "src", "at").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(bytes(ip), t): owner(objects, ip, t) for ip, t in moments}
