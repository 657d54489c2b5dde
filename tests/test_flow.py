from panelcast.operators import flow_links, flow_nodes, pair_flows, pathway


def _rows(spark):
    rows = [("Bsc", "Books", "Dev"), ("Bsc", "Books", "Dev"), ("Bsc", "School", "Ops"),
            ("Msc", "School", "Dev"), ("Msc", " Books\t", "Dev"), ("Msc", "School", "School")]
    return spark.createDataFrame(rows, "ed string, learn string, dev string")


def test_pair_flows_counts_and_conservation(spark):
    df = _rows(spark)
    f = pair_flows(df, [("ed", "learn"), ("learn", "dev")])
    by_hop = {}
    for r in f.collect():
        by_hop[r.hop] = by_hop.get(r.hop, 0) + r["count"]
    assert by_hop == {0: 6, 1: 6}  # every hop carries every row


def test_nodes_per_layer_and_links_strip_then_resum(spark):
    flows = pathway(_rows(spark), ["ed", "learn", "dev"])
    nodes = flow_nodes(flows).collect()
    labels = [(r.layer, r.label) for r in sorted(nodes, key=lambda r: r.node_id)]
    # " Books\t" was stripped and merged into "Books"; "School" exists in layers 1 and 2.
    assert labels == [(0, "Bsc"), (0, "Msc"), (1, "Books"), (1, "School"), (2, "Dev"), (2, "Ops"), (2, "School")]
    assert [r.node_id for r in sorted(nodes, key=lambda r: r.node_id)] == list(range(7))
    ids = {(r.layer, r.label): r.node_id for r in nodes}
    links = {(r.source_id, r.target_id): r.value for r in flow_links(flows).collect()}
    assert links[(ids[(0, "Msc")], ids[(1, "Books")])] == 1
    assert links[(ids[(0, "Bsc")], ids[(1, "Books")])] == 2
    assert links[(ids[(1, "Books")], ids[(2, "Dev")])] == 3
    assert links[(ids[(1, "School")], ids[(2, "School")])] == 1
    assert sum(links.values()) == 12


def test_merge_labels_literal_mode(spark):
    flows = pathway(_rows(spark), ["ed", "learn", "dev"])
    nodes = flow_nodes(flows, merge_labels=True).collect()
    assert len(nodes) == 6  # "School" is one node across layers
    links = flow_links(flows, merge_labels=True).collect()
    assert sum(r.value for r in links) == 12


def test_null_labels_lose_no_flow(spark):
    from panelcast.operators import flow_links, flow_nodes, pathway

    df = spark.createDataFrame([("a", None), ("a", "b"), (None, "b")], "x string, y string")
    f = pathway(df, ["x", "y"])
    assert flow_nodes(f).count() == 4
    assert sorted(r.value for r in flow_links(f).collect()) == [1, 1, 1]
