"""Texts of nodes are read once for the manifests of all units."""

from __future__ import annotations

from quillstone.operators import contexts


def test_texts_meet_their_unit_once_and_manifests_stay_the_same(spark, capsys):
    nodes = spark.createDataFrame([("d", n, n, "paragraph", None, f"word {n}" if n < 3 else "far too many words here now") for n in range(4)], "doc string, node long, order_index long, node_type string, parent long, text string")
    units = spark.createDataFrame([("u", "d", [0, 1], []), ("v", "d", [2], []), ("w", "d", [2, 3], []), ("x", "d", [3], []), ("y", "d", [9], [])], "unit string, doc string, focus array<long>, dependencies array<long>")
    known = contexts.named(units, nodes).localCheckpoint()
    got = contexts.manifests(units, nodes, "Say it.", 8, known)
    got.explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD[doc#") == 2  # texts, and the count of furniture
    assert sorted((r.unit, r.status, r.input_tokens, r.segments, r.n_selected) for r in got.collect()) == [
        ("u", "ready", 8, "0:9:29,1:31:51", 2), ("v", "ready", 5, "2:9:29", 1), ("w", "split", 0, "", 0), ("x", "blocked", 0, "", 0), ("y", "ready", 2, "", 0),
    ]
