"""Deliveries from a folder: sidecars and payloads, as a batch and as a stream."""

from __future__ import annotations

import json

import pytest

from quillstone.sources import deliveries


@pytest.fixture
def folder(tmp_path):
    good = {"status": 200, "transport": "https", "retrieved_at": "2024-05-01T00:00:00Z", "archive_permitted": True, "meta": {"a": [1]}}
    sides = {
        "good": good, "denied": good | {"status": 403}, "slow": good | {"status": 429}, "down": good | {"status": 503}, "lone": good, "secret": good | {"meta": {"h": [{"Set-Cookie": "x"}]}},
        "kept": good | {"archive_permitted": False}, "unsaid": {"status": 200, "transport": "ftp"}, "nocode": {k: v for k, v in good.items() if k != "status"},
    }
    for name, side in sides.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(side))
        if name != "lone":
            (tmp_path / f"{name}.xml").write_bytes(b"<x/>")
    (tmp_path / "broken.json").write_text('{"status": 200')
    (tmp_path / "broken.xml").write_text("<x/>")
    (tmp_path / "orphan.html").write_text("<p>")
    (tmp_path / "ignored.bin").write_text("?")
    return str(tmp_path)


STATES = {"good": "continue", "denied": "blocked_entitlement", "slow": "blocked_rate_limit", "down": "failed", "secret": "forbidden_key", "kept": "archive_not_permitted", "unsaid": "archive_not_permitted", "nocode": "continue", "broken": "malformed_sidecar"}


def test_batch(spark, folder):
    rows = {r["name"].split(".")[0]: r for r in deliveries.deliveries(spark, folder).collect()}
    assert {n: r.state for n, r in rows.items()} == STATES | {"lone": "missing_payload", "orphan": "missing_sidecar"}
    assert rows["good"].status == 200 and rows["good"].length == 4 and rows["good"].retrieved_at is not None and rows["orphan"].status is None


def test_stream(spark, folder, tmp_path_factory):
    seen = tmp_path_factory.mktemp("seen")
    query = deliveries.sidecar_stream(spark, folder).writeStream.format("parquet").option("path", str(seen / "out")).option("checkpointLocation", str(seen / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.name: r.state for r in spark.read.parquet(str(seen / "out")).collect()} == STATES | {"lone": "continue"}
