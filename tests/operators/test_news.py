"""News items with and without namespaces, broken ones, and articles by each format."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import news
from quillstone.plans.news import classification_violations

GOOD = """<?xml version="1.0"?><n:newsItem xmlns:n="urn:a" guid="g1" version="7"><n:itemMeta><n:provider><n:name>Wire  Service</n:name></n:provider>
<n:signal qcode="sig:update"/><n:signal qcode="sig:NoArchive"/></n:itemMeta><n:contentMeta><n:headline>One &amp; two</n:headline><n:headline/><n:by>Ann</n:by></n:contentMeta>
<n:contentSet><n:inlineXML><hl1>Head</hl1><p>First <b>bold</b>
 text</p><p> </p><li>item</li><p>Second</p></n:inlineXML></n:contentSet></n:newsItem>"""


def test_items_are_read(spark):
    rows = [(1, GOOD), (2, GOOD[:-9]), (3, "<other/>"), (4, "<newsItem guid='x'/>"), (5, None), (6, "<newsItem guid='x' version='1'><contentMeta><title>T</title></contentMeta></newsItem>")]
    out = {r.id: r for r in spark.createDataFrame(rows, "id long, payload string").select("id", news.newsml("payload").alias("i")).select("id", "i.*").collect()}
    good = out[1]
    assert (good.item_id, good.version, good.provider, good.status, good.language, good.signals) == ("g1", "7", "Wire Service", "unknown", None, ["sig:update", "sig:NoArchive"])
    assert [(e.kind, e.path, e.text) for e in good.body] == [
        ("headline", "headline[1]", "One & two"), ("byline", "by[1]", "Ann"), ("heading", "hl1[1]", "Head"), ("paragraph", "p[1]", "First bold text"), ("list_item", "li[1]", "item"), ("paragraph", "p[2]", "Second"),
    ]
    assert [out[i].error for i in (2, 3, 4, 5)] == ["malformed", "not_a_news_item", "no_identity", "malformed"]
    assert [(e.kind, e.text) for e in out[6].body] == [("headline", "T")] and out[6].provider == "unknown-provider"
    nodes = news.representation(spark.createDataFrame(rows, "id long, payload string").select("id", news.newsml("payload").alias("i")).select("id", "i.*"), "id").collect()
    whole = "\n".join(e.text for e in good.body)
    own = sorted((n for n in nodes if n.id == 1), key=lambda n: n.order_index)
    assert (own[0].kind, own[0].start_char, own[0].end_char) == ("root", 0, len(whole)) and all(n.analyzable for n in own)
    assert [whole[n.start_char : n.end_char] for n in own[1:]] == [e.text for e in good.body] and {n.parent_id for n in own[1:]} == {own[0].node_id}
    assert not any(n.analyzable for n in nodes if n.id == 6) and {n.id for n in nodes} == {1, 6}


DATED = """<newsItem guid="g" version="2"><rightsInfo><usageTerms>Free  use</usageTerms><usageTerms/></rightsInfo><itemMeta><versionCreated>2026-07-14T12:00:00Z</versionCreated>
<firstCreated>soon</firstCreated><embargoed>2026-07-15T08:00:00+02:00</embargoed><signal qcode="x:NoArchive"/><role qcode="r"><name>Lead</name></role></itemMeta>
<contentMeta><subject><name>Rivers</name></subject><subject qcode="s"/><located><name>Bonn</name></located></contentMeta><contentSet><remoteContent href="a.jpg"/><remoteContent/></contentSet></newsItem>"""


def test_times_subjects_and_rights(spark):
    items = spark.createDataFrame([(1, DATED), (2, GOOD), (3, "<x")], "id long, payload string").select("id", news.newsml("payload").alias("i")).select("id", "i.*")
    out = {r.id: r for r in news.times(items).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in news.TIMES}).collect()}
    one = out[1]
    assert (one.version_created, one.first_created, one.embargo_until) == ("2026-07-14 12:00", None, "2026-07-15 06:00")
    assert (one.roles, one.subjects, one.locations, one.usage_terms, one.media, one.archive_permitted) == (["Lead"], ["Rivers"], ["Bonn"], ["Free use"], ["a.jpg"], False)
    assert (out[2].version_created, out[2].subjects, out[2].archive_permitted) == (None, [], False)
    assert out[3].error == "malformed" and out[3].archive_permitted is None and out[3].subjects is None


def test_articles_by_precedence(spark):
    data = '<script type="application/ld+json">{"headline": "H", "articleBody": "One\\n\\nTwo  x"}</script>'
    pages = [
        (1, f"<html>{data}<article><p>no</p></article></html>"),
        (2, "<h1>Top <i>x</i></h1><p>outside</p><article class='a'><h2>A</h2><p>b <b>c</b></p><p> </p><li>d</li></article>"),
        (3, "<p>only</p><blockquote>q</blockquote>"),
        (4, ""),
        (5, None),
        (6, '<script type="application/ld+json">not json</script><p>x</p>'),
    ]
    out = {r.id: r for r in spark.createDataFrame(pages, "id long, html string").select("id", news.article(F.col("html")).alias("a")).select("id", "a.*").collect()}
    assert (out[1].headline, out[1].precedence, out[1].elements) == ("H", "json_ld", ["One", "Two x"])
    assert (out[2].headline, out[2].precedence, out[2].elements) == ("Top x", "semantic_html", ["A", "b c", "d"])
    assert (out[3].headline, out[3].precedence, out[3].elements) == (None, "page", ["only", "q"])
    assert (out[4].precedence, out[4].elements) == ("page", []) and (out[6].precedence, out[6].elements) == ("page", ["x"])
    assert not out[5].elements


def test_classifications(spark):
    rows = [(1, "original", None, False), (2, "original", 1, False), (3, "update", None, True), (4, "update", 1, None), (5, "unknown", None, False)]
    out = classification_violations(spark.createDataFrame(rows, "id long, kind string, previous long, repeated boolean")).collect()
    assert sorted((r.id, r.rule) for r in out) == [(2, "original_with_predecessor"), (3, "no_predecessor"), (3, "repeated_purpose"), (5, "unknown_kind")]
