"""Lines of flagged links."""

from compare import connect, same
from fieldbook.plans import links
from fieldbook.plans.registry import SQL

SF = "/root/testdata/sf0.001"


def test_every_flagged_link_has_a_line(spark):
    lines = links.url_flagged_lines(spark, SF)
    counts = {r["status"]: r["n"] for r in links.url_flagged(spark, SF).collect()}
    every = sorted(lines.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in every] == list(range(1, len(every) + 1)) and [r["live"] for r in every] == sorted(r["live"] for r in every) and {r["live"] for r in every} == {0, 1}
    rows = [r for r in every if r["live"] == 0]  # flagged ones come first
    assert all(r["line"] is None for r in every if r["live"])
    assert len(rows) == sum(counts.values()) and sum(r["page_id"] >= 0 for r in rows) > 0
    assert {s: sum(r["line"].startswith(s + "\t") for r in rows) for s in counts} == counts
    same(lines.toPandas(), connect(SF).execute(SQL["url_flagged_lines"]).df())
