"""Values worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import encode, links, privacy, text
from fieldbook.operators import changes, limiter, outreach, search


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, f, cases):
    assert apply(spark, f, *cases) == list(cases.values())


def test_phones(spark):
    check(spark, text.phones, {
        "1-888-HELPNOW / 1-888-435-7669": ["8884357669"], "fax 415-555-0101; main 888-CALLNOW / 888-225-5669": ["4155550101", "8882255669"],
        "Office 415-555-0102; Home 415-555-0103": ["4155550102", "4155550103"], "(415) 555-0100 or 555-0199": ["4155550100", "5550199"],
        "+1 (212) 555-0123": ["2125550123"], "415-555-0100 ext 7": [], "988": [], "": [], None: None})
    check(spark, text.phone_display, {"6025551234": "(602) 555-1234", "5559876": "555-9876", "12": "12", "": None, None: None})


def test_email(spark):
    check(spark, text.email, {" Foo@Bar.ORG ": "foo@bar.org", "A@B.com@c": "a@b.com", "a b@c.d": None, "x@y": None, "": None, None: None})


def test_clean_artifacts(spark):
    check(spark, text.clean_artifacts, {
        "Call【31†L20-L24】 now [L402]": "Call now", "====\n## Help\n- one\n----": "Help one", "** 1-800-MEDICARE": "1-800-MEDICARE", "Dial **988** then": "Dial 988 then",
        "a***b": "ab", "   ====\nx": "==== x", " \n ": None, None: None})


def test_redaction(spark):
    check(spark, privacy.redact, {
        "SSN 123-45-6789": "SSN [SSN REDACTED]", "DOB: 01/02/1990": "DOB: [DOB REDACTED]", "born 1990-01-02": "born: [DOB REDACTED]",
        "card 4785380592391139": "card [REDACTED]", "123456789012": "123456789012", None: ""})
    rows = [(0, "SSN 123-45-6789, 123-45-6789 on UPWORK", 1), (1, None, 2), (2, "born 1990-01-02, 4785380592391139", 3), (3, "12 flippa", 4)]
    got = privacy.redacted(spark.createDataFrame(rows, "i int, t string, other int"), "t", "notes").orderBy("i").collect()
    assert [(r["t"], r["notes"], r["other"]) for r in got] == [
        ("SSN [SSN REDACTED], [SSN REDACTED] on UPWORK", ["Redacted 2 SSN pattern(s)", 'SPAM DETECTED: pattern "\\bupwork\\b" found in text'], 1), ("", [], 2),
        ("born: [DOB REDACTED], [REDACTED]", ["Redacted 1 DOB pattern(s)", "Redacted 1 long-digit (possible account/card) pattern(s)"], 3), ("12 flippa", ['SPAM DETECTED: pattern "\\bflippa\\b" found in text'], 4)]


def test_links(spark):
    check(spark, links.normalize, {
        "Example.COM": "https://example.com", "http://Example.com:80/": "http://example.com", "https://x.org/a/": "https://x.org/a/",
        "https://x.org/?q=1": "https://x.org/?q=1", "mailto:a@b.c": None, " ": None, None: None})
    check(spark, links.safety, {
        **dict.fromkeys(["http://127.8.9.1/a", "http://10.20.30.40:8080/", "http://172.31.255.1", "http://192.168.77.7/x", "http://169.254.3.4/", "http://100.64.1.1",
                         "http://[::1]", "http://[fd77:1::9]", "http://[::ffff:10.0.0.1]", "http://[0:0:0:0:0:0:0:1]/"], "private-ip"),
        **dict.fromkeys(["http://localhost", "http://metadata.google.internal"], "blocked-host"), "http://ann:1234@site.example/x": "credentials-in-url",
        "gopher://site.example": "scheme-not-allowed", "https://site.example/a/b?c=d": "ok", None: "invalid-url", **dict.fromkeys(["http://a b.org/", "http://x.org:99999", "http://[1::2::3]"], "invalid-url")})
    found = apply(spark, links.off_topic, "https://www.upwork.com/x", "https://reddit.com/", "https://facebook.com/org", "https://m.facebook.com/login", None)
    assert [x and x.split(" — ")[0] for x in found] == ["Freelance/gig marketplace", "Reddit homepage", None, None, None]


def test_encodings(spark):
    check(spark, encode.html, {"<b id=\"k\">R&B isn't": "&lt;b id=&quot;k&quot;&gt;R&amp;B isn&#39;t", None: ""})
    check(spark, encode.html_attribute, {"<b id=\"k\">R&B isn't": "&lt;b id=&quot;k&quot;&gt;R&amp;B isn't", None: ""})
    check(spark, encode.csv_cell, {"=A1*7": "'=A1*7", " \t@now": "' \t@now", "-12": "'-12", "as it is": "as it is", "x,y": '"x,y"', '+CALL("u")': '"\'+CALL(""u"")"', None: ""})
    check(spark, encode.plain_cell, {"=A1*7": "=A1*7", "x,y": '"x,y"', 'say "u"': '"say ""u"""', "two\nlines": '"two\nlines"', None: ""})


ENTRY = dict(id=1, name="Legal Aid Network", acronym="LAN", tags="legal,housing", description="Paralegal help", category="", subcategory=None, priority=0)


@pytest.mark.parametrize("token,priority,score,matched", [
    ("legal", 0, 41.0, ["name", "tags", "description"]), ("lan", 0, 96.0, ["acronym"]), ("legl", 0, 12.6, ["name", "tags"]), ("housng", 0, 5.6, ["tags"]),
    ("legal", 1, 47.15, ["name", "tags", "description"])])
def test_search_scores(spark, token, priority, score, matched):
    rows = spark.createDataFrame([tuple({**ENTRY, "priority": priority}.values())], "id int, name string, acronym string, tags string, description string, category string, subcategory string, priority int")
    row = search.score(rows, token).first()
    assert (row["score"], row["matched"]) == (score, matched)


def test_streak(spark):
    cases = {(0, 1, 1, 0, 2, 3, 1, 0): 3, (1,) * 8: 8, (0,) * 8: 0, (1, 1, 0, 0, 0, 0, 0, 0): 2, (0, 0, 0, 0, 0, 1, 0, 1): 1}
    rows = spark.createDataFrame([(list(reversed(c)), n) for c, n in cases.items()], "weeks array<int>, n int")
    assert rows.where(outreach.streak(F.col("weeks")) != F.col("n")).count() == 0


def test_rate_limit(spark):
    rows = spark.createDataFrame([(i, 1, s) for i, s in enumerate([0, 10, 20, 61, 62, 71])], "id long, key long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = limiter.sliding(rows, "key", "ts", "id", 60, 2).orderBy("id").collect()
    assert [r["accepted"] for r in got] == [True, True, False, True, False, True]


def test_day_hash():
    assert outreach.day_hash("2026-8-9") == -1920569191 and abs(-1920569191) % 7 == 2


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, name string, note string")
    new = spark.createDataFrame([(2, "b", None), (3, "c", "z"), (1, "a", None)], "id int, name string, note string")
    assert sorted(map(tuple, changes.override(old, new, ["id"]).collect())) == [(1, "a", None), (2, "b", None), (3, "c", "z")]
    patch = spark.createDataFrame([(1, ["name", "note"], None, None)], "id int, fields array<string>, name string, note string")
    assert sorted(map(tuple, changes.patch(old, patch, "id", ("name",)).collect())) == [(1, "a", None), (2, "b", None)]
