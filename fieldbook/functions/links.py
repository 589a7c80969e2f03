"""Links: canonical form, structural safety, off-topic hosts and the status of a probe."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldbook.functions import whatwg
from fieldbook.functions.text import blank_to_null, once, strip

# fixed values: names that never leave the machine, and the reasons of the off-topic rules as (reason, hosts, path pattern)
BLOCKED_HOSTS = ("localhost", "ip6-localhost", "ip6-loopback", "metadata.google.internal", "metadata")
OFF_TOPIC = (
    ("Freelance/gig marketplace — not a victim/advocacy resource",
     ("fiverr.com", "upwork.com", "freelancer.com", "peopleperhour.com", "guru.com", "toptal.com", "worksome.com", "codemap.io",
      "kolabtree.com", "aijobs.net", "flippa.com"), None),
    ("No-code/dev marketplace — not a victim/advocacy resource", ("nocodedevs.com", "makerpad.com"), None),
    ("Craigslist classifieds search (gigs/sales/rooms) — not a victim-services housing program",
     ("craigslist.org",), r"(?i)/search/.*(ggg|sss|ccc|bbb|hhh|roo|apa)"),
    ("Volunteer-exchange / farm-stay platform — not a victim-services resource", ("helpx.net", "wwoof.net", "workaway.info"), None),
    ("Job board — not a victim/advocacy resource",
     ("wellfound.com", "indeed.com", "linkedin.com", "glassdoor.com", "monster.com", "ziprecruiter.com", "simplyhired.com"), None),
    ("Facebook login redirect — not a reachable organisation page", ("facebook.com",), r"(?i)/login"),
    ("Discord community invite — not a victim/advocacy organisation website",
     ("discord.com", "discord.do", "discord.gg", "discordapp.com"), r"(?i)/invite/"),
    ("Reddit community — not an organisation website", ("reddit.com",), r"(?i)/r/"),
    ("Reddit homepage — not a specific organisation", ("reddit.com",), r"^/?$"),
    ("Link aggregator — review manually", ("linktr.ee",), None),
)
STATUSES = ("live", "dead", "off-topic", "uncertain", "invalid")


def _segments(path: Column) -> Column:
    """A path without its dot segments: `.` goes, `..` takes the one before with it."""
    here, up = r"^(?:\.|%2[eE])$", r"^(?:\.|%2[eE]){2}$"
    parts = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, s: F.when(s.rlike(up), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
                       .when(s.rlike(here), done).otherwise(F.concat(done, F.array(s))))
    ends = F.element_at(parts, -1).rlike(r"^(?:\.|%2[eE]){1,2}$")
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(ends, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))


def _encoded(text: Column, special: str) -> Column:
    """Characters outside ASCII, controls and those of `special` percent-encoded as UTF-8."""
    plain = rf"^[^\x00-\x20\x7F-\x{{10FFFF}}{special}]*$"
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(plain), c).when(c == " ", "%20").otherwise(F.url_encode(c))), "")
    return F.when(text.rlike(plain), text).otherwise(each)


def normalize(raw: Column) -> Column:
    """https by default, lower-case scheme and canonical host, no default port, a path without dot segments; a bare host has no slash at its end.

    Anything that is no http link is null.
    """
    def whole(u: Column) -> Column:
        path = F.replace(F.regexp_extract(u["rest"], "^([^?#]*)", 1), F.lit("\\"), F.lit("/"))
        path = once(path, lambda p: F.when(p.rlike(r"/(?:\.|%2[eE])"), _segments(p)).otherwise(p))
        search, fragment = F.regexp_extract(u["rest"], r"^[^?#]*(\?[^#]*)", 1), F.regexp_extract(u["rest"], "^[^#]*(#.*)$", 1)
        rest = F.concat(_encoded(path, '"<>`{}'), _encoded(search, "\"<>'"), _encoded(fragment, '"<>`'))
        end = once(rest, lambda r: F.when(r == "/", F.lit("")).when(r.rlike("^[?#]"), F.concat(F.lit("/"), r)).otherwise(r))
        user = F.when(u["user"].isin("", ":"), "").otherwise(F.concat(F.replace(u["user"], F.lit("@"), F.lit("%40")), F.lit("@")))
        port = F.coalesce(F.concat(F.lit(":"), u["port"].cast("string")), F.lit(""))
        return F.when(u["host"] != "", F.concat(u["scheme"], F.lit("://"), user, u["host"], port, end))

    linked = lambda t: F.when((t != "") & ~t.startswith("mailto:"), F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t)))
    return once(once(strip(raw), lambda t: whatwg.parse(linked(t))), whole)


def display(url: Column) -> Column:
    """Percent-decoded (as it is where that fails), without scheme and one slash at the end."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url, F.lit(""))
    return F.regexp_replace(F.regexp_replace(decoded, "(?i)^https?://", ""), "/$", "")


def _low(address: Column) -> Column:
    """Whether a 32-bit address is loopback, link-local, private, carrier, multicast or reserved."""
    a, b = F.shiftright(address, 24), F.shiftright(address, 16).bitwiseAND(255)
    return (a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)))


def _private(h: Column) -> Column:
    """Whether a canonical host is such an address, or one of IPv6; an address mapped into IPv6 is judged as what it maps."""
    def six(p: Column) -> Column:
        first = F.lower(F.hex(p[0]))
        zeros = lambda n: F.forall(F.slice(p, F.lit(1), F.lit(n)), lambda x: x == 0)
        mapped = zeros(5) & (p[5] == 0xFFFF)
        return (zeros(7) & (p[7] <= 1)) | first.rlike("^(?:fe80|fc|fd|ff)") | (mapped & _low(p[6].cast("long") * 65536 + p[7]))

    inside = F.regexp_extract(h, r"^\[(.*)\]$", 1)
    return F.coalesce(F.when(h.startswith("["), once(whatwg.ipv6(inside), six)).otherwise(once(whatwg.ipv4(h), _low)), F.lit(False))


def safety_of(u: Column) -> Column:
    """ok, or why a link must not be fetched, from its parts."""
    private = once(u["host"], _private)
    return (F.when(u.isNull(), "invalid-url").when(~u["scheme"].isin("http", "https"), "scheme-not-allowed").when(~u["user"].isin("", ":"), "credentials-in-url")
            .when(u["host"].isin(*BLOCKED_HOSTS), "blocked-host").when(private, "private-ip").otherwise("ok"))


def safety(url: Column) -> Column:
    return once(whatwg.parse(url), safety_of)


def off_topic_of(u: Column) -> Column:
    """The reason of the first rule for the link's host (without www.) and path, or null, from its parts."""
    h = F.regexp_replace(F.regexp_replace(u["host"], r"^\[|\]$", ""), r"^www\.", "")
    path = F.coalesce(blank_to_null(F.regexp_extract(u["rest"], "^([^#]*)", 1)), F.lit("/"))
    return once(F.struct(h.alias("h"), path.alias("p")), lambda x: F.coalesce(*[
        F.when(x["h"].isin(*hosts) & (x["p"].rlike(pattern) if pattern else F.lit(True)), F.lit(reason)) for reason, hosts, pattern in OFF_TOPIC]))


def off_topic(url: Column) -> Column:
    return once(whatwg.parse(url), off_topic_of)


def outcome(code: Column, method: Column) -> Column:
    """What an HTTP status says; null is no answer."""
    return (F.when(code.isNull(), "network-error").when(code.between(200, 399), "ok").when(code.isin(404, 410, 451), "dead")
            .when((method == "HEAD") & code.isin(403, 405), "method-not-allowed").when(code.between(400, 499), "restricted")
            .otherwise("server-error"))


def status(safe: Column, reason: Column, result: Column) -> Column:
    """live, dead, off-topic, uncertain or invalid, from what safety, off_topic and outcome said."""
    return (F.when(safe != "ok", "invalid").when(reason.isNotNull(), "off-topic")
            .when(result == "ok", "live").when(result == "dead", "dead").otherwise("uncertain"))
