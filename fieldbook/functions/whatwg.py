"""The parts of a link as browsers read them: every function maps columns to a column, with each step bound once.

The schemes with hosts (http, https, ftp, ws, wss) are read in full; any other scheme gives its name alone.  Of the mapping of
host names outside ASCII only lower case is done before Punycode; other forms of the same characters are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldbook.functions.text import once

# fixed values: schemes with a host and their default ports, and characters no host name has
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
# fixed values: Punycode's parameters
BASE, TMIN, TMAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits of the largest distance that a label of a host name can need, and rounds that bring one below the adaptation's bound.
WIDEST, ROUNDS = 7, 5


def _number(part: Column) -> Column:
    """A part of a numeric host, as hexadecimal, octal or decimal; null if it is none."""
    hexadecimal = F.coalesce(F.conv(F.substr(part, F.lit(3)), 16, 10), F.lit("0"))
    return (F.when(part.rlike("^0x[0-9a-f]*$"), hexadecimal).when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10))
            .when(part.rlike("^(?:0|[1-9][0-9]*)$"), part)).try_cast("long")


def ipv4(host: Column) -> Column:
    """The 32-bit address of a host whose last part is a number; -1 if it is no address, null if the host is a name.

    One to four parts, each in one of three bases, the last one filling the bytes that are left.
    """
    def address(parts: Column) -> Column:
        values, n = F.transform(parts, lambda p: _number(p)), F.size(parts)
        last = F.element_at(values, -1)
        head = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0)))
        fine = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(head, lambda v: v <= 255) & (last < F.pow(F.lit(256.0), 5 - n))
        high = F.aggregate(F.transform(head, lambda v, i: (v * F.pow(F.lit(256.0), 3 - i)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
        return F.when(F.element_at(parts, -1).rlike("^(?:[0-9]+|0x[0-9a-f]*)$"), F.when(F.coalesce(fine, F.lit(False)), high + last).otherwise(F.lit(-1).cast("long")))

    return once(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), address)


def dotted(address: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(address, k).bitwiseAND(255)).cast("string") for k in (24, 16, 8, 0)])


def ipv6(text: Column) -> Column:
    """The eight pieces of an address (without brackets, lower-case) as numbers, or null if it is none."""
    part = "(0|[1-9][0-9]{0,2})"
    tail = rf"^(.*:){part}\.{part}\.{part}\.{part}$"

    def two(t: Column) -> Column:
        """An address that ends as one of four numbers, with these as its last two pieces."""
        a, b, c, d = (F.regexp_extract(t, tail, i).try_cast("int") for i in (2, 3, 4, 5))
        small = (a < 256) & (b < 256) & (c < 256) & (d < 256)
        return F.when(~t.contains("."), t).when(F.coalesce(small, F.lit(False)), F.concat(F.regexp_extract(t, tail, 1), F.lower(F.hex(a * 256 + b)), F.lit(":"), F.lower(F.hex(c * 256 + d))))

    none = F.array().cast("array<string>")
    listed = lambda half: F.when(half == "", none).otherwise(F.split(half, ":"))

    def pieces(t: Column) -> Column:
        halves = F.split(t, "::", 2)
        left, right = listed(halves[0]), listed(F.try_element_at(halves, F.lit(2)))
        room = 8 - F.size(left) - F.size(right)
        filled = F.when(room > 0, F.concat(left, F.array_repeat(F.lit("0"), room.cast("int")), right))
        return F.when(t.contains("::"), filled).when(F.size(F.split(t, ":")) == 8, F.split(t, ":"))

    fine = lambda ps: F.when(F.forall(ps, lambda p: p.rlike("^[0-9a-f]{1,4}$")), F.transform(ps, lambda p: F.conv(p, 16, 10).cast("int")))
    return once(two(text), lambda t: once(pieces(t), fine))


def shown(pieces: Column) -> Column:
    """An IPv6 address in its shortest form: the first of the longest runs of two zeros or more is left out."""
    def shorten(s: Column) -> Column:
        out = s
        for n in range(2, 9):  # the longest run is tried first
            out = F.when(s.contains(":0" * n + ":"), F.regexp_replace(s, f"^(.*?)(?::0){{{n}}}:", "$1::")).otherwise(out)
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    return once(F.concat(F.lit(":"), F.array_join(F.transform(pieces, lambda p: F.lower(F.hex(p))), ":"), F.lit(":")), shorten)


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """Punycode's bias after a distance."""
    start = F.floor(delta / F.when(first, F.lit(DAMP)).otherwise(F.lit(2)))
    bound = (BASE - TMIN) * TMAX // 2
    state = F.struct((start + F.floor(start / points)).cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, lambda s, _: F.when(
        s["d"] > bound, F.struct(F.floor(s["d"] / (BASE - TMIN)).cast("long").alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s))
    return once(rounds, lambda r: (r["k"] + F.floor((BASE - TMIN + 1) * r["d"] / (r["d"] + SKEW))).cast("long"))


def _distance(delta: Column, bias: Column) -> Column:
    """A distance as Punycode digits."""
    digit = lambda n: F.substr(F.lit(DIGITS), (n + 1).cast("int"), F.lit(1))
    state = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        t = F.least(F.lit(TMAX).cast("long"), F.greatest(F.lit(TMIN).cast("long"), k * BASE - bias))
        more = F.struct(F.floor((s["q"] - t) / (BASE - t)).alias("q"), F.concat(s["out"], digit(t + (s["q"] - t) % (BASE - t))).alias("out"), F.lit(False).alias("done"))
        last = F.struct(s["q"].alias("q"), F.concat(s["out"], digit(s["q"])).alias("out"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(s["q"] < t, last).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(WIDEST).cast("long")), state, step)["out"]


def punycode(label: Column) -> Column:
    """A label outside ASCII by Punycode, with its prefix; others as they are.

    Characters outside ASCII are inserted in the order of their code points, then places; what is written of each is its
    distance from the one before, counted over all code points and places between them.
    """
    def encode(points: Column) -> Column:
        placed = F.transform(points, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        high = F.array_sort(F.filter(placed, lambda x: x["c"] >= FIRST))
        basic = F.size(points) - F.size(high)
        start = F.struct(F.lit(FIRST).cast("long").alias("c"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(BIAS).cast("long").alias("bias"), F.lit("").alias("out"))

        def insert(s: Column, x: Column) -> Column:
            there = F.size(F.filter(placed, lambda y: (y["i"] < x["i"]) & (y["c"] <= x["c"]))).cast("long")
            points_now = basic + s["n"] + 1
            delta = (x["c"] - s["c"]) * points_now + there - s["at"]
            return once(delta, lambda d: F.struct(x["c"].cast("long").alias("c"), (there + 1).alias("at"), (s["n"] + 1).alias("n"),
                                                  _adapted(d, points_now, s["n"] == 0).alias("bias"), F.concat(s["out"], _distance(d, s["bias"])).alias("out")))

        return F.aggregate(high, start, insert)["out"]

    plain = F.regexp_replace(label, r"[^\x00-\x7F]", "")
    points = F.transform(F.split(label, ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    encoded = once(F.filter(points, lambda c: c.isNotNull()), encode)
    return F.when(label.rlike(r"^[\x00-\x7F]*$"), label).otherwise(F.concat(F.lit("xn--"), plain, F.when(plain != "", "-").otherwise(""), encoded))


def _name(raw: Column) -> Column:
    """A host that is no IPv6 address, in its canonical form; null if it is none."""
    def judge(name: Column) -> Column:
        number = lambda n: F.when(n.isNull(), name).when(n >= 0, dotted(n))
        return F.when((name != "") & ~name.rlike(FORBIDDEN), once(ipv4(name), number))

    decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    folded = F.regexp_replace(F.lower(decoded), "[。．｡]", ".")
    ascii_name = once(folded, lambda h: F.when(h.rlike(r"^[\x00-\x7F]*$"), h).otherwise(F.array_join(F.transform(F.split(h, r"\."), punycode), ".")))
    return once(ascii_name, judge)


def _host(raw: Column) -> Column:
    inside = F.regexp_extract(raw, r"^\[([0-9a-f:.]+)\]$", 1)
    return F.when(raw.startswith("["), once(ipv6(inside), lambda p: F.when(p.isNotNull(), F.concat(F.lit("["), shown(p), F.lit("]"))))).otherwise(_name(raw))


def parse(url: Column) -> Column:
    """struct (scheme, user, host, port, rest); null for what is no link.  A default port is null; `rest` begins behind the authority."""
    def authority(scheme: Column, after: Column) -> Column:
        place = F.regexp_extract(after, r"^([^/\\?#]*)", 1)
        return once(F.struct(place.alias("place"), F.substr(after, F.length(place) + 1).alias("rest")), lambda a: split(scheme, a))

    def split(scheme: Column, a: Column) -> Column:
        end = F.regexp_replace(a["place"], "^.*@", "")
        return once(F.struct(end.alias("end"), F.left(a["place"], F.greatest(F.length(a["place"]) - F.length(end) - 1, F.lit(0))).alias("user"),
                             F.regexp_extract(F.lower(end), r"^(\[[^\]]*\]|[^:]*)", 1).alias("host")), lambda p: judge(scheme, a, p))

    def judge(scheme: Column, a: Column, p: Column) -> Column:
        colon = F.substr(p["end"], F.length(p["host"]) + 1)
        digits = F.regexp_replace(F.substr(colon, F.lit(2)), "^0+(?=.)", "")
        port = F.when(F.length(digits).between(1, 5), digits.try_cast("int"))
        fine = colon.rlike("^(?::[0-9]*)?$") & ((digits == "") | F.coalesce(port <= 65535, F.lit(False)))
        default = F.coalesce(*[F.when(scheme == s, F.lit(n)) for s, n in DEFAULT_PORTS.items()])
        return once(_host(p["host"]), lambda h: F.when(fine & h.isNotNull(), F.struct(
            scheme.alias("scheme"), p["user"].alias("user"), h.alias("host"), F.when(port != default, port).alias("port"), a["rest"].alias("rest"))))

    def whole(t: Column) -> Column:
        scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        nothing = F.lit(None).cast("string")
        other = F.struct(scheme.alias("scheme"), F.lit("").alias("user"), F.lit("").alias("host"), F.lit(None).cast("int").alias("port"), nothing.alias("rest"))
        return (F.when(scheme.isin(*DEFAULT_PORTS), authority(scheme, F.regexp_replace(t, r"^[^:]*:[/\\]*", ""))).when(scheme != "", other))

    return once(F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""), whole)
