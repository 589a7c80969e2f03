"""Encodings that are safe to hand to spreadsheets and browsers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from fieldbook.functions.patterns import SPACE


def csv_cell(value: Column) -> Column:
    """A cell by RFC 4180; one that a spreadsheet would run as a formula begins with an apostrophe; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text.rlike(f"^{SPACE}*[=+\\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_row(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for v in values])


def plain_cell(value: Column) -> Column:
    """A cell quoted only for a comma, a quote or a line feed, its formulas as they are; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def html_attribute(value: Column) -> Column:
    """What a double-quoted attribute needs: four of the characters, not the apostrophe; null is empty."""
    text = F.coalesce(value, F.lit(""))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def html(value: Column) -> Column:
    """The five characters with a meaning in HTML as entities; null is empty."""
    text = F.coalesce(value, F.lit(""))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def uri_component(text: Column) -> Column:
    """Percent-encoding of everything but letters, digits and ``-_.!~*'()``."""
    out = F.url_encode(text)
    for code, c in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def html_field(label: str, value: Column) -> Column:
    """A labelled line of a printed card; nothing for an empty value."""
    said = F.concat(F.lit(f'<div class="field"><span class="label">{label}:</span> <span class="value">'), html(value), F.lit("</span></div>"))
    return F.when(F.coalesce(value, F.lit("")) != "", said).otherwise("")


def pads(key: str) -> tuple[bytes, bytes]:
    """The inner and the outer block of a key for HMAC-SHA-256."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hex: two nested digests; the padded key is known when the plan is built."""
    inner, outer = (F.unhex(F.lit(pad.hex())) for pad in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
