"""Markup as Column expressions: character references, the strings of JSON text, and the text nodes of pages."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, clean, column

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LOST = "\ufffd"
#: Attributes of a tag; quoted values may hold any sign.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_RAW = rf"(?is)^<(?:script|style)\b{_INSIDE}>"
#: Parts of a page, in order of trial: comments, raw elements up to their end tag, tags, declarations, text, a lone "<".
_PARTS = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)\b{_INSIDE}>.*?(?=</\1\b|\z)|</?[a-z]{_INSIDE}>|</?[a-z][^>]*+(?:>|\z)|<[!?/][^>]*+(?:>|\z)|[^<]++|<"


def _constant_map(values: dict[str, str]) -> Column:
    """A map literal: a constant, so it is read once and not for each row."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _windows_1252() -> dict[str, str]:
    """Numbers 128 to 159 mean characters of this code page where it has one."""
    out = {}
    for n in range(128, 160):
        try:
            out[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(n)] = chr(n)
    return out | {"0": LOST, "13": "\r"}


def _character(n: Column) -> Column:
    """The character of a code point; controls and non-characters cannot be named and are left out, as the standard has it."""
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    point = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    plain = F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), LOST).when(none, "").otherwise(point)
    return F.coalesce(F.try_element_at(_constant_map(_windows_1252()), n.cast("string")), plain)


def _numeric(ref: Column) -> Column:
    digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    base = F.when(F.lower(F.substring(ref, 3, 1)) == "x", 16).otherwise(10)
    # eight digits cannot overflow, and more of them are beyond the last code point
    known = F.concat(F.lit("0"), F.substring(digits, 1, 8))
    n = F.when(base == 16, F.conv(known, 16, 10)).otherwise(known).cast("long")
    return F.when(F.length(digits) > 8, LOST).otherwise(_character(n))


def _named(ref: Column) -> Column:
    """The whole name, or else its longest beginning among the names that need no semicolon."""
    name = F.substring(ref, 2, 40)
    short = {k: v for k, v in html5.items() if not k.endswith(";")}
    longest = max(map(len, short))
    begins = [F.when(F.length(name) > k, F.concat(F.try_element_at(_constant_map(short), F.substring(name, 1, k)), F.substring(name, k + 1, 40))) for k in range(longest, 1, -1)]
    return F.coalesce(F.try_element_at(_constant_map(html5), name), *begins, ref)


def unescaped(text) -> Column:
    """Character references decoded; null stays null."""
    t = column(text)
    decoded = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), lambda r: F.when(F.substring(r, 2, 1) == "#", _numeric(r)).otherwise(_named(r)))
    pieces = F.zip_with(F.split(t, REFERENCE, -1), decoded, lambda gap, ref: F.concat(gap, F.coalesce(ref, F.lit(""))))
    return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)


def unescaped_json(value) -> Column:
    """JSON text with the character references of every string in it decoded, at any depth; names stay; no JSON is null.

    Only strings that hold a reference, as such or behind a JSON escape, are written anew; all other text stays as it is.
    """
    v = column(value)
    parts = F.regexp_extract_all(v, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?|[^"]++'), F.lit(0))
    read = lambda s: F.try_variant_get(F.try_parse_json(s), "$", "string")
    quoted = lambda s: F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1)
    anew = lambda p: p.startswith('"') & ~p.endswith(":") & p.rlike(r"&|\\u0026")
    walked = F.transform(parts, lambda p: F.when(anew(p), quoted(unescaped(read(p)))).otherwise(p))
    return F.when(F.try_parse_json(v).isNotNull(), F.array_join(walked, ""))


def page_text(page) -> Column:
    """Every text node of a page, cleaned and joined by spaces; what scripts and styles hold stays as written, comments do not.

    A comment, declaration or tag without an end goes to the end of the page; null is the empty text.
    """
    parts = F.regexp_extract_all(blank(page), F.lit(_PARTS), F.lit(0))
    node = lambda p: F.when(p.rlike(_RAW), F.regexp_replace(p, _RAW, "")).when(p.rlike(r"(?i)^<[a-z/!?]"), "").otherwise(unescaped(p))
    return F.array_join(F.filter(F.transform(parts, lambda p: clean(node(p))), lambda t: t != ""), " ")
