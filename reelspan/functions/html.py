"""Markup as column expressions: tags with their attributes, text nodes, character references. All inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive throughout, so that no page makes the matcher go back over it.
_ATTRIBUTE = r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_ATTRIBUTES = _ATTRIBUTE.replace("([^\\s", "(?:[^\\s").replace('("', '(?:"')
#: A comment, a declaration or an instruction.
_ASIDE = r"<!--(?:.*?--!?>|.*$)|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>"
#: A script or style with its text, to the end of the page if it isn't closed.
_CODE = r"<(?:script|style)(?=[\s/>])[^>]*+>.*?(?:</(?:script|style)\s*+>|$)"
_TAG = rf"</?+[a-zA-Z][^\s/>]*+(?:(?:{_ATTRIBUTES})*+[\s/]*+>|[^>]*+>)"
#: Containers whose text is not that of the page.
_SILENT = "|".join(rf"<{t}(?=[\s/>])[^>]*+>.*?</{t}\s*+>" for t in ("template", "rt", "rp"))
#: Stands where markup was; a code point that texts never hold.
_CUT = "﷐"
#: Elements that have no content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

#: Numbers of the Windows code page that stand for other code points in character references.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _code_point(number: Column) -> Column:
    """The character of a number; the replacement character where there is none."""
    known = F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair])
    valid = number.between(0, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    plain = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")
    return F.coalesce(F.try_element_at(known, number.cast("int")), plain)


def _named() -> Column:
    """Characters by the name of their reference, from the standard's table."""
    names = {n.rstrip(";"): c for n, c in html5.items()}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def decode_references(text: Column, closed: bool = False) -> Column:
    """Text with its character references decoded, by name and by number.

    A reference ends at its semicolon or, unless it must be ``closed``, at the first sign that can't belong to it; unknown names
    stay without their semicolon.
    """
    end = ";" if closed else ";?"
    pieces = F.regexp_extract_all(text, F.lit(rf"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][-.a-zA-Z0-9]*){end}|[^&]+|&"), F.lit(0))
    table = _named()

    def decoded(p: Column) -> Column:
        name = F.regexp_extract(p, "^&#?([^;]*)", 1)
        number = F.when(name.rlike("^[xX]"), F.conv(F.substring(name, 2, 20), 16, 10)).otherwise(name).cast("decimal(38,0)")
        by_number = _code_point(F.when(number <= 0x10FFFF, number).otherwise(-1).cast("bigint"))
        is_number = p.rlike(f"^&#(?:[xX][0-9a-fA-F]{{1,15}}|[0-9]{{1,30}}){end}$")
        is_name = p.rlike(f"^&[a-zA-Z][-.a-zA-Z0-9]*{end}$")
        unknown = p if closed else F.regexp_replace(p, ";$", "")
        return F.when(is_number, by_number).when(p.rlike("^&#[xX]?[0-9a-fA-F]"), F.lit("�")).when(is_name, F.coalesce(F.try_element_at(table, name), unknown)).otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&"), decoded(p)).otherwise(p)), "")).otherwise(text)


def text_nodes(markup: Column) -> Column:
    """The pieces of text between tags and comments, decoded; none from scripts, styles, templates or ruby annotations."""
    plain = F.replace(F.coalesce(markup, F.lit("")), F.lit(_CUT), F.lit(""))
    bare = F.regexp_replace(plain, rf"(?is)<!\[CDATA\[(.*?)\]\]>|{_CODE}|{_SILENT}|{_ASIDE}|{_TAG}", f"{_CUT}$1{_CUT}")
    return F.transform(F.filter(F.split(bare, _CUT), lambda t: t != ""), lambda t: decode_references(t))


def text_of(markup: Column) -> Column:
    """All text of a piece of markup: its text nodes without white space at their ends, blank ones left out, joined by blanks."""
    blank = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
    return F.array_join(F.filter(F.transform(text_nodes(markup), lambda t: F.regexp_replace(t, blank, "")), lambda t: t != ""), " ")


def tags(markup: Column) -> Column:
    """Tags in order, as (name, ends, empty, attributes): lower-case name, whether it is an end tag, whether it can have no content, its attributes by lower-case name.

    Attributes may be in double, single or no quotes, their references are decoded, of repeated ones the last counts.
    Comments, scripts and styles hold no tags.
    """
    found = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(rf"(?is){_CODE}|{_ASIDE}|{_TAG}"), F.lit(0))

    def entry(piece: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(piece, rf"(?s)^{_ATTRIBUTE}", 2), r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.struct(F.lower(F.regexp_extract(piece, rf"(?s)^{_ATTRIBUTE}", 1)).alias("name"), decode_references(value, closed=True).alias("value"))

    def attributes(tag: Column) -> Column:
        body = F.regexp_replace(tag, r"(?s)^</?+[a-zA-Z][^\s/>]*+|/?>$", "")
        entries = F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTES), F.lit(0)), entry)
        names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["name"] == n), -1)["value"]))

    def tag(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
        return F.struct(name.alias("name"), t.startswith("</").alias("ends"), (t.endswith("/>") | name.isin(*VOID)).alias("empty"), attributes(t).alias("attributes"))

    return F.transform(F.filter(found, lambda t: t.rlike("^</?[a-zA-Z]") & ~t.rlike(r"(?i)^<(?:script|style)[\s/>]")), tag)


def unquote(text: Column) -> Column:
    """Percent-encoded text decoded; what is no valid escape stays, and so do plus signs."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), text)
