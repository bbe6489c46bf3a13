"""Markup as a stream of tags: depth, parent, what a tag closes, the nearest declaration, attributes in canonical order.

A tag closes the last open element of its name and with it all that are open
inside; a closing tag without an open element is stray. Comments, processing
instructions, CDATA, declarations and the contents of scripts and styles are tokens
of their own, so what looks like a tag in them isn't one.

`parts` goes through texts in Arrow batches: as a fold of Spark it took interpreted
expressions for each tag.

Null text gives null, text without tags an empty array. Elements beyond DEEPEST
aren't entered, and the text is not well formed. Positions are in characters, from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 256
#: Elements without an end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
TAG = r"""</?[A-Za-z](?:"[^"]*"|'[^']*'|[^<>"'])*{}>"""
TOKEN = f"{RAW}|{TAG.format('+')}"  # the plus: no way back into long tags
ATTRIBUTE = r"""([^\s=<>"'/]+)\s*=\s*("[^"]*"|'[^']*')"""

PART = "struct<nth: int, kind: string, name: string, pos: int, length: int, depth: int, parent: int, closes: int, implied: int, declared: string, attributes: string>"
#: The kinds that a token's first characters tell.
KINDS = (("<!--", "comment"), ("<![CDATA[", "cdata"), ("<?", "instruction"), ("<!", "declaration"), ("</", "close"))


def parts(text: Column, declaration: str = "lang") -> Column:
    """array<part> of the tokens of a text, in order. declared: the value of the attribute `declaration` of the element itself or of its nearest ancestor that has one; parent: the nth of the element around it; attributes: name="value", names in the order of their UTF-16 units, of repeated names all, in their order."""
    token, attribute = re.compile(TOKEN, re.ASCII), re.compile(ATTRIBUTE, re.ASCII)
    named, first_tag = re.compile(r"</?([A-Za-z][^\s/>]*)", re.ASCII), re.compile("<[^>]*>")
    own_value = re.compile(rf"""\s{declaration}\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.ASCII)
    kinds, void, deepest = KINDS, frozenset(VOID), DEEPEST

    def attributes(tag: str) -> str:
        pairs = sorted(attribute.findall(tag), key=lambda p: p[0].encode("utf-16-be"))
        return " ".join(f'{n}="{v[1:-1]}"' for n, v in pairs)

    def run(text: str | None) -> list[tuple] | None:
        if text is None:
            return None
        out: list[tuple] = []
        stack: list[tuple[str, int, str | None]] = []  # name, nth, declared
        for nth, m in enumerate(token.finditer(text)):
            t, deep = m[0], len(stack)
            found = named.match(t)
            name = found[1].lower() if found else ""
            kind = next((k for s, k in kinds if t.startswith(s)), None) or ("raw" if name in ("script", "style") else "empty" if name in void or t.endswith("/>") else "open")
            _, parent, declared = stack[-1] if stack else (None, None, None)
            closes, implied, depth, given = None, 0, deep, ""
            if kind == "close":
                at = next((i for i in range(deep - 1, -1, -1) if stack[i][0] == name), None)
                if at is None:
                    kind = "stray"
                else:
                    closes, implied, depth = stack[at][1], deep - 1 - at, at
                    parent = stack[at - 1][1] if at else None
                    del stack[at:]
            elif kind in ("open", "empty", "raw"):
                own = own_value.search(t)
                declared = own and (own[1] or own[2]) or declared
                given = attributes(first_tag.match(t)[0] if kind == "raw" else t)  # without the contents of a script
                if kind == "open" and deep < deepest:
                    stack.append((name, nth, declared))
            out.append((nth, kind, name if found else None, m.start(), len(t), depth, parent, closes, implied, declared, given))
        return out

    return F.udf(run, f"array<{PART}>", useArrow=True)(text)


def well_formed(found: Column) -> Column:
    """Whether every element is closed by its own tag, none is stray, and none lies too deep."""
    opened = F.size(F.filter(found, lambda p: p["kind"] == "open"))
    closed = F.size(F.filter(found, lambda p: p["kind"] == "close"))
    return (opened == closed) & ~F.exists(found, lambda p: (p["kind"] == "stray") | (p["implied"] > 0) | (p["depth"] >= DEEPEST))


def hidden(found: Column, text: Column) -> Column:
    """What readers of the text don't see: its comments, instructions, CDATA and raw contents, in order."""
    return F.transform(F.filter(found, lambda p: p["kind"].isin("comment", "instruction", "cdata", "raw")), lambda p: F.substring(text, p["pos"] + 1, p["length"]))
