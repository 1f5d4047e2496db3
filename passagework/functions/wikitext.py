"""Per-row helper: readable text of wiki markup."""

from __future__ import annotations

import html
import re

from passagework import fixed

HEADING_LINE = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.M)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
INNER_TEMPLATE = re.compile(r"\{\{(?:(?!\{\{|\}\}).)*\}\}", re.S)
INNER_LINK = re.compile(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]", re.S)
MEDIA = re.compile(r"\s*(?:" + "|".join(fixed.MEDIA_LINK_PREFIXES) + r"):", re.I)
WEB_LINK = re.compile(r"\[(?:https?:)?//[^\s\]]+(?:[ \t]+([^\]]*))?\]")
QUOTES = re.compile(r"'{2,5}")
LINE_MARKS = re.compile(r"^[*#:;]+", re.M)
GAPS = re.compile(r"\n{3,}")


def _until_stable(pattern, replace, text):
    """Apply to the innermost matches again and again, so nesting is handled."""
    while True:
        text, found = pattern.subn(replace, text)
        if not found:
            return text


def _link(match):
    target, bar, label = match.group(1).partition("|")
    if MEDIA.match(target):
        return ""
    return label if bar else target


def _plain(section: str) -> str:
    section = REF.sub("", section)
    # every template is dropped from plain text, the note lists among them
    section = _until_stable(INNER_TEMPLATE, "", section)
    section = _until_stable(INNER_LINK, _link, section)
    section = WEB_LINK.sub(lambda m: m.group(1) or "", section)
    section = HEADING_LINE.sub(r"\2", section)
    section = TAG.sub("", section)
    section = QUOTES.sub("", section)
    section = LINE_MARKS.sub("", section)
    return GAPS.sub("\n\n", html.unescape(section)).strip()


def clean(raw: str) -> str:
    """Text of every section (the lead first), blank-line separated, without markup."""
    raw = COMMENT.sub("", raw)
    starts = [0, *(m.start() for m in HEADING_LINE.finditer(raw)), len(raw)]
    sections = (_plain(raw[a:b]) for a, b in zip(starts, starts[1:]))
    return "\n\n".join(s for s in sections if s)
