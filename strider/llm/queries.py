"""The queries and SQL of this subpackage."""

from __future__ import annotations

from strider.llm import chat, decontam, html, langid, media, mixing, neardup, substrings, urls, warc

MODULES = (langid, chat, neardup, mixing, media, html, warc, substrings, urls, decontam)


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(m, what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
