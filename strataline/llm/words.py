"""Words of noisy texts, shared by the operators of this package."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

_TAG = re.compile(r"<[A-Za-z/!][^<>]{0,200}>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n[\s>|]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def _without(text: str, unwanted: Callable[[str], bool]) -> str:
    """Text without its characters of a kind; each character it has is looked at once, however often it stands there."""
    for c in set(text):
        if c > "\x7f" and unwanted(c):
            text = text.replace(c, "")
    return text


def plain(text: str) -> str:
    """Text without markup, entities, invisible characters and hyphens at line ends."""
    text = _TAG.sub(" ", html.unescape(text)) if "&" in text or "<" in text else text
    if not text.isascii():
        text = _without(text, lambda c: unicodedata.category(c) == "Cf")
    return _HYPHEN.sub("", text)


def words(text: str | None) -> list[str]:
    """Lower-case words without accents, punctuation and markup; null gives none."""
    return words_of(plain(text)) if text else []


def words_of(body: str) -> list[str]:
    """The same of a text that is plain already."""
    text = body.casefold()
    if not text.isascii():
        text = _without(unicodedata.normalize("NFKD", text), lambda c: unicodedata.combining(c) != 0)
    return _WORD.findall(text)
