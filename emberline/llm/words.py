"""Normalised words of a text with their places in the original."""

from __future__ import annotations

import html
import re
import unicodedata

#: Tags inside of a word that don't end it; every other tag does.
INLINE_TAGS = frozenset("a abbr b big code em font i ins mark s small span strong sub sup tt u wbr".split())

_SPECIAL = re.compile(
    r"(?P<hyphen>(?<=\w)[-‐‑­](?:[ \t​]*(?:\r?\n|<br\s*/?>)[ \t]*)+(?=\w|&\#|<|­|​))"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>"
    r"|<!--.*?-->"
    r"|&(?:amp;)*(?P<entity>\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
    r"|(?P<other>[^\x00-\x7f])",
    re.S | re.I,
)
_WORD = re.compile(r"[^\W_]+")
_plain: dict[str, str] = {}


def plain_char(c: str) -> str:
    """A character without case, accents and compatibility forms; nothing for marks and invisible ones."""
    out = _plain.get(c)
    if out is None:
        out = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) not in ("Mn", "Me", "Cf", "Cc", "Co", "Cs", "Cn") or x in "\t\n\r")
        out = "".join(x for x in unicodedata.normalize("NFKD", out.casefold()) if unicodedata.category(x) != "Mn")
        if unicodedata.category(c) in ("Zs", "Zl", "Zp"):
            out = " "
        if len(_plain) < 200_000:
            _plain[c] = out
    return out


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words (runs of letters and digits) and the start and end of each in ``text``."""
    pieces, origin, at, clean = [], [], 0, 0  # origin: (clean offset, original offset, whether one character stands for a longer stretch)
    for m in _SPECIAL.finditer(text):
        if m.start() > at:
            pieces.append(text[at : m.start()])
            origin.append((clean, at, m.start() - at))
            clean += m.start() - at
        if m["other"] is not None:
            new = plain_char(m["other"])
        elif m["entity"] is not None:
            raw = html.unescape(f"&{m['entity']};")
            new = m.group(0) if raw == f"&{m['entity']};" else "".join(c.lower() if c < "\x80" else plain_char(c) for c in raw)
        elif m["hyphen"] is not None:
            new = ""
        elif m["tag"] is not None:
            new = "" if m["tag"].lower() in INLINE_TAGS else " "
        else:
            new = " "
        if new:
            pieces.append(new)
            origin.append((clean, m.start(), -(m.end() - m.start())))
            clean += len(new)
        at = m.end()
    if not origin:
        spans = [m.span() for m in _WORD.finditer(text)]
        low = text.lower()
        return [low[a:b] for a, b in spans], spans
    if at < len(text):
        pieces.append(text[at:])
        origin.append((clean, at, len(text) - at))
    joined = "".join(pieces).lower()
    words, spans, k = [], [], 0
    for m in _WORD.finditer(joined):
        a, b = m.span()
        while k + 1 < len(origin) and origin[k + 1][0] <= a:
            k += 1
        begin, start, length = origin[k]
        first = start + (a - begin) if length > 0 else start
        j = k
        while j + 1 < len(origin) and origin[j + 1][0] <= b - 1:
            j += 1
        begin, start, length = origin[j]
        last = start + (b - begin) if length > 0 else start - length
        words.append(m.group(0))
        spans.append((first, last))
    return words, spans
