"""Plain versions of the corpus operators for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def base_secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def repeated_words(texts: dict, width: int = 35) -> dict:
    """Per document: words, words removed, and the hash of those kept."""
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    seen: dict[tuple, list] = {}
    for k, w in words.items():
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((k, i))
    cut: dict = {k: set() for k in texts}
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cut[k].update(range(i, i + width))
    return {k: (len(w), len(cut[k]), sha(" ".join(x for i, x in enumerate(w) if i not in cut[k]))) for k, w in words.items()}


def repeated_bytes(texts: dict, width: int = 400) -> dict:
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen: dict[bytes, list] = {}
    for k, b in data.items():
        for i in range(len(b) - width + 1):
            seen.setdefault(b[i : i + width], []).append((k, i))
    cut = {k: bytearray(len(b)) for k, b in data.items()}
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cut[k][i : i + width] = b"\1" * width
    out = {}
    for k, b in data.items():
        kept = bytes(x for x, c in zip(b, cut[k]) if not c)
        runs = len(re.findall(b"\1+", bytes(cut[k])))
        out[k] = (len(b), len(b) - len(kept), runs, sha(kept))
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
