"""Scans of arrivals for planted values: decoded views of a text, and matchers that bridge separators."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame

BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}={0,2}(?![A-Za-z0-9+/=_-])")
ESCAPE = re.compile(r'\\(?:u[0-9a-fA-F]{4}|["\\/bfnrt])')


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: json.loads(f'"{m[0]}"'), text)


def printable_base64(text: str) -> list[str]:
    """What runs of base64 decode to, where nine tenths of it are printable ASCII."""
    out = []
    for run in BASE64_RUN.findall(text):
        plain = run.rstrip("=").replace("-", "+").replace("_", "/")
        if len(plain) % 4 == 1:
            continue
        try:
            decoded = base64.b64decode(plain + "=" * (-len(plain) % 4)).decode("utf-8", "replace")
        except binascii.Error:
            continue
        if decoded and sum(" " <= c <= "~" for c in decoded) >= 0.9 * len(decoded):
            out.append(decoded)
    return out


def views(text: str, passes: int = 3) -> list[str]:
    """The text, what percent- and JSON-decoding make of it in a few passes, and the base64 inside any of these."""
    seen, fresh = {text: None}, [text]
    for _ in range(passes):
        fresh = [d for v in fresh for d in (unquote(v), unescaped(v)) if d not in seen]
        seen.update(dict.fromkeys(fresh))
    for v in list(seen):
        seen.update(dict.fromkeys(printable_base64(v)))
    return list(seen)


def matcher(cls: str, value: str) -> re.Pattern:
    if cls == "NAME":
        first, last = map(re.escape, value.split(" "))
        return re.compile(rf"(?<![A-Za-z]){first}[ \t._\-+]{{1,3}}{last}(?![A-Za-z])", re.I)
    if cls == "DOB":
        y, m, d = (f"0?{p[1]}" if p[0] == "0" and len(p) == 2 else p for p in value.split("-"))
        gap = r"[ \t.\-/]{0,2}"
        return re.compile(rf"(?<![0-9])(?:{'|'.join(gap.join(o) for o in ((y, m, d), (d, m, y), (m, d, y)))})(?![0-9])")
    return re.compile(rf"(?<![0-9])(?:91[ \t.\-]{{0,2}})?0?{'[ \t.()/-]{0,3}'.join(value)}(?![0-9])")


def scan(arrivals: DataFrame, canaries: list[tuple[str, str]]) -> DataFrame:
    """id and the classes found in any view of each arrival (id, text). The list of canaries is part of the set-up, not data."""
    compiled = [(c, matcher(c, v)) for c, v in canaries]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted({c for v in views(t or "") for c, m in compiled if m.search(v)}) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "classes": found})

    return arrivals.select("id", "text").mapInPandas(run, "id long, classes array<string>")
