"""Text cleaning on columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their plain forms, from the Unicode decomposition rule."""
    marked, plain = [], []
    for point in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(point))[0]
        if base != chr(point) and base.isascii():
            marked.append(chr(point))
            plain.append(base)
    return "".join(marked), "".join(plain)


def snake(name: str) -> str:
    """Header text as a plain snake_case name (byte order mark and accents dropped)."""
    text = unicodedata.normalize("NFD", name.replace("\ufeff", "").strip().strip('"').replace("'", ""))
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    text = text.replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    if not text:
        return "x"
    return f"x{text}" if text[0].isdigit() else text


def snake_all(names) -> list[str]:
    """``snake`` over a header; repeated names get ``_2``, ``_3`` ..."""
    seen: dict[str, int] = {}
    out = []
    for name in map(snake, names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def fold_accents(text) -> Column:
    marked, plain = _accent_table()
    return F.translate(_col(text), marked, plain)


def title_case(text) -> Column:
    """Upper case after every non-letter, not only after a blank (``Timor-Leste``)."""
    pieces = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"([\p{L}\p{N}_']+|[^\p{L}\p{N}_']+)"), F.lit(1))
    raised = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
    return F.array_join(raised, "")


def strip_footnotes(text) -> Column:
    """Drop ``(...)`` notes and a trailing ``_12`` position mark."""
    bare = F.regexp_replace(_col(text), r"\s*\([^)]*\)", "")
    return F.trim(F.regexp_replace(bare, r"_\d+$", ""))


def strip_position(text) -> Column:
    """Column name without the position suffix that repeated headers carry."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"_\d+$", ""), r"\d$", "")


def before_last_comma(text) -> Column:
    c = _col(text)
    return F.when(c.contains(","), F.regexp_extract(c, r"^(.*),", 1)).otherwise(c)


def before_first_comma(text) -> Column:
    return F.trim(F.substring_index(_col(text), ",", 1))


def underscores_to_blanks(text) -> Column:
    return F.translate(_col(text), "_", " ")
