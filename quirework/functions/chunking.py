"""Bounded passages: paragraphs, then lines, then sentences, then characters, merged up to a least size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 3500, 9000
_LEVELS = (("\n\n", re.compile(r"\n\n")), ("\n", re.compile(r"\n")), (" ", re.compile(r"(?<=[.!?])\s+")))


def split_text(text: str, most: int = MOST, level: int = 0) -> list[str]:
    """Pieces of at most `most` characters, cut at the coarsest level that does."""
    text = text.strip()
    if len(text) <= most:
        return [text] if text else []
    if level == len(_LEVELS):
        return [text[i : i + most] for i in range(0, len(text), most)]
    glue, cut_at = _LEVELS[level]
    out: list[str] = []
    held = ""
    for part in filter(None, (p.strip() for p in cut_at.split(text))):
        if len(part) > most:
            out += [held] * bool(held) + split_text(part, most, level + 1)
            held = ""
        elif held and len(held) + len(glue) + len(part) > most:
            out.append(held)
            held = part
        else:
            held = held + glue + part if held else part
    return out + [held] * bool(held)


def passages(text: str | None, least: int = LEAST, most: int = MOST) -> list[str]:
    """Pieces merged forward to `least` characters where they fit `most`; a short last one joins the one before where it fits."""
    out: list[str] = []
    for piece in split_text(text or "", most):
        if out and len(out[-1]) < least and len(out[-1]) + 2 + len(piece) <= most:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + 2 + len(out[-1]) <= most:
        last = out.pop()
        out[-1] += "\n\n" + last
    return out


def chunked(df: DataFrame, id_col: str, text_col: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id, n, text) of every passage of every text; null and empty texts have none."""
    kind = df.schema[id_col].dataType.simpleString()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, p) for i, t in zip(pdf[id_col], pdf[text_col]) for n, p in enumerate(passages(t, least, most), 1)]
            yield pd.DataFrame(rows, columns=[id_col, "n", "text"])

    return df.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInPandas(cut_up, f"`{id_col}` {kind}, n int, text string")
