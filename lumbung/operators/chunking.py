"""Chunking: recursive and fixed splits, caps, tails, carries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

#: Separators from coarse to fine; a piece keeps the separator before it.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """C1 for one text. Cut at the coarsest separator that occurs; pieces join up to ``size``, and each
    chunk starts with whole pieces of the one before of at most ``overlap`` characters. A piece that is
    too long is cut by the finer separators; one without any stays whole."""
    here = next((i for i, s in enumerate(separators) if s in text), None)
    if here is None:
        return [text.strip()] if text.strip() else []
    sep, finer = separators[here], separators[here + 1 :]
    head, *rest = text.split(sep)
    pieces = [p for p in [head, *(sep + r for r in rest)] if p]
    chunks: list[str] = []
    window: list[str] = []
    held = 0

    def emit() -> None:
        if joined := "".join(window).strip():
            chunks.append(joined)

    for piece in pieces:
        if len(piece) >= size:
            emit()
            window, held = [], 0
            chunks += split_text(piece, size, overlap, finer) if finer else [piece.strip()]
            continue
        if held + len(piece) > size and window:
            emit()
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    emit()
    return chunks


def cap_text(text: str, cap: int) -> list[str]:
    """C3 for one text: cut at the last line end before ``cap``, else the last space, else there."""
    out = []
    while len(text) > cap:
        at = max(text.rfind("\n", 0, cap), 0) or max(text.rfind(" ", 0, cap), 0) or cap
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [*out, text] if text else out


def tail_text(text: str, limit: int) -> str:
    """C5 for one text: the last whole sentences that fit, at least one; all of a text that fits."""
    if len(text) <= limit:
        return text
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n\n|\n", text[-2 * limit :])]
    sentences = [s for s in sentences if s]
    if not sentences:
        last = text[-limit:]
        return last[last.rfind(" ") + 1 :]
    taken, total = [], 0
    while sentences and total + len(sentences[-1]) + 1 <= limit:
        total += len(sentences[-1]) + 1
        taken.append(sentences.pop())
    return " ".join(reversed(taken)) if taken else sentences[-1]


def recursive_split(text: Column, size: int = 2000, overlap: int = 500) -> Column:
    """Array of chunks; a null text has none."""
    return F.udf(lambda t: split_text(t, size, overlap) if t else [], T.ArrayType(T.StringType()), useArrow=True)(text)


def hard_cap(text: Column, cap: int = 2000) -> Column:
    """C3."""
    return F.udf(lambda t: cap_text(t, cap) if t else [], T.ArrayType(T.StringType()), useArrow=True)(text)


def page_tail(text: Column, limit: int = 200) -> Column:
    """C5."""
    return F.udf(lambda t: None if t is None else tail_text(t, limit), T.StringType(), useArrow=True)(text)


def fixed_split(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def merge_small(parts: Column, least: int = 180) -> Column:
    """C4: a part shorter than ``least`` joins the one before it on a new line; blanks go."""
    empty = F.array().cast("array<string>")

    def add(done: Column, part: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n"), part)))
        return F.when(part == "", done).when((F.size(done) > 0) & (F.length(part) < least), joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(F.transform(parts, strip), empty, add)


def carry_tails(pages: DataFrame, document: str, page: str, limit: int = 200) -> DataFrame:
    """Each page's text after the tail of the page before, if both are native (``complex`` false)."""
    tail = F.when(~F.col("complex"), page_tail(F.col("text"), limit))
    marked = pages.withColumn("_tail", tail)
    before = F.lag("_tail").over(Window.partitionBy(document).orderBy(page))
    marked = marked.withColumn("_before", before)
    carried = F.when(~F.col("complex") & F.col("_before").isNotNull() & (F.col("_before") != ""), F.concat("_before", F.lit("\n"), "text")).otherwise(F.col("text"))
    return marked.withColumn("carried", carried).drop("_tail", "_before")


def complex_reasons(length: Column, tables: Column, drawings: Column, images: Column, ratio: float = 50.0) -> Column:
    """Why a page needs more than its text; empty for a page that does not."""
    elements = drawings + images
    share = length / F.greatest(elements, F.lit(1))
    reasons = F.array(
        F.when(tables > 0, F.concat(tables.cast("string"), F.lit(" Tabel"))), F.when(drawings > 40, F.concat(drawings.cast("string"), F.lit(" Drawings"))),
        F.when(length < 200, F.concat(F.lit("Teks minim ("), length.cast("string"), F.lit(" char)"))), F.when((length < 800) & (images > 0), F.lit("Gambar + Teks Sedikit")),
        F.when((elements > 3) & (share < ratio), F.concat(F.lit("Rasio Rendah ("), F.format_number(share, 1), F.lit(")"))),
    )
    return F.filter(reasons, lambda r: r.isNotNull())
