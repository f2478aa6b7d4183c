"""Units of legal documents: lines classified by columns, and a table of what each class does in each mode."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X

_UNITS = "document string, row int, text string, chapter string, article string, clause string, page long"
#: What a class of lines is to the table.
_SYMBOLS = {"bab": "chapter", "bagian": "part", "pasal": "article", "diktum": "decree", "ayat": "clause", "huruf": "item", "none": "plain"}


def classified(lines: DataFrame, ordinals: list[str] = fixed.ORDINALS) -> DataFrame:
    """H1, H3: lines (column ``line``) that are not blank, noise, page breaks or introductions, with what
    the table of modes asks: symbol, label, rest, ``number`` of an article's ordinal (0: none), ``open``
    if the line ends without a mark, ``leading`` if it ends in a connecting word. Digits of a clause whose
    bracket was misread are mended. The order in force compares the last words of labels, so a two-word
    ordinal counts by its second."""
    line = X.strip(F.regexp_replace(X.strip(F.col("line")), r"^\((\d+)[1lI|\]\}\)]\s+", "($1) "))
    others = [c for c in lines.columns if c != "line"]
    # explode() over one struct: the line is mended once, and no filter is pushed through it.
    own = lines.select(*others, F.explode(F.array(F.struct(line.alias("line")))).alias("_l")).select(*others, "_l.line").filter(F.coalesce(F.col("line") != "", F.lit(False)))
    stop = F.col("line").rlike(fixed.STOP_LINE)
    dull = X.is_noise_line(F.col("line")) | F.col("line").rlike(fixed.PAGE_BREAK) | F.col("line").rlike(fixed.INTRO_LINE)
    table = F.create_map(*[F.lit(x) for kv in _SYMBOLS.items() for x in kv])
    numbers = F.create_map(*[x for i, name in enumerate(ordinals) for x in (F.lit(name), F.lit(i + 1))])
    own = own.withColumn("_stop", stop).filter(F.col("_stop") | ~dull).withColumn("_c", X.line_class(F.col("line"), ordinals))
    symbol = F.when(F.col("_stop"), "stop").when(F.col("line").rlike(fixed.PREAMBLE_LINE), "preamble").otherwise(table[F.col("_c.level")])
    last_word = F.upper(F.regexp_extract("_c.label", r"(\S+)$", 1))
    return own.select(
        *others, "line", symbol.alias("symbol"), F.col("_c.label").alias("label"), F.col("_c.rest").alias("rest"), F.coalesce(F.try_element_at(numbers, last_word), F.lit(0)).alias("number"),
        (~F.col("line").rlike(r"[.;:]$")).alias("open"), F.lower("line").rlike(f"(?:{'|'.join(fixed.CONNECTORS)})$").alias("leading"),
    )


class _Act(NamedTuple):
    """The mode after a line, and what it does: ends the unit held, names a level, holds a text."""

    mode: str
    ends: bool = False
    names: str = ""
    holds: str = ""


#: For each mode what each symbol does. ``before``: nothing counts until a heading; ``title``: lines go to
#: the chapter's title; ``body``: lines are held; ``pass``: the next line of any kind is passed over.
_ARTICLE, _DECREE = _Act("body", True, "article", "rest"), _Act("body", True, "decree", "rest")
MODES: dict[str, dict[str, _Act]] = {
    "before": {"chapter": _Act("body", True, "chapter"), "part": _Act("pass"), "article": _ARTICLE, "decree": _DECREE, "preamble": _Act("before"), "clause": _Act("before"), "item": _Act("before"), "plain": _Act("before")},
    "title": {"chapter": _Act("title", holds="title"), "part": _Act("pass"), "article": _ARTICLE, "decree": _Act("title", holds="title"), "preamble": _Act("title"), "clause": _Act("title", holds="title"), "item": _Act("title", holds="title"), "plain": _Act("title", holds="title")},
    "body": {"chapter": _Act("body", True, "chapter"), "part": _Act("pass"), "article": _ARTICLE, "decree": _DECREE, "preamble": _Act("before"), "clause": _Act("body", True, "clause", "rest"), "item": _Act("body", holds="line"), "plain": _Act("body", holds="plain")},
}


class _Walk:
    """One document on its way through its lines: the mode, the names in force and the texts held."""

    def __init__(self) -> None:
        self.mode, self.units = "before", []
        self.names = {"chapter": "", "article": "", "clause": ""}
        self.decreed, self.number = False, 0
        self.held: list[dict] = []

    def read(self, line: dict) -> None:
        if self.mode == "pass":
            self.mode = "body"
            return
        act = MODES[self.mode][self._symbol(line)]
        if act.ends:
            self.end()
        if act.names:
            self._name(act.names, line)
        if act.holds == "title":
            joint = " " if " – " in self.names["chapter"] else " – "
            self.names["chapter"] += joint + line["line"]
        elif act.holds:
            text = {"rest": line["rest"], "line": line["line"], "plain": line["line"].lstrip(".: \t\r\n\x0b\x0c")}[act.holds]
            if text:
                self.held.append({**line, "text": text})
        self.mode = "title" if act.names == "chapter" and not line["rest"] else act.mode

    def _symbol(self, line: dict) -> str:
        """The line's symbol, unless what is held makes a heading text, or a decree a clause."""
        symbol, last = line["symbol"], self.held[-1] if self.held else None
        if symbol == "clause":
            return "plain" if last and last["open"] else "item" if self.decreed and self.mode == "body" else symbol
        if symbol in ("article", "decree") and ((last and last["leading"]) or 0 < line["number"] <= self.number):
            return "plain"
        return symbol

    def _name(self, level: str, line: dict) -> None:
        if level == "chapter":
            self.names = {"chapter": line["label"] + (f" – {line['rest']}" if line["rest"] else ""), "article": "", "clause": ""}
            self.decreed, self.number = False, 0
        elif level == "clause":
            self.names["clause"] = line["label"]
        else:
            self.names |= {"article": line["label"].removeprefix("Pasal ").removeprefix("Diktum "), "clause": ""}
            self.decreed, self.number = level == "decree", line["number"]

    def end(self) -> None:
        text = " ".join(x["text"] for x in self.held).strip()
        if text:
            self.units.append({"text": text, **self.names, "page": self.held[0]["page"]})
        self.held = []


def hierarchy(lines: DataFrame, ordinals: list[str] = fixed.ORDINALS) -> DataFrame:
    """H4: units of documents from lines (document, page, line_no, line, and part where lines were cut).

    Lines are classified and thinned out by columns; what moves is what counts. A document is read in
    order by one task, since its modes feed back through the texts held: a clause is text while the text
    held does not end in a mark; a heading after a connecting word is text, and so is one whose ordinal
    does not rise. A task reads one document after the other and holds one's units. A stop line ends the
    document. Documents without a heading have no units.
    """
    order = [c for c in ("page", "line_no", "part") if c in lines.columns]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, done, stopped, out = None, None, False, []

        def close() -> None:
            done.end()
            out.extend({"document": document, "row": i + 1, **u} for i, u in enumerate(done.units))

        for batch in batches:
            for line in batch.to_pylist():
                if done is None or line["document"] != document:
                    if done is not None:
                        close()
                    document, done, stopped = line["document"], _Walk(), False
                stopped = stopped or line["symbol"] == "stop"
                if not stopped:
                    done.read(line)
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                out.clear()
        if done is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    found = classified(lines.withColumn("page", F.col("page").cast("long")), ordinals)
    dealt = found.repartition("document").sortWithinPartitions("document", *[F.asc_nulls_last(c) for c in order])
    return dealt.mapInArrow(walk, _UNITS)


_SCHEMA = pa.schema([("document", pa.string()), ("row", pa.int32()), ("text", pa.string()), ("chapter", pa.string()), ("article", pa.string()), ("clause", pa.string()), ("page", pa.int64())])
