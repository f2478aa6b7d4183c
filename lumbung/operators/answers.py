"""Amounts and requirements in texts, context assembly, parsing and scoring of answers, hierarchy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as X
from .hierarchy import hierarchy

HEADING = re.compile(fixed.STATUS_HEADING)
_SECTION = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("status", T.StringType()), T.StructField("body", T.StringType())]))


def sections_of(answer: str) -> list[tuple[str, str, str]]:
    """E2 for one answer: title, status and text of each section that a status heading opens."""
    found = list(HEADING.finditer(answer))
    ends = [m.start() for m in found[1:]] + [len(answer)]
    return [(m[1].strip(), re.sub(r"\s+", " ", m[2].lower()), answer[m.start() : end]) for m, end in zip(found, ends, strict=True)]


def cleaned(answer: str, program_of) -> str:
    """X5 for one answer: cut at a forbidden trailing section; of a program's sections the first stays."""
    # Headings of sections that an answer must not have.
    tail = re.search(r"(?im)^##\s*(?:Rekomendasi\s+Tindak\s+Lanjut|Catatan\s+untuk\s+Petugas\b.*|Rekomendasi\s+Bantuan\s+Tambahan|Rekomendasi\s+Tambahan|Bantuan\s+Lain)\s*$", answer)
    if tail:
        answer = answer[: tail.start()].rstrip()
    found = list(HEADING.finditer(answer))
    seen, kept, at = set(), "", 0
    for m, end in zip(found, [m.start() for m in found[1:]] + [len(answer)], strict=True):
        program = program_of(m[1])
        if program and program in seen:
            kept = (kept + answer[at : m.start()]).rstrip() + "\n\n"
            at = end
        seen.add(program)
    return (kept + answer[at:].lstrip() if at else answer).strip()


def status_sections(answer: Column) -> Column:
    """E2."""
    return F.udf(lambda t: sections_of(t) if t else [], _SECTION, useArrow=True)(answer)


def clean_answer(answer: Column, aliases: dict[str, list[str]] = fixed.PROGRAM_ALIASES) -> Column:
    """X5."""
    table = sorted(((len(a), name, a) for name, names in aliases.items() for a in names), reverse=True)

    def program_of(title: str) -> str | None:
        low = re.sub(r"\s+", " ", title.lower())
        return next((name for _, name, a in table if a in low), None)

    return F.udf(lambda t: None if t is None else cleaned(t, program_of), T.StringType(), useArrow=True)(answer)


def amount_catalog(chunks: DataFrame, program: str, order: str, most: int = 5) -> DataFrame:
    """Each program's distinct amounts, with the first chunks that show them, at most ``most``."""
    rows = chunks.select(program, order, F.explode(F.array_distinct(X.amounts(F.col("text")))).alias("amount"))
    rank = F.row_number().over(Window.partitionBy(program, "amount").orderBy(order))
    kept = rows.withColumn("_r", rank).filter(F.col("_r") <= most)
    return kept.groupBy(program, "amount").agg(F.sort_array(F.collect_list(order)).alias("evidence")).withColumn("display", X.amount_display(F.col("amount")))


def facts(chunks: DataFrame, program: str, order: str, each: int = 4, total: int = 18, length: int = 420) -> DataFrame:
    """At most ``each`` amount facts a program and ``total`` in all of each query, equal ones once."""
    rows = chunks.filter(X.is_aid_amount(F.col("text"))).withColumn("excerpt", F.substring(X.collapse(F.col("text")), 1, length))
    once = F.row_number().over(Window.partitionBy("query_id", program, "page", F.substring("excerpt", 1, 120)).orderBy(order))
    rows = rows.withColumn("_o", once).filter("_o = 1")
    rows = rows.withColumn("_e", F.row_number().over(Window.partitionBy("query_id", program).orderBy(order))).filter(F.col("_e") <= each)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).filter(F.col("place") <= total).drop("_o", "_e")


def grouped_context(programs: DataFrame, hits: DataFrame, order: str, none: str = "(tidak ada)") -> DataFrame:
    """For each program, in the table's order, its hits' texts in order of rank, or a placeholder."""
    texts = hits.groupBy("program").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("context"))
    return programs.join(texts, "program", "left").withColumn("context", F.coalesce("context", F.lit(none)))


def flat_context(hits: DataFrame, order: str) -> DataFrame:
    """Each query's hits in order of rank, joined."""
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n\n").alias("context"))


def strip_thinking(raw: Column) -> Column:
    return X.strip(F.regexp_replace(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


#: A field with what stands before it: in quotes (to the end if they stay open) with what follows, or plain.
_CELL = r'(,|\n)("[^"]*+(?:""[^"]*+)*+(?:"[^,\n]*|\z)|(?!")[^,\n]*)'


def csv_rows(text: Column) -> Column:
    """Rows of cells of comma-separated lines: quoted cells may hold commas, line ends and doubled quotes."""
    def cell(raw: Column) -> Column:
        closed = F.regexp_replace(F.regexp_replace(raw, r'^"([^"]*+(?:""[^"]*+)*+)"(.*)$', "$1\u0000$2"), r'^"(?=[^\u0000]*$)', "")
        body, more = F.get(F.split(closed, "\u0000"), F.lit(0)), F.coalesce(F.get(F.split(closed, "\u0000"), F.lit(1)), F.lit(""))
        return F.when(F.startswith(raw, F.lit('"')), F.concat(F.regexp_replace(body, '""', '"'), more)).otherwise(raw)

    text = F.concat(F.lit("\n"), text)  # so that no match is empty, even of an empty first cell
    before, cells = F.regexp_extract_all(text, F.lit(_CELL), F.lit(1)), F.regexp_extract_all(text, F.lit(_CELL), F.lit(2))
    parts = F.zip_with(before, cells, lambda b, c: F.struct(b.alias("before"), cell(c).alias("cell")))

    def put(rows: Column, p: Column) -> Column:
        at = F.size(rows)
        longer = F.concat(F.slice(rows, 1, at - 1), F.array(F.concat(F.element_at(rows, -1), F.array(p["cell"]))))
        return F.when((p["before"] == ",") & (at > 0), longer).otherwise(F.concat(rows, F.array(F.array(p["cell"]))))

    return F.aggregate(parts, F.array().cast("array<array<string>>"), put)


def _answer_lines(raw: Column) -> Column:
    body = X.strip(F.regexp_replace(X.strip(F.regexp_replace(strip_thinking(raw), r"```(?:toon)?\s*", "")), r"`+\z", ""))
    fits = lambda x: (F.length(F.regexp_replace(x, "[^,]", "")) >= 3) & ~x.rlike(r"^(Hasil\[|Hasil \{|#)|Kategori,Nilai/Program")
    return F.filter(F.transform(F.split(body, fixed.LINE_ENDS), X.strip), fits)


def answer_rows(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """Rows of a tabular answer: category, value, status, detail and, of recommendations, rank, basis
    and reason. Lines that are headings or have fewer than three commas are skipped; a quoted cell goes
    over several lines where each has the commas."""
    rows = F.filter(csv_rows(F.array_join(_answer_lines(F.col(raw)), "\n")), lambda r: F.size(r) >= 4)
    out = answers.select(key, F.posexplode(rows).alias("row", "cells")).select(key, "row", *[X.strip(F.get("cells", F.lit(i))).alias(c) for i, c in enumerate(("category", "value", "status", "detail"))])
    return out.withColumns(_recommended(F.col("detail")))


def _recommended(detail: Column) -> dict[str, Column]:
    ranks = F.filter(F.transform(F.split(detail, r"\|"), X.strip), lambda p: F.startswith(F.lower(p), F.lit("rank:")) & p.rlike(r"\d"))
    rank = F.coalesce(F.regexp_extract(F.try_element_at(ranks, F.lit(-1)), r"(\d+)", 1).try_cast("int"), F.lit(1))
    return {"rank": rank, "basis": F.coalesce(_part(detail, "dasar hukum:"), F.lit("")), "reason": F.coalesce(_part(detail, "alasan:"), detail)}


def _part(detail: Column, name: str) -> Column:
    parts = F.filter(F.transform(F.split(detail, r"\|"), X.strip), lambda p: F.startswith(F.lower(p), F.lit(name)))
    return F.when(F.size(parts) > 0, X.strip(F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"(?s)^[^:]*:(.*)$", 1)))


def parsed_answers(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """X3 with X4: each answer as one row: summary, recommended and unsuitable (arrays of structs, in the
    answer's order), technical, json, parse_error.

    A tabular answer is routed by category: of summaries and technical advice the last stands, technical
    advice of ``null`` or ``-`` is null. An answer without any summary, recommendation or unsuitable
    program, or that does not look tabular, is read as JSON (``json``); if that fails, ``parse_error``.
    Null answers fail. No rows are shuffled: an answer is parsed where it is read.
    """
    text = strip_thinking(F.col(raw))
    tabular = text.contains("Hasil[") | text.contains("ringkasan_profil,") | (text.contains("rekomendasi,") & text.contains("program_tidak_sesuai,"))
    cells = F.transform(csv_rows(F.array_join(_answer_lines(F.col(raw)), "\n")), lambda r: F.transform(r, X.strip))
    read = answers.select(key, raw, F.when(F.coalesce(tabular, F.lit(False)), F.filter(cells, lambda r: F.size(r) >= 4)).alias("_rows"))

    def of(category: str) -> Column:
        return F.filter("_rows", lambda r: r[0] == category)

    def last(category: str) -> Column:
        return F.get(F.try_element_at(of(category), F.lit(-1)), F.lit(3))

    def recommended(r: Column) -> Column:
        c = _recommended(r[3])
        return F.struct(c["rank"].alias("rank"), r[1].alias("program"), r[2].alias("status"), c["basis"].alias("basis"), c["reason"].alias("reason"))

    def unsuitable(r: Column) -> Column:
        why = F.when(F.lower(r[3]).startswith("alasan:"), X.strip(F.regexp_extract(r[3], r"(?s)^[^:]*:(.*)$", 1))).otherwise(r[3])
        return F.struct(r[1].alias("program"), r[2].alias("status"), why.alias("reason"))

    technical = last("rekomendasi_teknis_bansos")
    routed = read.select(
        key, raw, F.coalesce(last("ringkasan_profil"), F.lit("")).alias("summary"), F.coalesce(F.transform(of("rekomendasi"), recommended), F.array()).alias("recommended"),
        F.when(~F.lower(technical).isin("", "null", "-"), technical).alias("technical"), F.coalesce(F.transform(of("program_tidak_sesuai"), unsuitable), F.array()).alias("unsuitable"),
    )
    filled = (F.col("summary") != "") | (F.size("recommended") > 0) | (F.size("unsuitable") > 0)
    routed = routed.withColumn("_filled", filled).withColumn("json", F.when(~F.col("_filled"), json_block(F.col(raw))))
    kept = [F.when(F.col("_filled"), F.col(c)).alias(c) for c in ("summary", "recommended", "technical", "unsuitable")]
    return routed.select(key, *kept, "json", (~F.col("_filled") & F.col("json").isNull()).alias("parse_error"))


def json_block(raw: Column) -> Column:
    """The JSON of an answer: the whole without fences, else from the first to the last brace, else null."""
    body = X.strip(F.regexp_replace(strip_thinking(raw), r"```(?:json)?\s*|`+\s*\z", ""))
    block = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(X.whole_json(body).isNotNull(), body).when(X.whole_json(block).isNotNull(), block)


def chat_content(response: Column) -> Column:
    """The text of the first choice of a chat response, null if it has none."""
    v = X.whole_json(response)
    here = F.schema_of_variant(F.try_variant_get(v, "$.choices[0].message.content", "variant")) == "STRING"
    return F.when(here, F.try_variant_get(v, "$.choices[0].message.content", "string"))


def flat_spec(spec: Column) -> Column:
    """A map as ``K: v; K: v``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(spec)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def detected_status(text: Column, aliases: list[str], before: int = 220, after: int = 420) -> Column:
    """The worst status spoken of around any alias in a normalised answer; missing without one."""
    order = F.array(*map(F.lit, ("tidak_eligible", "mungkin_eligible", "eligible", "unknown")))

    def worst(t: Column, alias: str) -> Column:
        """Least rank around the alias, by one pass over the pieces between; each but the last ends at one."""
        def step(s: Column, piece: Column) -> Column:
            end = s["end"] + F.length(piece)
            near = F.substring(t, F.greatest(end - before, F.lit(0)) + 1, F.least(end, F.lit(before)) + after)
            return F.struct((end + len(alias)).alias("end"), F.least(s["rank"], F.array_position(order, X.window_status(near))).alias("rank"))

        pieces = F.split(t, re.escape(alias), -1)
        first = F.struct(F.lit(0).alias("end"), F.lit(None).cast("long").alias("rank"))
        ranked = X.let(pieces, lambda p: F.aggregate(F.slice(p, 1, F.size(p) - 1), first, step, lambda s: s["rank"]))
        return F.when(F.contains(t, F.lit(alias)), ranked)

    found = X.let(text, lambda t: F.array_min(F.array(*[worst(t, a) for a in aliases])))
    return F.coalesce(F.get(order, found.cast("int") - 1), F.lit("missing"))


def headed_parts(answer: Column, heading: str) -> Column:
    """Parts of an answer that a heading opens, each up to the next: array<struct<head, body>> where
    ``head`` lists the heading's groups."""
    flags, pattern = re.match(r"(\(\?\w+\))(.*)", heading).groups()
    parts = F.filter(F.split(answer, f"{flags}(?={pattern})", -1), lambda x: x.rlike(rf"\A{heading}"))
    return F.transform(parts, lambda x: F.struct(F.array(*[F.regexp_extract(x, heading, i) for i in range(1, re.compile(heading).groups + 1)]).alias("head"), x.alias("body")))


def stated_sections(answers: DataFrame, aliases: dict[str, list[str]] = fixed.PROGRAM_ALIASES) -> DataFrame:
    """(case_id, program, status, section) for the programs that headings of each answer (case_id,
    answer) name: the last heading with a status; else the first plain heading whose text states a decision
    or speaks of a status. ``section`` is the heading's part of the answer."""
    def found(heading: str) -> DataFrame:
        rows = answers.select("case_id", F.posexplode(headed_parts(F.col("answer"), heading)).alias("at", "part"))
        return rows.select("case_id", "at", X.program_name(F.col("part.head")[0], aliases).alias("program"), "part").filter("program is not null")

    headed = found(fixed.STATUS_HEADING).withColumn("status", X.canonical_status(F.col("part.head")[1]))
    headed = headed.groupBy("case_id", "program").agg(F.max_by("status", "at").alias("headed"), F.max_by("part.body", "at").alias("headed_section"))
    plain = found(fixed.PLAIN_HEADING).withColumn("text", X.evaluator_text(F.col("part.body")))
    said = F.regexp_extract("text", fixed.DECISION, 1)
    plain = plain.withColumn("status", F.when(said != "", X.canonical_status(said)).otherwise(X.window_status(F.col("text")))).filter("status != 'unknown'")
    plain = plain.groupBy("case_id", "program").agg(F.min_by("status", "at").alias("plain"), F.min_by("part.body", "at").alias("plain_section"))
    both = headed.join(plain, ["case_id", "program"], "full")
    return both.select("case_id", "program", F.coalesce("headed", "plain").alias("status"), F.coalesce("headed_section", "plain_section").alias("section"))


def program_statuses(answers: DataFrame, aliases: dict[str, list[str]] = fixed.PROGRAM_ALIASES) -> DataFrame:
    """(case_id, program, status, section) for every program of each answer (case_id, answer).

    A program's status is that of :func:`stated_sections`; without one, the worst status spoken of around
    its aliases; ``missing`` if it is not named at all. ``section`` is null without a heading. An answer is
    never compared with another: all that moves is a row for each heading.
    """
    def around(text: Column) -> Column:
        return F.array(*[F.struct(F.lit(name).alias("program"), detected_status(text, names).alias("spoken")) for name, names in aliases.items()])

    spoken = X.let(X.evaluator_text(F.col("answer")), around)
    out = answers.select("case_id", F.explode_outer(spoken).alias("x")).select("case_id", "x.*").join(stated_sections(answers, aliases), ["case_id", "program"], "left")
    return out.select("case_id", "program", F.coalesce("status", "spoken").alias("status"), "section")


def evidence_score(answers: DataFrame, needs: DataFrame) -> DataFrame:
    """(case_id, score) of each answer: the share of its needs (case_id, source_contains, page_number)
    of which the answer names the source and cites the page, anywhere; 1 without needs."""
    text = answers.select("case_id", X.evaluator_text(F.col("answer")).alias("text"))
    met = F.contains("text", X.evaluator_text(F.col("source_contains"))) & X.cites_page(F.col("text"), F.col("page_number"))
    shares = needs.join(text, "case_id").groupBy("case_id").agg(F.avg(met.cast("int")).alias("share"))
    return answers.select("case_id").join(shares, "case_id", "left").select("case_id", F.coalesce("share", F.lit(1.0)).alias("score"))


def overall(status: Column, evidence: Column, contract: Column, nominal: Column) -> Column:
    """The weighted score."""
    return 0.40 * status + 0.30 * evidence + 0.20 * contract + 0.10 * nominal


def contract_score(headings: DataFrame, expected: DataFrame, answers: DataFrame) -> DataFrame:
    """(programs with exactly one heading + no unknown heading + no forbidden section) / (n + 2)."""
    counts = headings.groupBy("case_id", "program").agg(F.count("*").alias("n"))
    unknown = headings.groupBy("case_id").agg(F.count_if(F.col("program").isNull()).alias("unknown"))
    met = expected.join(counts, ["case_id", "program"], "left").groupBy("case_id").agg(F.count_if(F.col("n") == 1).alias("once"), F.count("*").alias("all"))
    tail = X.contains_any(X.evaluator_text(F.col("answer")), fixed.FORBIDDEN_SECTIONS)
    out = answers.select("case_id", (~tail).cast("int").alias("tail")).join(met, "case_id", "left").join(unknown, "case_id", "left")
    none = (F.coalesce("unknown", F.lit(0)) == 0).cast("int")
    return out.select("case_id", ((F.coalesce("once", F.lit(0)) + none + F.col("tail")) / (F.coalesce("all", F.lit(0)) + 2)).alias("contract_score"))


def nominal_score(found: Column, allowed: Column, denied: Column) -> Column:
    """E8 for one section: 0 for an amount not allowed or a denial of any; else the share of those allowed
    that are found; without allowed ones, 1 if none is found."""
    extra = F.size(F.array_except(found, allowed)) > 0
    share = F.size(F.array_intersect(found, allowed)) / F.size(allowed)
    return F.when(extra, 0.0).when(F.size(allowed) == 0, 1.0).when(denied, 0.0).otherwise(share)


def nominal_scores(answers: DataFrame, catalog: DataFrame, aliases: dict[str, list[str]] = fixed.PROGRAM_ALIASES) -> DataFrame:
    """case_id, score, checks and failed of each answer (case_id, answer), from a catalog (program, amount).

    The sections that :func:`stated_sections` finds meet the catalog by program. Only sections of
    programs said to be eligible, or perhaps so, are scored; an answer's score is their mean, 1 without
    any. ``failed`` lists unsupported and missing amounts and denials, by program. A program that the
    catalog lacks allows no amount; with an empty catalog every answer scores 1.
    """
    sections = stated_sections(answers, aliases).filter(F.col("status").isin("eligible", "mungkin_eligible"))
    allowed = catalog.groupBy("program").agg(F.sort_array(F.collect_set("amount")).alias("allowed"))
    denied = F.lit(False)
    for words in ("nominal tidak tersebut", "nominal tidak disebut", "nominal tidak ditemukan"):
        denied |= X.evaluator_text(F.col("section")).contains(words)
    met = sections.withColumn("found", F.array_distinct(X.amounts(F.col("section")))).withColumn("denied", denied).join(allowed, "program", "left")
    met = met.withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))

    def told(amounts: Column, what: str) -> Column:
        return F.transform(F.array_sort(amounts), lambda a: F.concat(F.lit("nominal:"), F.col("program"), F.lit(f":{what}_"), a))

    contradicts = F.when(F.col("denied") & (F.size("allowed") > 0), F.array(F.concat(F.lit("nominal:"), "program", F.lit(":contradiction")))).otherwise(F.array().cast("array<string>"))
    failed = F.concat(told(F.array_except("found", "allowed"), "unsupported"), told(F.array_except("allowed", "found"), "missing"), contradicts)
    met = met.select("case_id", "program", nominal_score(F.col("found"), F.col("allowed"), F.col("denied")).alias("s"), failed.alias("f"))
    by_case = met.groupBy("case_id").agg(F.avg("s").alias("s"), F.count(F.lit(1)).alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("program", "f"))), lambda x: x["f"])).alias("f"))
    known = not catalog.isEmpty()
    out = answers.select("case_id").join(by_case if known else by_case.limit(0), "case_id", "left")
    return out.select("case_id", F.coalesce("s", F.lit(1.0)).alias("score"), F.coalesce("n", F.lit(0)).alias("checks"), F.coalesce("f", F.array().cast("array<string>")).alias("failed"))


def hierarchy_fill(lines: DataFrame, document: str, order: str) -> DataFrame:
    """H-simple: each line's chapter, article and clause by filling forward; a chapter resets the articles
    below it and an article the clauses."""
    c = lines.withColumn("_c", X.line_class(F.col("line")))
    upto = Window.partitionBy(document).orderBy(order)
    level, label = F.col("_c.level"), F.col("_c.label")
    c = c.withColumn("chapter", F.last(F.when(level == "bab", label), ignorenulls=True).over(upto)).withColumn("_b", F.count_if(level == "bab").over(upto))
    in_chapter = Window.partitionBy(document, "_b").orderBy(order)
    article = level.isin("pasal", "diktum")
    c = c.withColumn("article", F.last(F.when(article, label), ignorenulls=True).over(in_chapter)).withColumn("_a", F.count_if(article).over(in_chapter))
    in_article = Window.partitionBy(document, "_b", "_a").orderBy(order)
    return c.withColumn("clause", F.last(F.when(level == "ayat", label), ignorenulls=True).over(in_article)).withColumn("level", level).drop("_c", "_b", "_a")


def embedded_ordinals(line: Column, ordinals: list[str] = fixed.ORDINALS) -> Column:
    """H2: a line cut before an ordinal and colon that follow a full stop."""
    names = "|".join(sorted(ordinals, key=len, reverse=True))
    return F.transform(F.split(line, rf"(?i)(?<=\.)\s+(?=(?:DIKTUM|Pasal)?\s*(?:{names})\s*:)"), X.strip)


def flushed(text: Column) -> Column:
    """H5: a buffer's text: cut marks go, white space collapses, the closing formula and what follows go."""
    t = X.collapse(F.regexp_replace(text, r"\s*\.\s*\.\s*\.\s*", " "))
    return F.when(t.rlike(fixed.CLOSING), F.regexp_replace(F.regexp_extract(t, rf"(?s)^(.*?){fixed.CLOSING}", 1), r"[ .,;]+\z", "")).otherwise(t)


def chapter_title(text: Column, small: list[str] = fixed.SMALL_WORDS) -> Column:
    """H9: a chapter's title with capitals, small words after the first in lower case."""
    head, rest = (F.regexp_extract(text, r"^(BAB\s+[IVXLCDM]+)\s*[–\-—]\s*(.*)", i) for i in (1, 2))
    words = F.split(X.collapse(rest), " ")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(small), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))))
    return F.when(head != "", F.concat(head, F.lit(" – "), F.array_join(cased, " "))).otherwise(text)


def document_units(lines: DataFrame, ordinals: list[str] = fixed.ORDINALS) -> DataFrame:
    """H2, H4, H9, H5, T2, T1 and H6 in this order: the rows of whole documents, as they are stored.

    ``lines`` has document, page, line_no and line. Lines are cut before embedded ordinals, units are
    parsed, chapters get their capitals, texts are flushed, and those of fewer than three characters go.
    Rows are numbered from 1 in each document; ``content`` is the text with abbreviations written out
    behind ``[document | context]``. Null lines count as empty; an empty table gives no rows.
    """
    names = "|".join(sorted(ordinals, key=len, reverse=True))
    cut = embedded_ordinals(F.coalesce("line", F.lit("")), ordinals)
    # A part cut off starts with its bare ordinal; the line's own start stays as it is.
    marked = F.transform(cut, lambda x, i: F.when(i > 0, F.regexp_replace(x, rf"(?i)^(?:DIKTUM|Pasal)?\s*({names})\s*:\s*", "$1 : ")).otherwise(x))
    units = hierarchy(lines.select("document", "page", "line_no", F.posexplode(marked).alias("part", "line")))
    units = units.withColumn("text", flushed(F.col("text"))).withColumn("chapter", chapter_title(F.col("chapter"))).filter(F.length("text") >= 3)
    units = units.withColumn("row", F.row_number().over(Window.partitionBy("document").orderBy("row")))
    path = X.context_path(F.col("chapter"), F.col("article"), F.col("clause"))
    prefix = F.concat(F.lit("["), "document", F.lit(" | "), path, F.lit("] "))
    return units.withColumn("content", F.concat(prefix, X.collapse(X.expand_abbreviations(F.col("text")))))


def expected_statuses(cases: DataFrame) -> DataFrame:
    """(case_id, program, status) from a map of status to programs; a later status overrides."""
    order = F.array(*map(F.lit, ("eligible", "mungkin_eligible", "tidak_eligible")))
    rows = cases.select("case_id", F.explode("programs").alias("status", "names")).select("case_id", "status", F.explode("names").alias("program"))
    return rows.groupBy("case_id", "program").agg(F.max_by("status", F.array_position(order, F.col("status"))).alias("status"))


def selected_cases(cases: DataFrame, ids: list[str] | None, limit: int | None) -> DataFrame:
    """Cases by id, then the first few; a repeated id ends the query."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    checked = cases.withColumn("case_id", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated case "), F.col("case_id").cast("string")))).otherwise(F.col("case_id")))
    checked = checked.filter(F.col("case_id").isin(ids)) if ids is not None else checked
    return checked.orderBy("case_id").limit(limit) if limit is not None else checked
