"""Column functions over text: normalisation, keywords, flags, amounts, line classes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space as Python has it, for Java's regular expressions.
WS = r"(?U)[\s\x1c-\x1f]"
#: The same characters one by one, for trimming.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space other than one blank.
_RUN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, _RUN, " "), F.lit(" "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased, collapsed text."""
    return F.sha2(collapse(F.lower(text)), 256)


def uuid5(text: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Version 5 UUID of a text in a namespace (hexadecimal; the DNS namespace by default)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), text.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, case ignored."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def strip_fences(text: Column) -> Column:
    """T4: markdown fences, lone stars and title or content labels go, in this order."""
    steps = [
        (r"(?i)\A```(?:markdown|json|text)?\s*\n?", ""), None, (r"\n?\s*```\s*\z", ""), (r"(?m)^\s*```(?:markdown|json|text)?\s*$", ""), (r"(?m)^\s*```\s*$", ""), (r"(?m)^\s*\*\*\s*$", ""),
        (r"\*\*JUDUL\*\*:\s*(.*?)\n\n\*\*KONTEN\*\*:\s*\n", "$1\n\n"), (r"\*\*JUDUL\*\*:\s*(.*?)\n", "$1\n"), (r"\*\*KONTEN\*\*:\s*\n?", ""), (r"\[JUDUL\]:\s*(.*?)\n", "$1\n"), (r"\[KONTEN\]:\s*\n?", ""),
    ]
    out = strip(text)
    for step in steps:
        out = strip(out) if step is None else F.regexp_replace(out, *step)
    marked = text.contains("```") | text.contains("**") | text.contains("[JUDUL]") | text.contains("[KONTEN]")
    return F.when(marked, strip(out)).otherwise(strip(text))  # without these no step finds anything


def strip_backticks(text: Column) -> Column:
    """T5: fences and backtick triples go wherever they stand."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?i)```(?:markdown|json|text|python)?\n?", ""), "```", ""))


def clean_title(title: Column, empty: list[str] = fixed.EMPTY_TITLES) -> Column:
    """Outer marks go; a number or a title that says nothing is empty."""
    t = strip(F.regexp_replace(collapse(F.coalesce(title, F.lit(""))), r"^[#*\s]+|[#*\s]+$", ""))
    return F.when(t.rlike(r"^\d+\s*$") | F.lower(t).isin(empty), "").otherwise(t)


def is_error_row(text: Column, title: Column, failed_text: str = fixed.FAILED_TEXT, failed_title: str = fixed.FAILED_TITLE) -> Column:
    """T7."""
    return F.coalesce(F.contains(text, F.lit(failed_text)), F.lit(False)) | F.coalesce(title == failed_title, F.lit(False))


def skip_subchunk(text: Column, policy: list[str] = fixed.POLICY_PATTERNS) -> Column:
    """Under 20 characters, only digits and marks, or under 80 without a policy signal."""
    return let(collapse(text), lambda t: (F.length(t) < 20) | t.rlike(r"^[\d\s.,:/()\-]+$") | ((F.length(t) < 80) & ~matches_any(t, policy)))


def keyword_hit(lower: Column, keyword: str, whole: list[str] = fixed.WHOLE_WORDS) -> Column:
    """A keyword is found as a substring, a short one in ``whole`` as a word (``rp`` with a dot or not)."""
    compact = re.sub("[^a-z0-9]", "", keyword.lower())
    if compact in whole:
        return lower.rlike(rf"\b{compact}\.?\b" if compact == "rp" else rf"\b{compact}\b")
    return F.contains(lower, F.lit(keyword.lower().strip()))


def _hits(lower: Column, keywords: list[str], whole: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [keyword_hit(lower, k, whole).cast("int") for k in keywords], F.lit(0))


def keyword_score(text: Column, strong: list[str], weak: list[str], whole: list[str] = fixed.WHOLE_WORDS) -> Column:
    """Two points for each strong keyword found, one for each weak one."""
    lower = F.lower(text)
    return 2 * _hits(lower, strong, whole) + _hits(lower, weak, whole)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once for each row, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def classify(text: Column, types: dict = fixed.CONTENT_TYPES, whole: list[str] = fixed.WHOLE_WORDS, guards: bool = True) -> Column:
    """The types of a text in order of priority, or the one that says none.

    A type needs two points, and two weak keywords if it has no strong one. The guards: a preface needs
    concrete hints to be about criteria; an amount label needs money; a form needs three weak words.
    """
    def labels(low: Column, hits: Column) -> Column:
        found = []
        for i, name in enumerate(types):
            s, w = hits[2 * i], hits[2 * i + 1]
            ok = (2 * s + w >= 2) & ((s > 0) | (w >= 2))
            if guards and name == "kriteria_penerima":
                ok &= (s > 0) | ~contains_any(low, fixed.INTRO_HINTS) | contains_any(low, fixed.CONCRETE_HINTS)
            elif guards and name == "nominal_bantuan":
                ok &= matches_any(text, fixed.MONEY_PATTERNS)
            elif guards and name == "lampiran_formulir":
                ok &= (s > 0) | (w >= 3)
            found.append(F.when(ok, F.lit(name)))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    def hits(low: Column) -> Column:
        return F.array(*[_hits(low, words, whole) for pair in types.values() for words in pair])

    found = bound(F.lower(text), lambda low: bound(hits(low), lambda h: labels(low, h)))
    return bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(fixed.NO_TYPE))))


def classify_plain(text: Column, types: dict = fixed.CONTENT_TYPES) -> Column:
    """The older classifier: substrings only, two points, no guards."""
    lower = F.lower(text)
    found = [F.when(2 * _hits(lower, strong, []) + _hits(lower, weak, []) >= 2, F.lit(name)) for name, (strong, weak) in types.items()]
    labels = F.filter(F.array(*found), lambda x: x.isNotNull())
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(fixed.NO_TYPE)))


def quality_flags(text: Column, labels: Column, policy: list[str] = fixed.POLICY_PATTERNS) -> Column:
    """Short, fragment, type unknown, weak policy signal."""
    def told(t: Column) -> Column:
        words = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
        return F.array(
            F.when(F.length(t) < 220, "pendek"), F.when(words < 20, "fragmen"),
            F.when((F.size(labels) == 1) & (labels[0] == fixed.NO_TYPE), "tipe_tidak_terdeteksi"), F.when(~matches_any(t, policy), "sinyal_kebijakan_lemah"),
        )

    return F.filter(let(collapse(text), told), lambda x: x.isNotNull())


def priority(flags: Column) -> Column:
    """T14."""
    return F.when(F.size(flags) > 0, "low").otherwise("normal")


def whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null otherwise.

    ``try_parse_json`` alone stops after the first value and takes ``{} }`` or ``{} x``. Only the end of
    the text closes both a list and an object around it.
    """
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull(), F.try_variant_get(held, "$.v", "variant"))


def context_prefix(text: Column, label: Column, page: Column, title: Column, dull: list[str] = fixed.UNPREFIXED_TITLES) -> Column:
    """``[Sumber: label | Hal. page | title]`` and a line end, unless the text starts like that."""
    t = strip(F.coalesce(title, F.lit("")))
    t = F.when(t.rlike(r"^\d+\s*$") | t.isin(dull), "").otherwise(F.concat(F.lit(" | "), t))
    prefix = F.concat(F.lit("[Sumber: "), label, F.lit(" | Hal. "), F.coalesce(page.cast("string"), F.lit("?")), t, F.lit("]\n"))
    return F.when(F.startswith(text, F.lit("[Sumber:")), text).otherwise(F.concat(prefix, text))


def augment(text: Column, program: Column, rules: list = fixed.AUGMENT_RULES, tags: dict = fixed.PROGRAM_TAGS) -> Column:
    """Distinct tags of the patterns found and of the program, sorted, on a line of their own."""
    found = [F.when(text.rlike(f"(?i){p}"), F.lit(tag)) for p, tag in rules] + [F.when(program == name, F.lit(tag)) for name, tag in tags.items()]
    kept = F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return F.when(F.size(kept) > 0, F.concat(text, F.lit("\n"), F.array_join(kept, " "))).otherwise(text)


def expand_abbreviations(text: Column, table: dict[str, str] = fixed.ABBREVIATIONS) -> Column:
    """Whole-word, case-sensitive abbreviations become ``Long (ABBR)`` in one pass.

    The text is cut at every abbreviation found; expansions are put between the cuts, so that an
    abbreviation inside an expansion is not expanded again.
    """
    keys = "|".join(map(re.escape, table))
    pattern = rf"\b(?:{keys})\b"
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(rf"\b({keys})\b"), F.lit(1))
    longs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, f"{v} ({k})")])
    expanded = F.transform(found, lambda k: F.try_element_at(longs, k))
    return F.array_join(F.zip_with(pieces, expanded, lambda p, e: F.concat(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit("")))), "")


def evaluator_text(text: Column) -> Column:
    """Lower case, underscores to spaces, long dashes to hyphens, white space collapsed."""
    return collapse(F.translate(F.lower(text), "_—–", " --"))


def amounts(text: Column) -> Column:
    """Digit strings of the amounts, in order. Digits after white space join; ``,00`` stays in them."""
    raw = F.regexp_extract_all(text, F.lit(fixed.AMOUNT), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"\D", "")), lambda x: x != "")


def amount_display(digits: Column) -> Column:
    """Dots between thousands."""
    return F.translate(F.format_number(digits.cast("decimal(38,0)"), 0), ",", ".")


def is_aid_context(text: Column) -> Column:
    """A word of the context of aid."""
    return text.rlike(fixed.AID_CONTEXT)


def is_aid_amount(text: Column) -> Column:
    """An amount in the context of aid, and no stamp duty near it."""
    return text.rlike(fixed.AMOUNT) & is_aid_context(text) & ~text.rlike(fixed.STAMP_DUTY)


def amount_units(text: Column) -> Column:
    """The lines that are aid amounts; else the sentences; else the whole text."""
    def units(parts: Column) -> Column:
        # Collapsing moves no letter, so a part without these two has no amount after it, either.
        return F.filter(F.transform(F.filter(parts, lambda x: x.rlike("(?i)rp")), collapse), is_aid_amount)

    lines, sentences = units(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")), units(F.split(text, r"(?U)(?<=[.;])\s+"))
    whole = F.when(is_aid_amount(text), F.array(collapse(text))).otherwise(F.array().cast("array<string>"))
    return let(lines, lambda x: F.when(F.size(x) > 0, x).otherwise(let(sentences, lambda y: F.when(F.size(y) > 0, y).otherwise(whole))))


def tag_set(tags: Column, primary: Column) -> Column:
    """The types and the primary type, each once."""
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.when(primary.isNotNull() & (primary != ""), F.array(primary)).otherwise(F.array().cast("array<string>")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def age_requirements(text: Column) -> Column:
    """Ages asked for: ranges, then minima, as structs (kind, low, high, phrase).

    Ranges that fall are left out. Null texts give null."""
    span = r"(?:usia|umur|berusia)[^.;]{0,60}?(\d+)\s*(?:tahun|bulan)?\s*(?:s/d|sd|sampai(?:\s+dengan)?|hingga|-)\s*(?:maksimal\s*)?(\d+)\s*tahun"
    least = r"(?:usia|umur|berusia|lanjut usia)[^.;]{0,40}?(\d+)\s*tahun\s+ke\s+atas"

    def told(kind: str, pattern: str, at_high: int | None) -> Callable[[Column], Column]:
        def one(m: Column) -> Column:
            high = F.lit(None) if at_high is None else F.regexp_extract(m, pattern, at_high)
            low = F.regexp_extract(m, pattern, 1).try_cast("int")
            return F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.try_cast("int").alias("high"), F.regexp_replace(m, r"^[ ,.;]+|[ ,.;]+$", "").alias("phrase"))

        return one

    def both(t: Column) -> Column:
        ranges = F.transform(F.regexp_extract_all(t, F.lit(span), F.lit(0)), told("range", span, 2))
        minima = F.transform(F.regexp_extract_all(t, F.lit(least), F.lit(0)), told("min", least, None))
        return F.concat(F.filter(ranges, lambda r: r["high"] >= r["low"]), minima)

    return let(F.regexp_replace(F.lower(text), f"{WS}+", " "), both)


def decile_requirements(text: Column) -> Column:
    """Structs (phrase, deciles): ranges first, then lists, pairs and single ones, each in order.

    One scan from left to right, so mentions never overlap. A range that falls or ends beyond 10 is read
    as its two numbers; of other kinds the numbers from 1 to 10 count; mentions without any are left out.
    """
    to = rf"\s*{fixed.DECILE_TO}\s*\d+"
    pattern = rf"\bdesil\s+\d+(?:{to}\b|(?:\s*,\s*\d+)+(?:\s*(?:dan|&)\s*\d+)?\b|\s*(?:dan|&)\s*\d+\b|\b)"

    def told(m: Column, at: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))
        first, last = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        ranged = m.rlike(rf"^desil\s+\d+{to}$")
        kind = F.when(ranged, 0).when(m.contains(","), 1).when(m.rlike("dan|&"), 2).otherwise(3)
        listed = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= 10))))
        values = F.when(ranged & (first <= last) & (last <= 10), F.sequence(first, F.greatest(first, last))).otherwise(listed)
        return F.struct(kind.alias("kind"), at.alias("at"), collapse(m).alias("phrase"), values.alias("deciles"))

    mentions = F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), told)
    kept = F.array_sort(F.filter(mentions, lambda x: F.size(x["deciles"]) > 0))
    return F.transform(kept, lambda x: F.struct(x["phrase"].alias("phrase"), x["deciles"].alias("deciles")))


def amount_mentions(text: Column, before: int = 140, after: int = 180) -> Column:
    """Structs (amount, context) of the amounts in a text: digits, and what stands around, white space
    collapsed. What matches and what stands between gives each match its place."""

    def placed(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

        def step(s: Column, p: Column) -> Column:
            start = s["end"] + F.length(p["gap"])
            end = start + F.length(p["found"])
            return F.struct(end.alias("end"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["found"].alias("found")))).alias("out"))

        return F.aggregate(parts, first, step, lambda s: s["out"])

    def told(m: Column) -> Column:
        start = F.greatest(m["start"] - before, F.lit(0))
        digits = F.regexp_replace(F.regexp_extract(m["found"], fixed.AMOUNT, 1), r"\D", "")
        return F.struct(digits.alias("amount"), collapse(F.substring(text, start + 1, m["end"] + after - start)).alias("context"))

    gaps, found = F.split(text, fixed.AMOUNT, -1), F.regexp_extract_all(text, F.lit(fixed.AMOUNT), F.lit(0))
    parts = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("found"))), lambda p: p["found"].isNotNull())
    return F.filter(F.transform(placed(parts), told), lambda m: m["amount"] != "")


def is_noise_line(line: Column) -> Column:
    """H1."""
    return matches_any(line, fixed.NOISE_LINES)


def line_class(line: Column, ordinals: list[str] = fixed.ORDINALS) -> Column:
    """H3: struct (level, label, rest) of a line, the first pattern that matches."""
    names = "|".join(sorted(ordinals, key=len, reverse=True))
    chapter, part, article, clause, letter = fixed.CHAPTER_LINE, fixed.PART_LINE, fixed.ARTICLE_LINE, fixed.CLAUSE_LINE, fixed.LETTER_LINE
    decree = fixed.DECREE_LINE.replace("{names}", names)

    def row(level: str, label: Column, rest: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), label.alias("label"), strip(rest).alias("rest"))

    x = F.regexp_extract
    none = F.lit("")
    return let(strip(line), lambda t: (
        F.when(t.rlike(chapter), row("bab", F.concat(F.lit("BAB "), x(t, chapter, 1)), x(t, chapter, 2)))
        .when(t.rlike(part), row("bagian", F.concat(F.lit("Bagian "), x(t, part, 1)), none))
        .when(t.rlike(article), row("pasal", F.concat(F.lit("Pasal "), x(t, article, 1)), none))
        .when(t.rlike(decree), row("diktum", F.concat(F.lit("Diktum "), F.upper(x(t, decree, 1))), F.regexp_replace(x(t, decree, 2), "^[: ]+", "")))
        .when(t.rlike(clause), row("ayat", F.coalesce(F.nullif(x(t, clause, 1), F.lit("")), x(t, clause, 2)), x(t, clause, 3)))
        .when(t.rlike(letter), row("huruf", x(t, letter, 1), x(t, letter, 2)))
        .otherwise(row("none", none, t))
    ))


def context_path(chapter: Column, article: Column, clause: Column) -> Column:
    """H6: the non-empty parts of a place in the hierarchy."""
    def part(name: str, value: Column) -> Column:
        return F.when(~F.coalesce(value, F.lit("")).isin("", "-"), F.concat(F.lit(name + " "), value))

    return F.concat_ws(" | ", part("Bab", chapter), part("Pasal/Diktum", article), part("Ayat", clause))


def category(title: Column, groups: list = fixed.CATEGORIES, default: str = fixed.DEFAULT_CATEGORY) -> Column:
    """The first group with a word (a substring) of the title."""
    out, lower = None, F.lower(title)
    for words, name in groups:
        out = F.when(contains_any(lower, words), name) if out is None else out.when(contains_any(lower, words), name)
    return F.lit(default) if out is None else out.otherwise(default)


def program_name(text: Column, aliases: dict[str, list[str]] = fixed.PROGRAM_ALIASES) -> Column:
    """The program whose longest alias the text holds; on a tie the larger name; else null."""
    def named(t: Column) -> Column:
        return F.array(*[F.when(F.contains(t, F.lit(a)), F.struct(F.lit(len(a)).alias("n"), F.lit(name).alias("program"))) for name, names in aliases.items() for a in names])

    return F.array_max(F.filter(let(evaluator_text(text), named), lambda x: x.isNotNull()))["program"]


def window_status(text: Column) -> Column:
    """The status that a stretch of normalised text speaks of."""
    return (
        F.when(text.rlike(r"\bnon[-\s]+eligible\b|\btidak\s+eligible\b|tidak memenuhi|tidak sesuai"), "tidak_eligible")
        .when(text.rlike(r"\bmungkin\s+eligible\b|perlu verifikasi|belum dapat dipastikan"), "mungkin_eligible")
        .when(text.rlike(r"\beligible\b|memenuhi syarat|layak"), "eligible")
        .otherwise("unknown")
    )


def canonical_status(label: Column, labels: dict[str, str] = fixed.STATUS_LABELS) -> Column:
    """E13."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, evaluator_text(label)), F.lit("unknown"))


def cites_page(answer: Column, page: Column) -> Column:
    """E5: whether a normalised answer cites a page, alone, in a list or within a range."""
    cited = F.regexp_extract_all(answer, F.lit(r"\b(?:hal\.?|halaman|page)\s*(\d+(?:\s*(?:,|dan|&|-|s/d|sd)\s*\d+)*)"), F.lit(1))

    def holds(pages: Column) -> Column:
        single = F.exists(F.regexp_extract_all(pages, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int") == page)
        low, high = (F.regexp_extract(pages, r"(\d+)\s*(?:-|s/d|sd)\s*(\d+)", i) for i in (1, 2))
        return single | F.coalesce((low != "") & page.between(F.nullif(low, F.lit("")).cast("int"), F.nullif(high, F.lit("")).cast("int")), F.lit(False))

    return F.exists(cited, holds)


def is_active_status(status: Column) -> Column:
    """True, false, or null where the status says neither."""
    s = F.lower(status)
    return F.when(s.rlike("tidak aktif|nonaktif|non aktif"), False).when(F.contains(s, F.lit("aktif")), True)


def is_severe(value: Column) -> Column:
    """A term of severe disability in the value and none that denies it."""
    v = F.lower(F.coalesce(value, F.lit("")))
    return contains_any(v, fixed.DISABILITY_TERMS) & ~contains_any(v, fixed.NO_DISABILITY_TERMS)


def upstream_eligible(status: Column, label: Column) -> Column:
    """G5."""
    s = F.upper(F.coalesce(status, F.lit("")))
    return (F.contains(s, F.lit("LAYAK")) & ~F.contains(s, F.lit("TIDAK"))) | F.coalesce(label == 1, F.lit(False))


def citizen_number(text: Column) -> Column:
    """P5: what follows the label, to the next white space or slash; null without it."""
    return F.nullif(F.regexp_extract(text, r"(?i)NIK\s*(?:/\s*No\.\s*KK)?\s*:\s*([^\s/]+)", 1), F.lit(""))


def program_label(name: Column, labels: list[str] = fixed.PROGRAM_NAMES) -> Column:
    """The canonical name of a program: by two rules, else by label whatever its case, else as it is."""
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(F.contains(n, F.lit("pkh")) & F.contains(n, F.lit("plus")), fixed.ELDERLY_PROGRAM).when(F.contains(n, F.lit("aspd")) | F.contains(n, F.lit("disabilitas")), fixed.DISABILITY_PROGRAM)
    for label in labels:
        out = out.when(n == label.lower(), label)
    return out.otherwise(F.coalesce(name, F.lit("")))


def spec_items(text: Column) -> Column:
    """A list from text split at commas, semicolons and line ends; blanks go."""
    return F.filter(F.transform(F.split(text, r"[,;\n]+"), strip), lambda x: x != "")
