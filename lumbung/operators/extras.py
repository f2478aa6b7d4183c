"""Titles, prompts, templates, judge inputs and browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X


def detect_title(pages: DataFrame, document: str, page: str, order: str, unknown: str = "Dokumen Tidak Diketahui") -> DataFrame:
    """H7: a title from the lines of a document's first two pages: what stands before the considerations,
    without marks of the page; the part up to its subject if there is one; else all of it if it names a
    kind of law; else the first long line."""
    two = F.dense_rank().over(Window.partitionBy(document).orderBy(page))
    lines = pages.withColumn("_d", two).filter("_d <= 2")
    line = F.col("line")
    able = (F.length(line) > 20) & ~F.startswith(line, F.lit("-")) & ~X.is_noise_line(line)
    one = lines.groupBy(document).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, order, "line"))), lambda x: x["line"]), " ").alias("t"), F.min_by(F.when(able, X.strip(line)), F.when(able, F.struct(page, order))).alias("fallback")
    )
    t = F.regexp_replace("t", r"(?is)\b(Menimbang|Mengingat)\b.*", "")
    for pattern in (r"(?i)\bjdih\.\w+\.go\.id\b", r"-\s*\d+\s*-", r"(?i)\b(s|salinan)\b", r"(?i)MENTERI SOSIAL REPUBLIK INDONESIA\s*,$"):
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(X.collapse(t), r"[,;. ]+\z", "")
    subject = X.strip(F.regexp_extract(t, r"(?is)((?:KEPUTUSAN|PERATURAN|INSTRUKSI|UNDANG[- ]UNDANG)[^,]*?TENTANG\s+[^,;]+)", 1))
    title = F.when(subject != "", subject).when((F.length(t) > 30) & t.rlike("(?i)(KEPUTUSAN|PERATURAN|UNDANG)"), t).otherwise(F.coalesce("fallback", F.lit(unknown)))
    return one.select(document, title.alias("title"))


# Short forms of kinds of law, and small words of titles.
_SHORT = [(r"UNDANG[\s-]+UNDANG", "UU"), (r"PERATURAN\s+PEMERINTAH", "PP"), (r"PERATURAN\s+PRESIDEN", "Perpres"), (r"INSTRUKSI\s+PRESIDEN", "Inpres"), (r"PERATURAN\s+MENTERI\b", "Permen"), (r"KEPUTUSAN\s+MENTERI\b", "Kepmen"), (r"PERATURAN\s+DAERAH", "Perda"), (r"PERATURAN\s+GUBERNUR", "Pergub"), (r"PERATURAN\s+BUPATI", "Perbup"), (r"PERATURAN\s+WALIKOTA", "Perwali"), (r"KEPUTUSAN\s+DIREKTUR\s+JENDERAL", "Kepdirjen")]
_TITLE_SMALL = ["dan", "atau", "di", "ke", "dari", "atas", "yang", "dalam", "untuk", "dengan", "pada", "secara", "oleh", "melalui", "serta"]


def shorten_title(title: Column) -> Column:
    """H8: a title without ceremony, with short forms of kinds of law and plain capitals."""
    s = F.regexp_replace(title, r"(?i)\s*REPUBLIK\s+INDONESIA\s*", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?is)\s+dengan\s+Rahmat\s+Tuhan.*\z", ""), r"(?i)\s+(Presiden|Menteri\s+[A-Za-z\s]+)\s*\z", "")
    s = F.regexp_replace(s, r"(?i)NOMOR\s+", "No. ")
    for pattern, short in _SHORT:
        s = F.regexp_replace(s, f"(?i){pattern}", short)
    keep = [short for _, short in _SHORT]

    def cased(w: Column, i: Column) -> Column:
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
        return F.when(w.isin(keep), w).when(F.lower(w) == "tentang", "tentang").when(w.rlike(r"^\d|/"), w).when((i > 0) & F.lower(w).isin(_TITLE_SMALL), F.lower(w)).when((F.upper(w) == w) & (F.length(w) > 2), capital).otherwise(w)

    out = F.array_join(F.transform(F.split(X.collapse(s), " "), cased), " ")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 20))


def prompt_for(sources: Column, prompts: dict[str, str], default: str) -> Column:
    """The prompts of the sources known, joined; the default without any."""
    table = F.create_map(*[F.lit(x) for kv in prompts.items() for x in kv])
    found = F.filter(F.transform(sources, lambda s: F.try_element_at(table, s)), lambda p: p.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(default)


def template_parts(text: Column) -> Column:
    """Struct (profile, instructions) of a filled template; the text itself without one."""
    marked = F.contains(text, F.lit("=== PROFIL WARGA ==="))
    profile = F.regexp_extract(text, r"(?s)=== PROFIL WARGA ===\s*(.*?)\s*=== AKHIR PROFIL WARGA ===", 1)
    return F.struct(F.when(marked & (profile != ""), X.strip(profile)).otherwise(text).alias("profile"), F.when(marked, F.nullif(X.strip(F.regexp_extract(text, r"(?s)INSTRUKSI EKSEKUSI:\s*(.*)", 1)), F.lit(""))).alias("instructions"))


def lifted(payload: Column, keys: list[str], inside: str = "laporan_evaluasi") -> Column:
    """Struct of JSON texts: each key at the root, else inside the named object."""
    v = X.whole_json(payload)
    return F.struct(*[F.coalesce(F.to_json(F.try_variant_get(v, f"$.{k}", "variant")), F.to_json(F.try_variant_get(v, f"$.{inside}.{k}", "variant"))).alias(k) for k in keys])


def plain_decile(profile: Column) -> Column:
    """The number right after the word; it misses ``Desil Nasional : 2``, as the rule does."""
    return F.nullif(F.regexp_extract(profile, r"(?i)\bdesil\s*(\d+)\b", 1), F.lit("")).try_cast("int")


def ages(profile: Column) -> Column:
    """All ages in years."""
    return F.transform(F.regexp_extract_all(F.lower(profile), F.lit(r"\b(\d+)\s*tahun\b"), F.lit(1)), lambda a: a.try_cast("int"))


def facts_block(catalog: DataFrame, program: str) -> DataFrame:
    """A line of each program's amounts, in order of size, from rows of (program, amount, display)."""
    shown = F.transform(F.array_sort(F.collect_list(F.struct(F.col("amount").cast("decimal(38,0)").alias("n"), "display"))), lambda x: F.concat(F.lit("Rp "), x["display"]))
    return catalog.groupBy(program).agg(F.concat(F.lit("- Nominal resmi: "), F.array_join(shown, ", ")).alias("line"))


def judge_context(hits: DataFrame, most: int = 40, length: int = 1200) -> DataFrame:
    """Each query's hits as lines of source, page and text, at most ``most``, texts cut at ``length``."""
    text = X.strip(F.col("text"))
    cut = F.when(F.length(text) > length, F.concat(F.regexp_replace(F.substring(text, 1, length), r"\s+\z", ""), F.lit(" ..."))).otherwise(text)
    line = F.concat(F.lit("Sumber: "), F.coalesce("source", F.lit("-")), F.lit(" | Halaman: "), F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit("\n"), cut)
    return hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("contexts"))


def parse_failures(parsed: DataFrame, column: str) -> DataFrame:
    """Answers that gave nothing to read; a caller may ask again."""
    return parsed.filter(F.col(column).isNull())


def find_word(chunks: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Browsing: chunks that hold a word, case ignored, in any of the columns."""
    return chunks.filter(X.any_of([F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word.lower())) for c in columns]))


def page_of(chunks: DataFrame, page: int, file: str | None = None) -> DataFrame:
    """Browsing: chunks of a page, of files whose name holds ``file``."""
    out = chunks.filter(F.col("page") == page)
    return out if file is None else out.filter(F.contains(F.lower("source"), F.lit(file.lower())))


def nth(chunks: DataFrame, order: str, n: int) -> DataFrame:
    """Browsing: the n-th chunk, counted from 1."""
    return chunks.orderBy(order).offset(n - 1).limit(1)
