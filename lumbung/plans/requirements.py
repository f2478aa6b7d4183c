"""Requirement, amount-context and summary queries over the driver's tables, with SQL that applies the rules to the texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import requirements as Q
from .profiles import chunks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _pick(n, *texts):
    """The text that a number names, the numbers taken modulo how many there are."""
    return F.element_at(F.array(*texts), (F.pmod(n, F.lit(len(texts))) + 1).cast("int"))


def _asking(spark, d):
    """Whole texts with lines that ask for ages and deciles, in wordings and numbers that vary by row."""
    i = F.col("doc_id")
    n = lambda c: c.cast("string")
    age = F.concat(F.lit("Usia "), n(30 + i * 7 % 50), _pick(i, *map(F.lit, (" s/d ", " sampai  dengan ", " - ", " hingga maksimal "))), n(25 + i * 11 % 70), F.lit(" tahun."))
    least = F.when(i % 3 == 0, F.concat(F.lit("lanjut usia "), n(60 + i % 25), F.lit(" tahun ke atas"))).otherwise("")
    desil = _pick(
        i, F.concat(F.lit("Desil 1 sampai dengan "), n(i % 12 + 1)), F.concat(F.lit("desil "), n(i % 10 + 1), F.lit(", "), n(i % 4 + 1), F.lit(" dan "), n(i % 11)),
        F.concat(F.lit("desil "), n(i % 6), F.lit(" &  "), n(i % 13), F.lit("; atau desil 3-2")), F.concat(F.lit("Desil "), n(i % 12), F.lit(", desil 4")), F.lit("tanpa"),
    )
    tags = F.when(i % 9 == 0, F.array(F.lit("kriteria_penerima")))
    program = F.when(F.col("source") != "src5", F.concat(F.lit("Program "), "source"))
    return chunks(spark, d).select(i.alias("chunk"), "source", program.alias("program"), (i % 40).alias("page"), F.concat_ws("\n", "text", age, desil, least).alias("text"), tags.alias("tags"))


_TO = r"\s*(?:-|s/d|sd|sampai(?:\s+dengan)?)\s*\d+"
_A = rf"""WITH t AS (SELECT doc_id AS chunk, source, CASE WHEN source <> 'src5' THEN 'Program ' || source END AS program, doc_id % 40 AS page, doc_id % 9 = 0 AS criteria,
 text || chr(10) || 'Usia ' || (30 + doc_id * 7 % 50) || [' s/d ', ' sampai  dengan ', ' - ', ' hingga maksimal '][doc_id % 4 + 1] || (25 + doc_id * 11 % 70) || ' tahun.' || chr(10) ||
 [concat('Desil 1 sampai dengan ', doc_id % 12 + 1), concat('desil ', doc_id % 10 + 1, ', ', doc_id % 4 + 1, ' dan ', doc_id % 11), concat('desil ', doc_id % 6, ' &  ', doc_id % 13, '; atau desil 3-2'), concat('Desil ', doc_id % 12, ', desil 4'), 'tanpa'][doc_id % 5 + 1]
 || chr(10) || CASE WHEN doc_id % 3 = 0 THEN concat('lanjut usia ', 60 + doc_id % 25, ' tahun ke atas') ELSE '' END AS text FROM documents),
dm AS (SELECT chunk, unnest(m) AS m, generate_subscripts(m, 1) AS pos FROM (SELECT chunk, regexp_extract_all(lower(text), '\bdesil\s+\d+(?:{_TO}\b|(?:\s*,\s*\d+)+(?:\s*(?:dan|&)\s*\d+)?\b|\s*(?:dan|&)\s*\d+\b|\b)') AS m FROM t)),
dn AS (SELECT *, regexp_matches(m, '^desil\s+\d+{_TO}$') AS ranged, list_transform(regexp_extract_all(m, '\d+'), lambda x: x::INT) AS n FROM dm),
dk AS (SELECT chunk, CASE WHEN ranged THEN 0 WHEN contains(m, ',') THEN 1 WHEN regexp_matches(m, 'dan|&') THEN 2 ELSE 3 END AS cls, pos, trim(regexp_replace(m, '\s+', ' ', 'g')) AS phrase,
 CASE WHEN ranged AND n[1] <= n[2] AND n[2] <= 10 THEN range(n[1], n[2] + 1)::INT[] ELSE list_sort(list_distinct(list_filter(n, lambda x: x BETWEEN 1 AND 10))) END AS deciles FROM dn),
an AS (SELECT chunk, regexp_replace(lower(text), '\s+', ' ', 'g') AS s, '(?:usia|umur|berusia)[^.;]{{0,60}}?(\d+)\s*(?:tahun|bulan)?\s*(?:s/d|sd|sampai(?:\s+dengan)?|hingga|-)\s*(?:maksimal\s*)?(\d+)\s*tahun' AS span, '(?:usia|umur|berusia|lanjut usia)[^.;]{{0,40}}?(\d+)\s*tahun\s+ke\s+atas' AS least FROM t),
ar AS (SELECT chunk, 4 AS cls, unnest(regexp_extract_all(s, span, 0)) AS m, unnest(regexp_extract_all(s, span, 1))::INT AS low, unnest(regexp_extract_all(s, span, 2))::INT AS high, generate_subscripts(regexp_extract_all(s, span, 0), 1) AS pos FROM an),
am AS (SELECT chunk, 5 AS cls, unnest(regexp_extract_all(s, least, 0)) AS m, unnest(regexp_extract_all(s, least, 1))::INT AS low, NULL::INT AS high, generate_subscripts(regexp_extract_all(s, least, 0), 1) AS pos FROM an),
ages AS (SELECT chunk, cls, pos, CASE WHEN cls = 4 THEN 'range' ELSE 'min' END AS kind, low, high, trim(m, ' ,.;') AS phrase FROM (SELECT chunk, cls, m, low, high, pos FROM ar WHERE high >= low UNION ALL SELECT chunk, cls, m, low, high, pos FROM am)),
need AS (SELECT chunk, cls, pos, 'desil' AS kind, deciles, NULL::INT AS low, NULL::INT AS high, phrase FROM dk WHERE len(deciles) > 0 UNION ALL SELECT chunk, cls, pos, kind, NULL, low, high, phrase FROM ages)"""


@query("n10_decile_requirements", _A + " SELECT chunk AS doc_id, phrase, deciles FROM need WHERE kind = 'desil'")
def n10(spark, d):
    return _asking(spark, d).select(F.col("chunk").alias("doc_id"), F.explode(X.decile_requirements(F.col("text"))).alias("x")).select("doc_id", "x.*")


@query("n11_age_requirements", _A + " SELECT chunk AS doc_id, kind, low, high, phrase FROM ages")
def n11(spark, d):
    return _asking(spark, d).select(F.col("chunk").alias("doc_id"), F.explode(X.age_requirements(F.col("text"))).alias("x")).select("doc_id", "x.*")


def _people(spark, d):
    """The stated query set, every row whose id is divisible by 50: some without a decile, some without ages."""
    i = F.col("doc_id")
    ages = F.when(i % 200 == 0, F.array().cast("array<int>")).otherwise(F.array((i * 3 % 100).cast("int"), (i * 7 % 90).cast("int")))
    return chunks(spark, d).filter(i % 50 == 0).select(i.alias("profile"), "source", F.when(i % 150 != 0, (i % 10 + 1 + F.floor(i / 50) % 10).cast("int")).alias("decile"), ages.alias("ages"))


_PEOPLE = ", p AS (SELECT doc_id AS profile, source, CASE WHEN doc_id % 150 <> 0 THEN doc_id % 10 + 1 + doc_id // 50 % 10 END AS decile, CASE WHEN doc_id % 200 = 0 THEN [] ELSE [doc_id * 3 % 100, doc_id * 7 % 90] END AS ages FROM documents WHERE doc_id % 50 = 0)"


@query("n12_requirement_hints", _A + _PEOPLE + r""", c AS (SELECT lang AS key, doc_id AS chunk FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 30),
h AS (SELECT profile, chunk, row_number() OVER (PARTITION BY profile ORDER BY (chunk * 31 + profile) % 97, chunk) AS rank FROM p JOIN documents d ON d.doc_id = p.profile JOIN c ON c.key = d.lang QUALIFY rank <= 12),
m AS (SELECT h.*, t.program, t.page, need.* EXCLUDE (chunk), p.decile, p.ages, CASE WHEN kind = 'desil' THEN list_contains(deciles, decile) ELSE len(list_filter(ages, lambda a: a >= low AND (high IS NULL OR a <= high))) > 0 END AS passes
 FROM h JOIN t USING (chunk) JOIN need USING (chunk) JOIN p USING (profile) WHERE program IS NOT NULL AND (kind = 'desil' AND decile IS NOT NULL OR kind <> 'desil' AND len(ages) > 0)),
s AS (SELECT * FROM (SELECT *, bool_or(kind = 'desil' AND passes) OVER (PARTITION BY profile, chunk) AS any_passes FROM m) WHERE kind <> 'desil' OR passes OR NOT any_passes),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY profile, program, kind, deciles, low, high ORDER BY rank, cls, pos) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY profile, program ORDER BY rank, cls, pos) AS place FROM o QUALIFY place <= 3)
SELECT profile, program, place::INT AS place, page, kind, phrase, passes, concat('- ', program, ' | Hal. ', page, ' | syarat ', phrase, CASE WHEN kind = 'desil' THEN concat(' (nilai: ', array_to_string(deciles, ', '), '); profil Desil ', decile) ELSE concat('; usia pada profil: ', array_to_string(ages, ', '), ' tahun') END, ' -> ', CASE WHEN passes THEN 'MEMENUHI' ELSE 'TIDAK MEMENUHI' END, '.') AS hint FROM q""")
def n12(spark, d):
    """Each profile hits twelve of the first chunks of its language, in an order of its own."""
    docs = chunks(spark, d)
    first = docs.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("_r <= 30").select(F.col("lang").alias("key"), F.col("doc_id").alias("chunk"))
    own = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("profile"), F.col("lang").alias("key")).join(first, "key")
    rank = F.row_number().over(Window.partitionBy("profile").orderBy((F.col("chunk") * 31 + F.col("profile")) % 97, "chunk"))
    hits = own.withColumn("rank", rank).filter("rank <= 12").select("profile", "chunk", "rank")
    return Q.requirement_hints(_people(spark, d), hits, _asking(spark, d).drop("source"))


@query("n12_ages_in_ranges", _A + _PEOPLE + ", r AS (SELECT DISTINCT low, high FROM ages) SELECT low, high, count(DISTINCT profile) AS profiles FROM (SELECT profile, unnest(ages) AS age FROM p) a JOIN r ON age >= low AND (high IS NULL OR age <= high) GROUP BY low, high")
def n12_ages(spark, d):
    """How many profiles meet each range of ages that any document asks for."""
    needs = _asking(spark, d).select(F.explode(X.age_requirements(F.col("text"))).alias("x")).select("x.low", "x.high").distinct()
    needs = needs.select(F.struct("low", "high").alias("need"), "low", "high")
    return Q.of_ages(_people(spark, d).select("profile", "ages"), needs).groupBy("need").agg(F.count("*").alias("profiles")).select("need.low", "need.high", "profiles")


def _paying(spark, d):
    """Whole texts with lines of amounts: one to three in a line, lines longer than a summary, appendices,
    stamp duty, amounts whose context stands in another line, and none."""
    i = F.col("doc_id")
    n = lambda c: c.cast("string")
    one = F.concat(F.when(i % 4 == 1, "Lampiran: ").otherwise(""), F.lit("Besaran bantuan Rp "), n(i * 37 % 900 + 1), F.lit(".000"))
    long = F.concat(F.repeat(F.lit("bantuan Rp 100.000 per tahap "), 23), F.lit("Rp 7."), n(i % 90 + 10), F.lit(" dan Rp 8."), n(i % 70 + 10))
    first = F.when(i % 6 == 0, long).when(i % 8 == 3, "tanpa").when(i % 10 == 7, F.concat(F.lit("Rp "), n(i), F.lit(".000\nsetiap tahap; lain"))).otherwise(one)
    second = F.when(i % 11 == 0, "bea materai Rp 10.000 bantuan").when(i % 3 == 1, F.concat(F.lit("tahap satu Rp. 250.000,- tahap dua Rp "), n(i % 30 + 1), F.lit(".500.000 lampiran"))).otherwise("-")
    text = F.concat_ws("\n", "text", first, second)
    return chunks(spark, d).select(
        i.alias("ord"), F.when(F.col("source") != "src5", F.col("source")).alias("program"), text.alias("text"), F.when(i % 7 == 0, F.array(F.lit("nominal_bantuan"))).alias("tags"),
        F.when(i % 3 == 0, "low").otherwise("normal").alias("priority"), F.when(i % 5 == 2, "LAMPIRAN II").alias("title"),
    )


_MONEY = r"(?i)\bRp\.?\s*([0-9][0-9.,\s]*)(?:,-|,00)?"
_CONTEXT = r"(?i)\b(bantuan|bansos|besaran|nominal|sebesar|senilai|per orang|per tahap|tahap|disalurkan|diterima|penerima manfaat)\b"
_DUTY = r"(?i)\b(materai|bea\s+materai)\b.{0,50}\brp\b|\brp\b.{0,50}\b(materai|bea\s+materai)\b"
_P = rf"""WITH RECURSIVE t AS (SELECT doc_id AS ord, CASE WHEN source <> 'src5' THEN source END AS program, doc_id % 7 = 0 AS tagged, doc_id % 3 <> 0 AND doc_id % 5 <> 2 AS plain,
 concat(text, chr(10), CASE WHEN doc_id % 6 = 0 THEN concat(repeat('bantuan Rp 100.000 per tahap ', 23), 'Rp 7.', doc_id % 90 + 10, ' dan Rp 8.', doc_id % 70 + 10) WHEN doc_id % 8 = 3 THEN 'tanpa' WHEN doc_id % 10 = 7 THEN concat('Rp ', doc_id, '.000', chr(10), 'setiap tahap; lain')
  ELSE concat(CASE WHEN doc_id % 4 = 1 THEN 'Lampiran: ' ELSE '' END, 'Besaran bantuan Rp ', doc_id * 37 % 900 + 1, '.000') END,
  chr(10), CASE WHEN doc_id % 11 = 0 THEN 'bea materai Rp 10.000 bantuan' WHEN doc_id % 3 = 1 THEN concat('tahap', chr(160), 'satu Rp. 250.000,- tahap dua Rp ', doc_id % 30 + 1, '.500.000 lampiran') ELSE '-' END) AS text FROM documents),
l AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{{a0}}]+', ' ', 'g'))) AS lines, list_transform(string_split(regexp_replace(text, '([.;])[\s\x{{a0}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '[\s\x{{a0}}]+', ' ', 'g'))) AS sentences FROM t),
f AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{_MONEY}') AND regexp_matches(x, '{_CONTEXT}') AND NOT regexp_matches(x, '{_DUTY}')) AS a, list_filter(sentences, lambda x: regexp_matches(x, '{_MONEY}') AND regexp_matches(x, '{_CONTEXT}') AND NOT regexp_matches(x, '{_DUTY}')) AS b,
 regexp_matches(text, '{_MONEY}') AND regexp_matches(text, '{_CONTEXT}') AND NOT regexp_matches(text, '{_DUTY}') AS c FROM l),
w AS (SELECT *, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN c THEN [trim(regexp_replace(text, '[\s\x{{a0}}]+', ' ', 'g'))] ELSE [] END AS units FROM f WHERE program IS NOT NULL AND (tagged OR regexp_matches(text, '{_CONTEXT}'))),
e AS (SELECT program, ord, plain, unnest(units) AS whole, generate_subscripts(units, 1) - 1 AS unit FROM w),
g AS (SELECT program, ord, unit, plain, rtrim(substr(whole, 1, 620)) AS summary, list_distinct(list_transform(regexp_extract_all(whole, '{_MONEY}', 1), lambda x: regexp_replace(x, '\D', '', 'g'))) AS n FROM e),
u AS (SELECT program, ord, unit, plain, summary, len(n) AS n, len(list_distinct(list_transform(regexp_extract_all(summary, '{_MONEY}', 1), lambda x: regexp_replace(x, '\D', '', 'g')))) AS has, contains(lower(summary), 'lampiran') AS marked, row_number() OVER (PARTITION BY program ORDER BY ord, unit) AS k FROM g WHERE len(n) > 0),
s AS (SELECT program, k, ord, unit, summary, has, marked FROM u WHERE k = 1
 UNION ALL SELECT u.program, u.k, CASE WHEN r THEN u.ord ELSE s.ord END, CASE WHEN r THEN u.unit ELSE s.unit END, CASE WHEN r THEN u.summary ELSE s.summary END, CASE WHEN r THEN u.has ELSE s.has END, CASE WHEN r THEN u.marked ELSE s.marked END
 FROM s JOIN u ON u.program = s.program AND u.k = s.k + 1, LATERAL (SELECT u.n > s.has OR u.n = s.has AND u.plain AND s.marked AS r))"""


@query("n6_amount_summary", _P + " SELECT program, ord, unit::INT AS unit, summary FROM s QUALIFY row_number() OVER (PARTITION BY program ORDER BY k DESC) = 1")
def n6(spark, d):
    return Q.best_summaries(_paying(spark, d))


@query("n3_amount_mentions", _P.split("\nl AS", 1)[0] + rf"""
o AS (SELECT ord AS doc_id, text, string_split_regex(text, '{_MONEY}') AS gaps, regexp_extract_all(text, '{_MONEY}', 0) AS found, regexp_extract_all(text, '{_MONEY}', 1) AS digits FROM t),
v AS (SELECT doc_id, text, unnest(range(1, len(found) + 1)) AS k, gaps, found, digits FROM o),
x AS (SELECT doc_id, text, regexp_replace(digits[k], '\D', '', 'g') AS amount, list_sum(list_transform(gaps[1:k], lambda g: len(g))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda g: len(g))), 0) AS start, len(found[k]) AS n FROM v)
SELECT doc_id, amount, trim(regexp_replace(substr(text, greatest(start - 140, 0)::BIGINT + 1, (start + n + 180 - greatest(start - 140, 0))::BIGINT), '[\s\x{{a0}}]+', ' ', 'g')) AS context FROM x""")
def n3(spark, d):
    return _paying(spark, d).select(F.col("ord").alias("doc_id"), F.explode(X.amount_mentions(F.col("text"))).alias("x")).select("doc_id", "x.*")
