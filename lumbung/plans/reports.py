"""The quality profile over JSON lines made of whole texts, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..sources import jsonl as J
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


#: Fields of the metadata: name, condition on doc_id (i), and value as SQL for a text or for a JSON value.
_FIELDS = [
    ("sumber", "i % 9 <> 0", """concat('"', CASE WHEN i % 7 = 0 THEN '' ELSE concat('doc ', i % 4) END, '"')"""), ("filename", "i % 18 = 0", """'"file.pdf"'"""), ("page_number", "i % 5 <> 0", "cast(i % 11 AS STRING)"),
    ("kategori", "i % 6 < 4", """concat('"', CASE WHEN i % 6 = 0 THEN '  ' WHEN i % 6 = 1 THEN repeat('panjang ', 9) ELSE 'Regulasi' END, '"')"""), ("nama_bansos", "i % 4 = 0", """CASE WHEN i % 8 = 0 THEN '"PKH"' ELSE '""' END"""),
    ("tipe_konten", "i % 3 <> 2", """CASE WHEN i % 10 = 0 THEN '[]' WHEN i % 3 = 0 THEN '["kriteria", "nominal"]' ELSE '"kriteria"' END"""), ("tipe_konten_primer", "i % 16 <> 0", """'"kriteria"'"""),
    ("retrieval_priority", "i % 12 <> 5", """CASE i % 5 WHEN 0 THEN '"low"' WHEN 1 THEN '"odd"' ELSE '"normal"' END"""), ("quality_flags", "i % 7 = 3", """'["pendek", "fragmen"]'"""), ("bab", "i % 13 = 1", """CASE WHEN i % 2 = 0 THEN '" "' ELSE '"II"' END"""),
    ("judul_halaman", "i % 17 = 1", """'"Judul"'"""),
]
_OBJECT = "concat('{', array_join(filter(array(" + ", ".join(f"CASE WHEN {when} THEN concat('\"{name}\": ', {value}) END" for name, when, value in _FIELDS) + "), x -> x IS NOT NULL), ', '), '}')"


def _lines(spark, d):
    """A line for each document in the file of its language: its whole text with more or less metadata, an
    empty text, a broken line, or a list."""
    docs = chunks(spark, d).withColumn("i", F.col("doc_id"))
    head = F.to_json(F.struct(F.when(F.col("i") % 41 == 0, "").otherwise(F.col("text")).alias("text")))
    whole = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(', "metadata": '), F.expr(_OBJECT), F.lit("}"))
    value = F.when(F.col("i") % 31 == 0, F.concat(whole, F.lit(" x"))).when(F.col("i") % 37 == 0, "[1]").otherwise(whole)
    lines = docs.select("doc_id", F.coalesce("lang", F.lit("none")).alias("file"), value.alias("value"))
    return J.scan_strict(lines)


def _found(spark, d):
    return R.entries(_lines(spark, d), "file", "doc_id", main=("doc 3",))


_SQL_OBJECT = "'{' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN concat('\"{name}\": ', {value.replace('cast(i % 11 AS STRING)', '(i % 11)::VARCHAR')}) END" for name, when, value in _FIELDS) + "], lambda x: x IS NOT NULL), ', ') || '}'"
_S = f"""WITH l AS (SELECT doc_id AS i, coalesce(lang, 'none') AS file, CASE WHEN doc_id % 41 = 0 THEN '' ELSE text END AS text FROM documents),
m AS (SELECT i, file, text, CASE WHEN i % 31 = 0 THEN 'invalid_json' WHEN i % 37 = 0 THEN 'invalid_schema' ELSE 'row' END AS outcome, ({_SQL_OBJECT})::JSON AS j FROM l),
g AS (SELECT *, length(text) AS n, length(trim(text, ' ' || chr(10))) AS s, coalesce(j->>'$.sumber', '') AS sumber, coalesce(j->>'$.page_number', '') AS page_number, coalesce(j->>'$.nama_bansos', '') AS nama_bansos, coalesce(j->>'$.kategori', '') AS kategori, coalesce((j->'$.tipe_konten')::VARCHAR, '') AS tipe, coalesce(j->>'$.retrieval_priority', '') AS priority,
 coalesce(j->>'$.tipe_konten_primer', '') AS primer, trim(coalesce(j->>'$.bab', '')) <> '' AS bab, coalesce(j->>'$.judul_halaman', '') <> '' AS judul, len(json_keys(j)) AS keys FROM m),
f AS (SELECT *, sumber = 'doc 3' OR nama_bansos <> '' AS due FROM g),
t AS (SELECT file, count_if(outcome = 'row') AS rows, count_if(outcome = 'invalid_json') AS invalid_json, count_if(outcome = 'invalid_schema') AS invalid_schema, sum(n) FILTER (outcome = 'row')::BIGINT AS total_length, avg(n) FILTER (outcome = 'row') AS mean_length, median(n) FILTER (outcome = 'row')::DOUBLE AS median_length, min(n) FILTER (outcome = 'row') AS min_length, max(n) FILTER (outcome = 'row') AS max_length,
 avg(keys) FILTER (outcome = 'row') AS mean_keys, count_if(outcome = 'row' AND n = 0) AS empty, count_if(outcome = 'row' AND n < 100) AS short, count_if(outcome = 'row' AND n BETWEEN 100 AND 500) AS medium, count_if(outcome = 'row' AND n > 500) AS long, count_if(outcome = 'row') - count(DISTINCT text) FILTER (outcome = 'row') AS duplicates,
 round(avg(s) FILTER (outcome = 'row' AND s > 0), 1) AS avg_len, round(median(s) FILTER (outcome = 'row' AND s > 0), 1)::DOUBLE AS median_len, min(s) FILTER (outcome = 'row' AND s > 0) AS min_len, max(s) FILTER (outcome = 'row' AND s > 0) AS max_len, count_if(outcome = 'row' AND s > 0) AS valid, count_if(outcome = 'row' AND s < 100) AS short_stripped, count_if(outcome = 'row' AND s > 2000) AS very_long,
 count_if(outcome = 'row' AND sumber = '') AS lacks_sumber, count_if(outcome = 'row' AND page_number = '') AS lacks_page_number, count_if(outcome = 'row' AND due AND nama_bansos = '') AS unclean_nama_bansos, count_if(outcome = 'row' AND due AND tipe IN ('', '[]')) AS unclean_tipe_konten, count_if(outcome = 'row' AND due AND primer = '') AS unclean_tipe_konten_primer, count_if(outcome = 'row' AND due AND priority = '') AS unclean_retrieval_priority,
 count_if(outcome = 'row' AND due AND NOT (starts_with(tipe, '[') AND tipe <> '[]')) AS bad_type, count_if(outcome = 'row' AND due AND priority NOT IN ('normal', 'low')) AS bad_priority, count_if(outcome = 'row' AND bab) AS has_bab, 0::BIGINT AS has_pasal, 0::BIGINT AS has_ayat, count_if(outcome = 'row' AND judul) AS has_judul_halaman,
 count_if(outcome = 'row' AND (bab OR judul OR trim(kategori) <> '' OR nama_bansos <> '')) AS has_any, count_if(outcome = 'row' AND sumber <> '') AS has_source, count_if(outcome = 'row' AND page_number <> '') AS has_page, count_if(outcome = 'row' AND due) AS due FROM f GROUP BY file),
w AS (SELECT *, (invalid_json > 0)::INT + (invalid_schema > 0)::INT + (empty > 0)::INT + (short > 0.30 * rows)::INT + (duplicates > 0)::INT + (lacks_sumber + lacks_page_number > 0)::INT + (unclean_nama_bansos + unclean_tipe_konten + unclean_tipe_konten_primer + unclean_retrieval_priority > 0)::INT + (bad_type > 0)::INT + (bad_priority > 0)::INT AS warnings FROM t),
e AS (SELECT file, i, 'sumber' AS kind, CASE WHEN sumber <> '' THEN sumber WHEN i % 18 = 0 THEN 'file.pdf' ELSE '(unknown)' END AS value FROM f WHERE outcome = 'row' UNION ALL SELECT file, i, 'retrieval_priority', priority FROM f WHERE outcome = 'row' AND priority <> '' UNION ALL SELECT file, i, 'kategori', kategori FROM f WHERE outcome = 'row' AND kategori <> ''
 UNION ALL SELECT file, i, 'nama_bansos', nama_bansos FROM f WHERE outcome = 'row' AND nama_bansos <> '' UNION ALL SELECT file, i, 'tipe_konten', unnest(CASE WHEN tipe = '[]' OR tipe = '' THEN [] WHEN starts_with(tipe, '[') THEN ['kriteria', 'nominal'] ELSE ['kriteria'] END) FROM f WHERE outcome = 'row' UNION ALL SELECT file, i, 'quality_flags', unnest(['pendek', 'fragmen']) FROM f WHERE outcome = 'row' AND i % 7 = 3),
k AS (SELECT file, kind, value, count(*) AS count, row_number() OVER (PARTITION BY file, kind ORDER BY count(*) DESC, min(i), value)::INT AS rank FROM e GROUP BY file, kind, value)"""


@query("a1_file_statistics", _S + " SELECT * REPLACE (round(mean_length, 6) AS mean_length, round(mean_keys, 6) AS mean_keys) FROM w")
def a1_full(spark, d):
    return R.file_stats(_found(spark, d), "file").withColumns({c: F.round(c, 6) for c in ("mean_length", "mean_keys")})


@query("a5_exploded_counters", _S + " SELECT * FROM k WHERE rank <= 3")
def a5_full(spark, d):
    return R.counters(_found(spark, d), "file", 3)


@query("a7_risky_files", _S + " SELECT count(*) AS files, sum(rows)::BIGINT AS rows, sum(total_length)::BIGINT AS total_length, sum(warnings)::BIGINT AS warnings, first(file ORDER BY mean_length DESC, file) AS most_descriptive, first(file ORDER BY mean_keys DESC, file) AS richest_metadata, string_agg(file || ': ' || warnings, ', ' ORDER BY warnings DESC, file) FILTER (warnings > 0) AS risky FROM w")
def a7_full(spark, d):
    return R.cross_summary(R.file_stats(_found(spark, d), "file"), "file").withColumn("risky", F.array_join("risky", ", "))


@query("a9_file_summary_tops", _S + """, o AS (SELECT file, kind, CASE WHEN length(trim(value)) <= 60 THEN trim(value) ELSE substr(trim(value), 1, 57) || '...' END AS value FROM k WHERE rank = 1 AND NOT (kind = 'sumber' AND value = '(unknown)'))
SELECT file, rows AS chunks, invalid_json, invalid_schema, rows - valid AS empty_chunks, short_stripped AS short_chunks, coalesce(avg_len, 0) AS avg_len, coalesce(median_len, 0) AS median_len, coalesce(min_len, 0) AS min_len, coalesce(max_len, 0) AS max_len,
 (SELECT count(*) FROM k WHERE k.file = w.file AND kind = 'sumber' AND value <> '(unknown)') AS sources, coalesce((SELECT value FROM o WHERE o.file = w.file AND kind = 'sumber'), '-') AS top_sumber, coalesce((SELECT value FROM o WHERE o.file = w.file AND kind = 'kategori'), '-') AS top_kategori, coalesce((SELECT value FROM o WHERE o.file = w.file AND kind = 'nama_bansos'), '-') AS top_nama_bansos FROM w""")
def a9_full(spark, d):
    return R.file_summary(_found(spark, d), "file")


@query("a15_all_notes", _S + """, s AS (SELECT sum(rows) AS r, greatest(sum(valid), 1) AS v, sum(rows) - sum(valid) AS x, sum(short_stripped) - (sum(rows) - sum(valid)) AS sh, sum(invalid_json) AS ij, sum(invalid_schema) AS ins, sum(has_source) * 100.0::DOUBLE / sum(rows) AS src, sum(has_page) * 100.0::DOUBLE / sum(rows) AS pg, sum(duplicates) AS dup, sum(due) AS due, sum(bad_type) AS bt, sum(bad_priority) AS bp, sum(has_any) AS a,
 array_to_string(list_filter([CASE WHEN sum(unclean_nama_bansos) > 0 THEN 'nama_bansos=' || sum(unclean_nama_bansos) END, CASE WHEN sum(unclean_tipe_konten) > 0 THEN 'tipe_konten=' || sum(unclean_tipe_konten) END, CASE WHEN sum(unclean_tipe_konten_primer) > 0 THEN 'tipe_konten_primer=' || sum(unclean_tipe_konten_primer) END, CASE WHEN sum(unclean_retrieval_priority) > 0 THEN 'retrieval_priority=' || sum(unclean_retrieval_priority) END], lambda z: z IS NOT NULL), ', ') AS u FROM w)
SELECT unnest(range(8))::INT AS place, unnest([CASE WHEN ij + ins = 0 THEN 'OK' ELSE 'WARN' END, CASE WHEN x = 0 THEN 'OK' ELSE 'WARN' END, CASE WHEN sh <= 0.30 * v THEN 'OK' ELSE 'WARN' END, CASE WHEN src >= 99 THEN 'OK' ELSE 'WARN' END, CASE WHEN pg >= 90 THEN 'OK' ELSE 'INFO' END, CASE WHEN dup = 0 THEN 'OK' ELSE 'WARN' END, CASE WHEN u = '' AND bt + bp = 0 THEN 'OK' ELSE 'WARN' END, CASE WHEN a >= 0.90 * v THEN 'OK' ELSE 'INFO' END]) AS level,
 unnest([concat('invalid: ', ij, ' ', ins), concat('empty: ', x, ' ', format('{:.1f}', x * 100.0::DOUBLE / r)), concat('short: ', format('{:.1f}', sh * 100.0::DOUBLE / v)), concat('source: ', format('{:.1f}', src)), concat('page: ', format('{:.1f}', pg)), concat('duplicates: ', dup), concat('clean: ', due, ' ', u, ' type=', bt, ' priority=', bp), concat('context: ', format('{:.1f}', a * 100.0::DOUBLE / v))]) AS note FROM s""")
def a15_full(spark, d):
    return R.notes(_found(spark, d))
