"""Requirements of documents held against profiles, and the official amount of each program."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Ages from which on all ages share a band.
MOST_AGE = 120


def requirements(chunks: DataFrame, keep: list[str], criteria: str = "kriteria_penerima") -> DataFrame:
    """Requirements of the chunks (text, tags) that may hold some: columns of ``keep`` and kind (desil,
    range, min), at (deciles first, then ages, in order), deciles, low, high, phrase."""
    low = F.lower("text")
    may = F.coalesce(F.array_contains("tags", criteria), F.lit(False)) | low.contains("desil") | low.contains("usia") | low.contains("umur")
    none = F.lit(None)
    deciles = F.transform(X.decile_requirements(F.col("text")), lambda x: F.struct(F.lit("desil").alias("kind"), x["deciles"].alias("deciles"), none.cast("int").alias("low"), none.cast("int").alias("high"), x["phrase"].alias("phrase")))
    ages = F.transform(X.age_requirements(F.col("text")), lambda x: F.struct(x["kind"].alias("kind"), none.cast("array<int>").alias("deciles"), x["low"].alias("low"), x["high"].alias("high"), x["phrase"].alias("phrase")))
    return chunks.filter(may).select(*keep, F.posexplode(F.concat(deciles, ages)).alias("at", "need")).select(*keep, "at", "need.*")


def requirement_hints(profiles: DataFrame, hits: DataFrame, chunks: DataFrame, each: int = 3) -> DataFrame:
    """At most ``each`` checks of a profile's numbers for each program, from the chunks that it hit.

    ``profiles``: profile, decile (null: none), ages (array); ``hits``: profile, chunk, rank; ``chunks``:
    chunk, program, page, text, tags. Requirements are taken from each chunk once and meet the profiles
    by the chunk, many to many. Of a chunk's deciles those that pass are shown, all if none does. The
    same requirement of a program is shown once, where it comes first by rank, deciles before ages. The
    quota holds strictly: the checks that come first by rank. Null deciles and profiles without ages
    have no such checks. Columns: profile, program, place, page, kind, phrase, passes, hint.
    """
    needs = requirements(chunks.filter(F.col("program").isNotNull()), ["chunk", "program", "page"])
    met = hits.select("profile", "chunk", "rank").join(needs, "chunk").join(profiles.select("profile", "decile", "ages"), "profile")
    of_age = F.exists("ages", lambda a: (a >= F.col("low")) & (F.col("high").isNull() | (a <= F.col("high"))))
    desil = F.col("kind") == "desil"
    met = met.filter((desil & F.col("decile").isNotNull()) | (~desil & (F.coalesce(F.size("ages"), F.lit(0)) > 0)))
    met = met.withColumn("passes", F.when(desil, F.array_contains("deciles", F.col("decile"))).otherwise(F.coalesce(of_age, F.lit(False))))
    some = F.max(desil & F.col("passes")).over(Window.partitionBy("profile", "chunk", "rank"))
    met = met.withColumn("_some", some).filter(~desil | F.col("passes") | ~F.col("_some"))
    same = ["profile", "program", "kind", "deciles", "low", "high"]
    order = [F.col("rank"), F.col("at"), F.col("chunk")]
    met = met.withColumn("_first", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).filter("_first = 1")
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("profile", "program").orderBy(*order))).filter(F.col("place") <= each)
    verdict = F.when(F.col("passes"), "MEMENUHI").otherwise("TIDAK MEMENUHI")
    head = F.concat(F.lit("- "), "program", F.lit(" | Hal. "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(" | syarat "), "phrase")
    by_decile = F.concat(F.lit(" (nilai: "), F.array_join(F.col("deciles").cast("array<string>"), ", "), F.lit("); profil Desil "), F.col("decile").cast("string"))
    by_age = F.concat(F.lit("; usia pada profil: "), F.array_join(F.col("ages").cast("array<string>"), ", "), F.lit(" tahun"))
    return met.select("profile", "program", "place", "page", "kind", "phrase", "passes", F.concat(head, F.when(desil, by_decile).otherwise(by_age), F.lit(" -> "), verdict, F.lit(".")).alias("hint"))


def of_ages(profiles: DataFrame, needs: DataFrame, salts: int = 16) -> DataFrame:
    """The pairs (profile, need) where some age of the profile lies in the need's range.

    ``profiles``: profile, ages; ``needs``: need, low, high (null: open). A range join as an equality: a
    need stands once for each year it covers (ages from MOST_AGE on share the last), an age meets its
    year, and the bounds are checked once more. So no pair that fails by more than the shared years is
    made. Years are few, so profiles are dealt into ``salts`` parts of each year, and needs are repeated.
    Each pair comes once; null ages, null lower bounds and ranges that fall meet nothing.
    """
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(MOST_AGE))
    people = profiles.select("profile", F.explode(F.array_distinct("ages")).alias("age")).filter("age is not null")
    people = people.withColumn("_year", clamp(F.col("age"))).withColumn("_salt", F.pmod(F.xxhash64("profile"), F.lit(salts)).cast("int"))
    sound = needs.filter(F.col("low").isNotNull() & (F.col("high").isNull() | (F.col("high") >= F.col("low"))))
    years = F.sequence(clamp(F.col("low")), clamp(F.coalesce("high", F.lit(MOST_AGE))))
    spread = sound.select("need", "low", "high", F.explode(years).alias("_year")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = people.join(spread, ["_year", "_salt"]).filter((F.col("age") >= F.col("low")) & (F.col("high").isNull() | (F.col("age") <= F.col("high"))))
    return met.select("profile", "need").distinct()


# The summary of each program: a fold over its chunks in order

#: Characters of a summary; orders whose rows one task folds.
SUMMARY, PART = 620, 50_000
_MAPPED = "program string, part long, had int, marked boolean, has int, now_marked boolean, at long, unit int"


def summary_units(chunks: DataFrame, order: str, length: int = SUMMARY, appendix: str = "lampiran", wanted: str = "nominal_bantuan", keep: tuple[str, ...] = ()) -> DataFrame:
    """program, order, unit, summary and what the fold asks of each aid-amount unit of the chunks
    (program, text, tags, priority, title): ``n`` distinct amounts before and ``has`` after the cut,
    ``marked`` if the summary names an appendix, ``plain`` if the row may replace one that does; and the columns of ``keep``."""
    may = F.coalesce(F.array_contains("tags", wanted), F.lit(False)) | X.is_aid_context(F.col("text"))
    units = chunks.filter((F.coalesce("program", F.lit("")) != "") & may).select("program", F.col(order).alias("at"), "priority", "title", *keep, F.posexplode(X.amount_units(F.col("text"))).alias("unit", "whole"))
    count = lambda c: F.size(F.array_distinct(X.amounts(c)))
    cut = units.withColumn("n", count(F.col("whole"))).filter("n > 0").withColumn("summary", F.regexp_replace(F.substring("whole", 1, length), rf"{X.WS}+\z", ""))
    plain = (F.coalesce("priority", F.lit("")) == "normal") & ~F.lower(F.coalesce("title", F.lit(""))).contains(appendix)
    return cut.select(*keep, "program", "at", "unit", "summary", "n", count(F.col("summary")).alias("has"), F.lower("summary").contains(appendix).alias("marked"), plain.alias("plain"))


def _folded(rows: Iterator[tuple[int, int, bool, bool, object]], entries: list[tuple[int, bool]]) -> dict[tuple[int, bool], tuple]:
    """For each state in which the rows may be entered, the state and row in which they are left.

    A state is what the summary so far has and whether it is marked; (-1, False) is no summary. States
    that a row replaces become one, so few are told apart after the first rows.
    """
    groups: dict[tuple, list] = {}
    for e in entries:
        groups[(*e, None)] = [e]
    for n, has, marked, plain, row in rows:
        moved, stay = [], {}
        for state, members in groups.items():
            old, old_marked, _ = state
            if n > old or (n == old and plain and old_marked):
                moved += members
            else:
                stay[state] = members
        if moved:
            stay.setdefault((has, marked, row), []).extend(moved)
        groups = stay
    return {e: state for state, members in groups.items() for e in members}


def best_summaries(chunks: DataFrame, order: str = "ord", part: int = PART) -> DataFrame:
    """The summary of each program: its units in order, each taking the place of the summary so far if
    it has more distinct amounts than that still has once cut, or as many, being plain, while the summary
    names an appendix.

    The fold depends on order, yet no task holds a program: a part of ``part`` consecutive orders is
    folded for every state in which it may be entered (at most twice the amounts that a summary can hold),
    and each program's parts, a few small rows each, are then run through one after the other. ``order``
    is a number that tells chunks apart; chunks that share one must not, or their units mix.

    Columns: program, ord, unit, summary. Programs without such a unit have no row; null and empty
    programs are none.
    """
    units = summary_units(chunks, order)

    def fold(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("at", "ascending"), ("unit", "ascending")])
        at, unit, n, has, marked, plain = (rows[c].to_pylist() for c in ("at", "unit", "n", "has", "marked", "plain"))
        most = max(n)
        entries = [(-1, False)] + [(k, m) for k in range(most + 1) for m in (False, True)]
        left = _folded(zip(n, has, marked, plain, zip(at, unit, strict=True), strict=True), entries)
        out = [(*e, *s[:2], *s[2]) for e, s in left.items() if s[2] is not None]
        program, p = rows["program"][0].as_py(), rows["part"][0].as_py()
        columns = list(zip(*out, strict=True))
        size = len(out)
        types = [pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64(), pa.int32()]
        return pa.Table.from_arrays([pa.array([program] * size), pa.array([p] * size, pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[f.split()[0] for f in _MAPPED.split(", ")])

    def run_through(group: pa.Table) -> pa.Table:
        parts: dict[int, dict] = {}
        for r in group.to_pylist():
            parts.setdefault(r["part"], {})[r["had"], r["marked"]] = (r["has"], r["now_marked"], r["at"], r["unit"])
        state, best = (-1, False), None
        for p in sorted(parts):  # a state that a part does not list passes it as it is
            if state in parts[p]:
                has, marked, *best = parts[p][state]
                state = has, marked
        return pa.table({"program": [group["program"][0].as_py()], "at": pa.array([best[0]], pa.int64()), "unit": pa.array([best[1]], pa.int32())})

    slim = units.select("program", F.expr(f"at div {part}").cast("long").alias("part"), F.col("at").cast("long").alias("at"), "unit", "n", "has", "marked", "plain")
    mapped = slim.groupBy("program", "part").applyInArrow(fold, _MAPPED)
    chosen = mapped.groupBy("program").applyInArrow(run_through, "program string, at long, unit int")
    # A row for each program: the summaries come from the chunks chosen alone, not from all of them again.
    one = chosen.select(F.col("program").alias("_program"), F.col("at").alias("_at"), F.col("unit").alias("_unit"))
    picked = chunks.join(F.broadcast(one), (F.col("program") == F.col("_program")) & (F.col(order).cast("long") == F.col("_at")))
    found = summary_units(picked, order, keep=("_at", "_unit")).filter("unit = _unit")
    return found.select("program", F.col("_at").alias("ord"), "unit", "summary")
