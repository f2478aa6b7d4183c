"""Payloads, profile signals, eligibility rules and what they enforce."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..functions.text import any_of, contains_any, is_active_status, is_severe, program_label, strip


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def unwrap(payload: Column) -> Column:
    """The content of a JSON payload, else its first user message that is not blank, else the payload."""
    raw = strip(F.coalesce(payload, F.lit("")))
    v = X.whole_json(raw)
    messages = F.from_json(F.to_json(F.try_variant_get(v, "$.messages", "variant")), "array<struct<role string, content string, query string>>")
    said = F.filter(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: strip(F.coalesce(F.nullif(m["content"], F.lit("")), m["query"]))), lambda t: t != "")
    content = F.when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING", strip(F.try_variant_get(v, "$.content", "string")))
    return F.coalesce(content, F.try_element_at(said, F.lit(1)), raw)


def last_user_text(turns: DataFrame) -> DataFrame:
    """The last user turn's text of each conversation; a blank one overwrites what came before."""
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by(strip(F.coalesce("text", F.lit(""))), "turn").alias("text"))


def first_user_text(turns: DataFrame) -> DataFrame:
    """The first user turn's text that is not blank."""
    text = strip(F.coalesce("text", F.lit("")))
    return turns.filter((F.col("role") == "user") & (text != "")).groupBy("conv_id").agg(F.min_by(text, "turn").alias("text"))


def chat_parts(turns: DataFrame) -> DataFrame:
    """The profile lines and number of the last user turn, and labels and scores of the last assistant
    turn's JSON. Profile lines end before a line of scores or a request."""
    last = turns.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("user"), F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    lines = F.split(F.coalesce("user", F.lit("")), "\r?\n")
    marked = F.filter(lines, lambda x: F.contains(x, F.lit("NIK")))
    stop = F.transform(lines, lambda x: strip(x).rlike("^(Skor Prioritas|Tolong)"))
    at = F.array_position(stop, F.lit(True))
    v = X.whole_json(F.col("answer"))
    return last.select(
        "conv_id", strip(F.array_join(F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines), "\n")).alias("profile"),
        F.when(F.contains(F.get(marked, F.lit(0)), F.lit(":")), strip(F.regexp_extract(F.get(marked, F.lit(0)), r"^[^:]*:(.*)$", 1))).otherwise("").alias("nik"),
        *[F.try_variant_get(v, f"$.laporan_evaluasi.kesimpulan.{p}.label", "int").alias(f"label_{p}") for p in ("pkh_plus", "aspd")],
        *[F.try_variant_get(v, f"$.laporan_evaluasi.skor.skor_{p}", "double").alias(f"score_{p}") for p in ("pkh_plus", "aspd")],
    )


def signals(profile: Column) -> Column:
    """Struct (age, decile, status, place, disability) from a profile of JSON or of text lines.

    The lambdas bind the unwrapped text and its JSON, so that both are made once for each row, however
    many fields of the struct are used.
    """
    parsed = F.transform(F.array(unwrap(profile)), lambda t: F.struct(t.alias("t"), X.whole_json(t).alias("v")))
    return F.transform(parsed, lambda x: _signals(x["t"], x["v"]))[0]


def _signals(t: Column, v: Column) -> Column:
    is_json = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False))

    def number(*patterns: str) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(t, f"(?i){p}", 1), F.lit("")).try_cast("int") for p in patterns])

    def line(pattern: str) -> Column:
        return F.nullif(strip(F.regexp_extract(t, f"(?i){pattern}", 1)), F.lit(""))

    def falsy(c: Column, zero: str = "0") -> Column:
        return F.when(~c.isin("", zero, "false"), c)

    report = "$.laporan_evaluasi"
    age_j = F.coalesce(*[falsy(_text(v, p)) for p in (f"{report}.profil_warga.umur", "$.profil_warga.umur", "$.umur")]).try_cast("int")
    decile_j = F.coalesce(*[falsy(_text(v, p)) for p in (f"{report}.parameter.desil_nasional", "$.parameter.desil_nasional", "$.desil_nasional")]).try_cast("int")
    status_j = strip(F.coalesce(*[falsy(_text(v, p), "") for p in (f"{report}.profil_warga.status_dtsen", "$.profil_warga.status_dtsen", f"{report}.parameter.status_dtsen", "$.parameter.status_dtsen", f"{report}.parameter.status_dtsekolah", "$.parameter.status_dtsekolah", "$.status_dtsen", "$.status_dtsekolah")]))
    place_j = strip(F.coalesce(*[falsy(_text(v, p), "") for p in (f"{report}.profil_warga.wilayah", "$.profil_warga.wilayah", "$.wilayah", f"{report}.parameter.lokasi", "$.parameter.lokasi", "$.lokasi")]))
    abilities = F.coalesce(*[F.from_json(F.to_json(F.try_variant_get(v, p, "variant")), "map<string,string>") for p in (f"{report}.parameter.disabilitas", "$.parameter.disabilitas", "$.disabilitas")])
    severe_j = F.coalesce(F.exists(F.map_values(abilities), is_severe), F.lit(False)) | is_severe(_text(v, f"{report}.analisis.disabilitas_fungsi", "$.analisis.disabilitas_fungsi"))
    values = F.transform(F.filter(F.split(t, r"[\n\r|]"), lambda s: F.contains(s, F.lit(":"))), lambda s: F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1))
    severe_t = F.when(F.size(values) > 0, F.exists(values, is_severe)).otherwise(is_severe(t))
    return F.struct(
        F.when(is_json, age_j).otherwise(number(r"umur\s*[:\-]?\s*(\d+)", r"(\d+)\s*tahun")).alias("age"),
        F.when(is_json, decile_j).otherwise(number(r"desil\s*(?:nasional)?\s*[:\-]?\s*(\d+)")).alias("decile"),
        F.when(is_json, status_j).otherwise(line(r"status\s+dtsen\s*[:\-]?\s*([^\n]+)")).alias("status"),
        F.when(is_json, place_j).otherwise(line(r"wilayah\s*[:\-]?\s*([^\n]+)")).alias("place"),
        F.when(is_json, severe_j).otherwise(severe_t).alias("disability"),
    )


_LEAD = "syarat kriteria sasaran penerima bantuan sosial"
#: Words of difficulty in a retrieval query's own test of disability.
_DIFFICULTY = ["banyak kesulitan", "beberapa kesulitan", "tidak bisa", "tidak mampu"]
_FEMALE = r"\bperempuan\b|\bistri\b|\bibu\b"


def retrieval_query(profile: Column) -> Column:
    """A query of the tokens found in a profile, after a fixed lead; without any, the lead and the
    profile's first 300 characters.

    A profile that is a JSON object, once unwrapped, is read by its fields: those of the report first,
    then of the parameters and the root, where empty, zero and false values count as absent. Any other
    text is read by patterns. A field of an unfitting kind counts as absent. Null profiles are empty.
    """
    def built(x: Column) -> Column:
        parts = F.when(F.coalesce(F.startswith(F.schema_of_variant(x["v"]), F.lit("OBJECT<")), F.lit(False)), _json_tokens(x["v"])).otherwise(_text_tokens(x["t"]))
        parts = F.filter(parts, lambda p: p.isNotNull())
        rest = F.concat(F.lit(_LEAD + " "), strip(F.substring(x["t"], 1, 300)))
        return X.let(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.lit(_LEAD + ": "), F.array_join(p, " "))).otherwise(rest))

    return X.let(unwrap(profile), lambda t: X.let(F.struct(t.alias("t"), X.whole_json(t).alias("v")), built))


def _age_tokens(age: Column) -> list[Column]:
    return [F.concat(F.lit("usia "), age.cast("string"), F.lit(" tahun")), F.when(age >= 70, F.lit("lanjut usia 70 tahun ke atas"))]


def _text_tokens(t: Column) -> Column:
    low = F.lower(t)
    age = F.nullif(F.regexp_extract(t, r"(?i)(\d+)\s*tahun", 1), F.lit("")).try_cast("int")
    decile = F.nullif(F.regexp_extract(t, r"(?i)desil\s*(?:nasional)?\s*[:\-]?\s*(\d+)", 1), F.lit(""))
    place = F.nullif(F.substring(strip(F.regexp_extract(t, r"(?iU)((?:kec\.?|kecamatan|kelurahan|kabupaten|kota)\s+[\w\s,]+)", 1)), 1, 80), F.lit(""))
    registry = F.when(contains_any(low, ["dtsen aktif", "dtks aktif", "terdaftar dtks", "terdaftar dtsen"]), F.lit("terdaftar DTSEN DTKS")).when(contains_any(low, ["dtsen", "dtks"]), F.lit("DTSEN DTKS"))
    return F.array(
        *_age_tokens(age), F.concat(F.lit("desil "), decile), registry, F.when(contains_any(low, _DIFFICULTY), F.lit("penyandang disabilitas")), F.when(low.rlike(_FEMALE), F.lit("perempuan")), place,
    )


def _json_tokens(v: Column) -> Column:
    report = "$.laporan_evaluasi"

    def first(*paths: str) -> Column:
        """The first field that is not empty, zero or false, as text."""
        return F.coalesce(*[F.when(~F.try_variant_get(v, p, "string").isin("", "0", "0.0", "false", "[]", "{}"), F.try_variant_get(v, p, "string")) for p in paths])

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))

    aged = F.coalesce(*[F.when(first(p).isNotNull(), F.struct(kind(p).alias("kind"), strip(first(p)).alias("text"))) for p in (f"{report}.profil_warga.umur", "$.umur")])
    age = F.when(aged["text"].rlike(r"^[+-]?\d+$"), aged["text"].try_cast("int")).when(aged["kind"] != "STRING", aged["text"].try_cast("double").cast("int"))
    registry_text = F.lower(first("$.parameter.status_dtsekolah", "$.status_dtsekolah"))
    registry = F.when(F.contains(registry_text, F.lit("aktif")), F.lit("terdaftar DTSEN DTKS")).when(contains_any(registry_text, ["dtsen", "dtks"]), F.lit("DTSEN DTKS"))
    held = lambda p: F.when(~F.coalesce(F.to_json(F.try_variant_get(v, p, "variant")).isin("{}", "[]", '""', "0", "false", "null"), F.lit(True)), F.try_variant_get(v, p, "variant"))
    fields = F.from_json(F.to_json(F.coalesce(held("$.parameter.disabilitas"), held("$.disabilitas"))), "map<string,string>")
    hard = F.coalesce(F.exists(F.map_values(fields), lambda x: F.coalesce(contains_any(F.lower(x), _DIFFICULTY), F.lit(False))), F.lit(False))
    told = F.coalesce(contains_any(F.lower(first(f"{report}.analisis.disabilitas_fungsi")), _DIFFICULTY), F.lit(False))
    names = F.lower(F.concat_ws(" ", first(f"{report}.profil_warga.nama", "$.nama"), first(f"{report}.profil_warga.hubungan_kepala_keluarga")))
    return F.array(
        *_age_tokens(age), F.concat(F.lit("desil "), first("$.parameter.desil_nasional", "$.desil_nasional")), registry, F.when(hard | told, F.lit("penyandang disabilitas")),
        F.when(names.rlike(_FEMALE), F.lit("perempuan")), F.substring(strip(first("$.parameter.lokasi", "$.lokasi")), 1, 80),
    )


def is_profile(text: Column) -> Column:
    """P10: whether a query is a profile: a signal, a telling word, or mostly lines of key and value."""
    s = signals(text)
    found = s["age"].isNotNull() | s["decile"].isNotNull() | s["status"].isNotNull() | s["disability"]
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    pairs = F.size(F.filter(lines, lambda x: x.rlike("[:-]")))
    keyed = (F.size(lines) > 2) & (pairs / F.size(lines) > 0.5)
    return F.coalesce((strip(text) != "") & (found | contains_any(F.lower(text), ["nik", "nama", "no. kk", "kepala keluarga"]) | keyed), F.lit(False))


def inferred_sources(s: Column) -> Column:
    """Sources that a profile's signals call for: disability up to 60, then age from 70 up to decile 4."""
    a = F.coalesce(s["disability"], F.lit(False)) & (s["age"].isNull() | (s["age"] <= 60))
    b = F.coalesce(s["age"] >= 70, F.lit(False)) & (s["decile"].isNull() | (s["decile"] <= 4))
    found = F.filter(F.array(F.when(a, fixed.DISABILITY_SOURCE), F.when(b, fixed.ELDERLY_SOURCE)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


#: Names of the field of existing aid, and spellings of none.
_AID_KEYS = ["bansos", "bantuan_sosial", "bantuan sosial"]
_NO_AID = ["", "-", "[]", "null", "none", "tidak ada", "belum ada", "belum menerima", "belum mendapatkan", "tidak menerima"]
_TOKEN = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]+)'


def _found_aid(json: Column) -> Column:
    """What the first field of existing aid in a valid JSON text says: true if there is none, false if
    there is some, null without such a field.

    Fields are met in the order of the text, each before what it holds, so the first is the first depth
    first. A null is not found: the object that holds it is then left, and the search goes on behind it.
    One pass over the tokens; a variant would not do, since it sorts an object's fields.
    """
    tokens = F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("boolean").alias("none"))

    def met(all_tokens: Column) -> Column:
        rows = F.transform(all_tokens, lambda t, i: F.struct(t.alias("t"), F.get(all_tokens, i + 1).alias("colon"), F.get(all_tokens, i + 2).alias("value"), F.get(all_tokens, i + 3).alias("more")))

        def text(t: Column) -> Column:
            return F.lower(strip(F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")))

        def step(s: Column, x: Column) -> Column:
            t, value = x["t"], x["value"]
            opens, closes = t.isin("{", "["), t.isin("}", "]")
            depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
            left = F.when(closes & (s["left"] == s["depth"]), F.lit(None).cast("int")).otherwise(s["left"])
            key = F.startswith(t, F.lit('"')) & (x["colon"] == ":") & s["left"].isNull() & s["none"].isNull()
            hit = F.when(key, text(t).isin(_AID_KEYS)).otherwise(False)
            none = F.when(F.startswith(value, F.lit('"')), text(value).isin(_NO_AID)).otherwise((value == "[") & (x["more"] == "]"))
            return F.struct(depth.alias("depth"), F.when(hit & (value == "null"), s["depth"]).otherwise(left).alias("left"), F.when(hit & (value != "null"), none).otherwise(s["none"]).alias("none"))

        return F.aggregate(rows, start, step, lambda s: s["none"])

    return X.let(tokens, met)


def no_existing_aid(profile: Column) -> Column:
    """Whether a profile says that there is no existing aid: by the first such field of a JSON
    profile; where that has none, or only nulls, and in other profiles, by the first such line.

    Values that are no text and no list say that there is some. Null profiles say nothing: false.
    """
    said = F.regexp_extract(profile, r"(?imU)^\s*-?\s*bansos\s*[:：]\s*([^\r\n]*)", 1)
    there = profile.rlike(r"(?imU)^\s*-?\s*bansos\s*[:：]")
    by_line = F.coalesce(there & F.lower(strip(said)).isin(_NO_AID), F.lit(False))
    return F.coalesce(F.when(X.whole_json(profile).isNotNull(), _found_aid(profile)), by_line)


def key_points(profile: Column) -> Column:
    """Struct of the features that a profile's summary lists."""
    low = F.lower(profile)
    ages = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)\s*tahun"), F.lit(1)), lambda a: a.try_cast("int"))
    # Words of old age, and of trade.
    old, trade = ["lansia", "lanjut usia", "kakek", "nenek"], ["usaha", "wirausaha", "berdagang", "jualan", "dagang", "jahit", "bengkel", "warung", "toko", "kue", "masak"]
    return F.struct(
        F.nullif(F.regexp_extract(profile, r"(?i)desil\s*(\d+)", 1), F.lit("")).alias("decile"), contains_any(low, ["dtks", "dtsen", "terdata dalam", "terdaftar dalam"]).alias("registered"),
        F.contains(low, F.lit("disabilitas")).alias("disability"), (F.exists(ages, lambda a: a >= 70) | contains_any(low, old)).alias("elderly"),
        low.rlike("perempuan|istri|ibu").alias("female"), contains_any(low, trade).alias("trade"), F.nullif(F.regexp_extract(profile, r"(?i)(\d+)\s*orang", 1), F.lit("")).alias("members"),
        F.nullif(F.substring(strip(F.regexp_extract(profile, r"(?i)((?:kecamatan|kelurahan|kota|kabupaten)\s+[\w\s]+)", 1)), 1, 60), F.lit("")).alias("place"),
    )


def hard_rules(profiles: DataFrame, s: str = "signals") -> DataFrame:
    """G1: two rows for each profile: program, source, eligible and the reasons against, in order."""
    age, decile, disability = (F.col(f"{s}.{c}") for c in ("age", "decile", "disability"))
    inactive = F.coalesce(~is_active_status(F.col(f"{s}.status")), F.lit(False))

    def reasons(*pairs: tuple[Column, str]) -> Column:
        return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda r: r.isNotNull())

    elderly = reasons((age.isNull(), "age unknown"), (age < 70, "age below 70"), (decile.isNull(), "decile unknown"), (decile > 4, "decile above 4"), (inactive, "status inactive"))
    disabled = reasons((age.isNull(), "age unknown"), (age > 60, "age above 60"), (decile.isNull(), "decile unknown"), (decile > 5, "decile above 5"), (~F.coalesce(disability, F.lit(False)), "no severe disability"), (inactive, "status inactive"))
    rows = F.array(*[F.struct(F.lit(i).alias("rule_order"), F.lit(p).alias("program"), F.lit(src).alias("source"), r.alias("reasons")) for i, (p, src, r) in enumerate(((fixed.ELDERLY_PROGRAM, fixed.ELDERLY_SOURCE, elderly), (fixed.DISABILITY_PROGRAM, fixed.DISABILITY_SOURCE, disabled)))])
    out = profiles.withColumn("_x", F.explode(rows)).select(*profiles.columns, "_x.*")
    return out.withColumn("eligible", F.size("reasons") == 0)


def fallback(s: Column) -> Column:
    """Struct (elderly, disabled): eligibility without a model's answer. The status needs only to hold
    the word for active; the second program does not ask for it."""
    active = F.coalesce(F.contains(F.lower(s["status"]), F.lit("aktif")), F.lit(False))
    return F.struct(
        (F.coalesce((s["age"] >= 70) & (s["decile"] <= 4), F.lit(False)) & active).alias("elderly"),
        (F.coalesce(s["disability"], F.lit(False)) & F.coalesce((s["age"] <= 60) & (s["decile"] <= 5), F.lit(False))).alias("disabled"),
    )


def _filled(template: str, **values: Column) -> Column:
    """A sentence with its named gaps filled; null if a value is."""
    out = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        out.append(values[part].cast("string") if i % 2 else F.lit(part))
    return F.concat(*out)


def fallback_answers(profiles: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """An answer without a model, as rows: profile_id, program, list, rank, status, source, reason,
    summary, plan.

    ``profiles``: profile_id and profile; score_elderly and score_disabled, where there, end the reasons.
    Each profile has a row for either program: recommended in the fixed order with the citation of its
    source (``citations``: profile_id, source, citation; else the source itself), or unsuitable with every
    condition that fails. ``summary`` names the signals, or repeats the first 500 characters without any;
    ``plan`` names the recommended programs, null without one. Null profiles have no signals.
    """
    scores = [F.col(c).cast("string") if c in profiles.columns else F.lit(None).cast("string") for c in ("score_elderly", "score_disabled")]
    # explode_outer() over one struct: signals are found once a row, however many fields are used.
    once = F.struct(F.coalesce("profile", F.lit("")).alias("profile"), scores[0].alias("_s0"), scores[1].alias("_s1"), signals(F.col("profile")).alias("s"))
    own = profiles.select("profile_id", F.explode_outer(F.array(once)).alias("_o")).select("profile_id", "_o.*")
    s, age, decile = F.col("s"), F.col("s.age"), F.col("s.decile")
    values = {"age": age, "decile": decile}
    ok = fallback(s)
    active = F.coalesce(F.contains(F.lower(s["status"]), F.lit("aktif")), F.lit(False))
    told = F.concat_ws("; ", F.concat(F.lit("umur "), age.cast("string"), F.lit(" tahun")), F.concat(F.lit("desil nasional "), decile.cast("string")), F.nullif(s["status"], F.lit("")), F.nullif(s["place"], F.lit("")))
    summary = F.when(told != "", F.concat(F.lit("Profil warga: "), told)).otherwise(F.substring("profile", 1, 500))

    def failing(texts: dict[str, str], **conditions: Column) -> Column:
        said = F.concat_ws("; ", *[F.when(c, _filled(texts[k], **values)) for k, c in conditions.items()])
        return F.when(said != "", F.concat(F.lit(texts["lead"]), said, F.lit("."))).otherwise(F.lit(texts["none"]))

    elder = failing(fixed.ELDERLY_FAILS, young=F.coalesce(age < 70, F.lit(False)), no_age=age.isNull(), decile=F.coalesce(decile > 4, F.lit(False)), status=~active)
    disabled = failing(fixed.DISABILITY_FAILS, able=~F.coalesce(s["disability"], F.lit(False)), old=F.coalesce(age > 60, F.lit(False)), decile=F.coalesce(decile > 5, F.lit(False)))
    rows = [
        (fixed.ELDERLY_PROGRAM, fixed.ELDERLY_SOURCE, ok["elderly"], F.when(ok["elderly"], _filled(fixed.ELDERLY_FITS, **values)).otherwise(elder), F.col("_s0")),
        (fixed.DISABILITY_PROGRAM, fixed.DISABILITY_SOURCE, ok["disabled"], F.when(ok["disabled"], _filled(fixed.DISABILITY_FITS, **values)).otherwise(disabled), F.col("_s1")),
    ]
    each = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(p).alias("program"), F.lit(src).alias("source"), fits.alias("fits"), F.concat(why, F.coalesce(F.concat(F.lit(" Skor Tim 1: "), score, F.lit(".")), F.lit(""))).alias("reason")) for i, (p, src, fits, why, score) in enumerate(rows)])
    fitting = F.transform(F.filter(each, lambda x: x["fits"]), lambda x: x["program"])
    head, tail = fixed.FIELD_PLAN.split("{programs}")
    plan = F.when(F.size(fitting) > 0, F.concat(F.lit(head), F.array_join(fitting, ", "), F.lit(tail)))
    flat = own.select("profile_id", summary.alias("summary"), plan.alias("plan"), fitting.alias("_fit"), F.explode(each).alias("x")).select("profile_id", "summary", "plan", "_fit", "x.*")
    if citations is not None:
        flat = flat.join(citations.select("profile_id", "source", "citation"), ["profile_id", "source"], "left")
    cited = F.coalesce("citation", "source") if citations is not None else F.col("source")
    fits = F.col("fits")
    return flat.select(
        "profile_id", "program", F.when(fits, "recommended").otherwise("unsuitable").alias("list"), F.when(fits, F.array_position("_fit", F.col("program")).cast("int")).alias("rank"), F.when(fits, "ELIGIBLE").otherwise("TIDAK_ELIGIBLE").alias("status"),
        F.when(fits, cited).alias("source"), "reason", "summary", "plan",
    )


def enforce(answers: DataFrame, rules: DataFrame, key: str = "profile_id") -> DataFrame:
    """A model's lists (key, list, program, place) under the rules: programs unknown to the rules go;
    an eligible program is recommended, another is not, whatever the model said. Recommended programs
    that the model had recommended come first, in its order, then the others in the rules' order."""
    named = answers.withColumn("program", program_label(F.col("program")))
    listed = named.filter("list = 'recommended'").groupBy(key, "program").agg(F.min("place").alias("said"))
    out = rules.join(listed, [key, "program"], "left")
    order = Window.partitionBy(key, "eligible").orderBy(F.col("said").asc_nulls_last(), "rule_order")
    return out.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order))).select(key, "program", F.when(F.col("eligible"), "recommended").otherwise("rejected").alias("list"), "rank", "reasons")


def has_placeholder(strings: Column, marks: list[str]) -> Column:
    """A text of the list that holds a mark of an unfilled template."""
    return F.exists(strings, lambda x: any_of([F.contains(F.lower(x), F.lit(m.lower())) for m in marks]))
