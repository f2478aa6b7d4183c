"""Ranked search, quality rules and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lumbung.llm import op11_maxscore as op11
from lumbung.llm import op12_quality as op12
from lumbung.llm import op13_periodic as op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, runs string, rank string, score string, _c0 int, lines string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "n", "k", "r", "a", "s", 1, "l") for i, t, lang, source in rows], SCHEMA).repartition(3)


def prose(rng, n, size=60):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(size)]
    return " ".join(rng.choice(words) for _ in range(n))


# --- op11 ---------------------------------------------------------------------------------------


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, query in wanted.items():
        found = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in query if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_docs,shard_postings,block_pairs", [(32_768, 1_000_000, 500_000), (3, 1_000_000, 40), (50, 20, 500_000)])
def test_search(spark, shard_docs, shard_postings, block_pairs):
    rng = random.Random(11)
    texts = [prose(random.Random(k % 3), rng.randint(1, 80)) for k in range(120)] + [None, "", " .,", "É é ß日本 x1", "X1 x1 X1", "a" * 30_000, prose(rng, 4000)]
    docs = [(k if k % 7 else None if k == 14 else k, t) for k, t in enumerate(texts)]
    docs += [docs[3], docs[3], docs[40], (900, docs[5][1]), (-4, docs[5][1])]
    items = [(k, prose(random.Random(k % 3), 12)) for k in range(9)] + [(50, None), (51, "nothing-of-this 'zzzzzzzzz'"), (52, "x1 É, 日本 ß日本"), (2, "X1"), (2, "X1"), (None, "x1 " + texts[0])]
    df = frame(spark, [(i, t, None, None) for i, t in docs])
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    found = op11.search(df, asked, 10, shard_docs, shard_postings, block_pairs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b", "x", "y")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert op11.search(docs.filter("false"), items).count() == 0
    assert op11.search(docs, items.filter("false")).count() == 0
    assert op11.search(docs, items).count() == 1


def test_maxscore_skips_lists():
    """With one rare and one frequent term, documents with the frequent term alone are never scored."""
    texts = [(k, "common" + (" rare" if k < 20 else "")) for k in range(2000)]
    shard = op11._Building()
    for i, t in texts:
        found = Counter(terms(t))
        shard.keys.append(op11.np.array(sorted({"common": 0, "rare": 1}[w] for w in found), op11.np.int64) << 32 | len(shard.ids))
        shard.counts.append(op11.np.ones(len(found), op11.np.int64))
        shard.ids.append(i), shard.lengths.append(sum(found.values()))
    row = dict(zip([f.split()[0] for f in op11._SHARD.split(", ")], shard.row(), strict=True))
    corpus = op11.Corpus(2000, 2020)
    made = op11._Shard(row, corpus, op11.np.array([corpus.weight(2000), corpus.weight(20)]))
    score, found = op11.search_shard(made, [0, 1], 10, 0)
    assert sorted(found.tolist()) == list(range(20)) and len(score) == 20


# --- op12 ---------------------------------------------------------------------------------------


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def brute_verdicts(rows, enough):
    found = [(lang, source, base(t)) for _, t, lang, source in rows]
    value = lambda m: (10000 * m[2] // max(m[0], 1), 10000 * m[4] // max(m[3], 1), 10000 * m[5] // max(m[0], 1), 1000 * m[1] // max(m[0], 1))
    bucket = lambda v: v >> max(len(f"{v:b}") - 8, 0) << max(len(f"{v:b}") - 8, 0)
    bad = lambda m: m[0] < 50 or 100 * m[5] > 50 * m[0]
    groups = defaultdict(list)
    for lang, source, m in found:
        if not bad(m):
            groups[lang, source].append(value(m)), groups[lang, ...].append(value(m))
    out = []
    for lang, source, m in found:
        failed = []
        if not bad(m):
            own = groups[lang, source] if len(groups[lang, source]) >= enough else groups[lang, ...]
            for k, (name, least) in enumerate((("symbols", 250), ("lines", 900), ("repeats", 500), ("length", 200))):
                b = sorted(bucket(v[k]) for v in own)
                q1, q3 = b[-(-len(b) // 4) - 1], b[-(-3 * len(b) // 4) - 1]
                spread = 6 * max(q3 - q1, least)
                if value(m)[k] > q3 + spread or (name == "length" and value(m)[k] < q1 - spread):
                    failed.append(name)
        out.append((*m, bad(m), ",".join(failed), not bad(m) and not failed))
    return out


def quality_rows():
    rng = random.Random(12)
    rows = []
    for k in range(300):
        lang, source = ["en", "fr", None][k % 3], ["a", "b", None, "a", "a"][k % 5]
        text = "\n".join(prose(rng, rng.randint(5, 40), 400) for _ in range(rng.randint(1, 8)))
        if k % 17 == 0:
            text = text.replace(" ", " $$ ")
        if k % 23 == 0:
            text += ("\n" + text.split("\n")[0]) * 6
        if k % 29 == 0:
            text = re.sub(r"\w+", lambda m: m[0] * 4, text)
        rows.append((k, text, lang, source))
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, " \n\t ", None, None), (403, "é 日本 " * 40, "en", "a"), (404, "x" * 50_000, "rare", "z"), (405, prose(rng, 9000, 3000), "rare", "z")]
    rows += [(406, " ".join(f"w{k} x y" for k in range(60)), "rare", "z"), (None, rows[1][1], "en", "b"), rows[2], rows[2]]
    return rows


@pytest.mark.parametrize("enough", [10, 1000])
@pytest.mark.parametrize("most", [50_000, 0])
def test_quality(spark, enough, most, monkeypatch):
    monkeypatch.setattr(op12, "MOST_GROUPS", most)
    rows = quality_rows()
    found = op12.judged(frame(spark, rows), ["doc_id", "lines", "kept"], enough=enough)
    assert found.columns == ["doc_id", "lines", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rules_failed", "kept"]
    own = sorted(((r[0], *r[2:]) for r in found.collect()), key=repr)
    want = sorted(((i, *v) for (i, *_), v in zip(rows, brute_verdicts(rows, enough), strict=True)), key=repr)
    assert own == want
    assert {r for *_, failed, _ in want for r in failed.split(",")} >= {"symbols", "length"}


def test_sketches_merge_in_any_order(spark):
    df = frame(spark, quality_rows())
    rows = op12.measured(df, [])
    again = op12.measured(df.repartition(7, "text"), [])
    whole = sorted(map(tuple, op12.fences(op12.sketches(rows), ["lang"]).collect()), key=repr)
    parts = op12.sketches(again.filter("n_words % 2 = 0")).unionAll(op12.sketches(again.filter("n_words % 2 = 1")))
    assert sorted(map(tuple, op12.fences(parts, ["lang"]).collect()), key=repr) == whole
    assert op12.judged(df.filter("false"), ["doc_id"]).count() == 0


def test_many_distinct_words():
    rng = random.Random(1)
    words = [str(rng.randrange(60)).encode() for _ in range(300)]
    assert op12.repeat_words(words) == base(" ".join(w.decode() for w in words))[5]


# --- op13 ---------------------------------------------------------------------------------------


def brute_runs(words, least=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *own, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_small_alphabets():
    rng = random.Random(13)
    for k in range(1500):
        words = [str(rng.randrange(1 + k % 4)).encode() for _ in range(rng.randint(0, 70))]
        if k % 3 == 0:
            words = (words[:9] * 6)[: rng.randint(0, 50)] + words
        least = (12, 4, 7)[k % 5 % 3]
        assert sorted(op13.text_runs(words, least)) == brute_runs(words, least), words


def test_mask_keeps_every_run():
    rng = random.Random(14)
    for _ in range(300):
        words = [str(rng.randrange(40)) for _ in range(120)]
        at, q = rng.randrange(60), rng.randrange(1, 20)
        words[at : at + 60] = (words[at : at + q] * 60)[:60]
        kept = op13.surviving(op13.numbered([w.encode() for w in words]), 12)
        for s, n, _ in brute_runs(words):
            assert any(a <= s and s + n <= b for a, b in kept)


def test_periodic_runs(spark):
    rng = random.Random(15)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(80)]
    texts += [prose(rng, 4) + "\n" + "a b c " * k + prose(rng, 5) for k in range(12)] + ["x " * 11, "x " * 12, "a b c d e f g " * 2, "a b c d e f " * 2, "é é\t日本 " * 9]
    texts += [None, "", " \n ", "x" * 40_000, "a b " * 3000 + prose(rng, 3000, 900)]
    rows = [(k * 7 - 30, t, None, None) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    found = op13.digests(op13.periodic_runs(frame(spark, rows), ["doc_id", "lang", "runs"], edit=op13.planted))
    want = [expected(i, planted(i, WORD.findall(t or ""))) for i, t, *_ in rows if len(t or "") < 9000]
    own = {r.doc_id: tuple(r) for r in found.collect()}
    assert all(own[w[0]] == w for w in want)
    assert sum(w[1] > 0 for w in want) > 15
    plain = op13.periodic_runs(frame(spark, [*rows, (None, texts[90], "l", None)]), ["doc_id", "lang", "lines", "kept"])
    assert plain.columns == ["doc_id", "lang", "lines", "kept", "n_words", "runs", "collapsed"]
    assert plain.count() == len(rows) + 1
    assert plain.filter("doc_id is null").first().lang == "l"
    assert op13.periodic_runs(frame(spark, rows).filter("false"), ["doc_id"]).count() == 0
    long = [r for r in plain.filter("doc_id = %d" % rows[len(texts) - 1][0]).collect()][0]
    assert (0, 6000, 2) in [tuple(r) for r in long.runs] and long.n_words == 9000
