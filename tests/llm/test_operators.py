"""The ten operators against brute force, on a table with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumbung.llm import op1_imatch, op2_bpe_count, op3_covertree, op4_jaccard, op5_records, op6_langid, op7_mixing, op8_sharding, op9_packing, op10_substrings
from lumbung.llm.common import new_folder
from lumbung.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label string, next string, b int"


def make_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeghilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, shared = text(200), text(70)
    out = [None, "", "   ", "\n", "a", "A b", text(3), text(4), text(49), text(50), base, base, base.upper(), base + " tail"]
    for k in range(12):  # near copies
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [f"{text(30)} {shared}\t{text(40)}" for _ in range(4)] + [shared, shared + "\n" + shared]
    out += [text(rng.randint(5, 300)) for _ in range(60)] + [text(9000), "x" * 20000, "<|endoftext|> it's <|startoftext|>né É ß   日本"]
    return out


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 - 20, t, ["en", "fr", None][i % 3], ["s1", "s0", None, "s1", "s1"][i % 5], len(t or ""), "x", "y", "z", "n", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def rows_of(df, key="doc_id"):
    rows = df.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1(docs, none, texts):
    found = rows_of(op1_imatch.fingerprints(docs))
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        assert found[i].n_chars == len(t)
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        if edited == t:
            assert found[i].fingerprint == found[i].edited_fingerprint and found[i].near_edited == 1
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t or ""].add(found[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [found[i] for i in order if len(texts[i] or "") > 600]
    assert sum(r.near_edited for r in long) > 3 * sum(r.near_next for r in long if r.near_next < 1)
    assert op1_imatch.fingerprints(none).count() == 0
    one = docs.filter("doc_id = 22").unionByName(docs.filter("doc_id = 22"))
    assert op1_imatch.fingerprints(one).count() == 2


def test_op2(docs, none, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = rows_of(op2_bpe_count.token_counts(docs, path))
    for i, t in texts.items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert op2_bpe_count.token_counts(none, path).count() == 0


def test_op2_random_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(path), op2_bpe_count.counter(path), random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(" \n\t aAbéß'sdll12,.!日|<>") for _ in range(rng.randint(0, 30)))
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def brute_links(vectors):
    sound = [(i, l, np.array(v, float)) for i, v, l in vectors if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {(a[0], b[0]) for k, a in enumerate(sound) for b in sound[:k] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / math.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= 0.98}
    return links


def roots(ids, links):
    up = {i: i for i in ids}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [16, 4096])
def test_op3(spark, block):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in rng.normal(size=8)], k % 3) for k in range(60)]
    vectors += [(100 + k, [float(np.float32(x + rng.normal() * 0.06)) for x in vectors[k % 4][1]], vectors[k % 4][2]) for k in range(60)]
    vectors += [(200 + k, vectors[0][1], 0) for k in range(30)]
    vectors += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, [1.0, None] * 4, 1), (304, vectors[0][1], None), (305, [], 1), (306, [1.0], 1), (307, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(i, v, l, 1, 2) for i, v, l in vectors], "vec_id long, embedding array<float>, label int, id int, h int")
    single = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    links = brute_links(single)
    n = Counter(x for pair in links for x in pair)
    component = roots([v[0] for v in vectors], links)
    found = rows_of(op3_covertree.near_duplicates(df, block=block), "vec_id")
    assert len(found) == len(vectors)
    for i, r in found.items():
        assert (r.n_links, r.component_id, r.kept) == (n[i], component[i], component[i] == i)
    assert op3_covertree.near_duplicates(df.filter("false")).count() == 0


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("rule, block", [((4, 85, 100), 2048), ((5, 80, 100), 4)])
def test_op4(docs, none, texts, rule, block, monkeypatch):
    monkeypatch.setattr(op4_jaccard, "BLOCK", block)
    n, num, den = rule
    sets = {i: shingles(t, n) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    component = roots(list(sets), links)
    found = rows_of(op4_jaccard.near_duplicates(docs, op4_jaccard.Rule(*rule)))
    assert links and {i: (r.n_shingles, r.component_id) for i, r in found.items()} == {i: (len(sets[i]), component[i]) for i in sets}
    assert op4_jaccard.near_duplicates(none).count() == 0


def test_components_by_rounds(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 480)]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    expected = roots(nodes, links)
    for limit in (10**6, 0):
        assert {r.node: r.label for r in components(df, one_task=limit).collect() if r.node in nodes} == expected


def test_rounds_of_components_keep_size_estimates_small(spark):
    """The driver's estimate of a plan's size is about that of its rows, however many rounds of joins made them."""
    links = spark.range(1, 400).select(F.expr("pmod(id * 7919, 1009)").alias("a"), F.expr("pmod((id - 1) * 7919, 1009)").alias("b"))
    found = components(links, one_task=0)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1_000_000
    assert {(r.node, r.label) for r in found.collect()} == {(r.node, r.label) for r in components(links).collect()}


def test_op5(spark, docs, none, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = op5_records.write_records(docs, path, new_folder(spark, "t"))
    found = rows_of(op5_records.read_back(manifest))
    start = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = manifest.collect()[0]
    store, rec = op5_records.opened(some.rec)
    offsets = op5_records.read_index(store, op5_records.opened(some.idx)[1])
    assert len(offsets) == some.n_records
    doc_id, ids = op5_records.read_record(store, rec, int(offsets[-1]))
    assert len(ids) == found[doc_id].n_tokens
    with store.open_input_stream(rec) as f:
        data = bytearray(f.read())
    data[20] ^= 1
    import io

    with pytest.raises(ValueError):
        op5_records.parse(io.BytesIO(bytes(data)))
    assert op5_records.read_back(op5_records.write_records(none, path, new_folder(spark, "t"))).count() == 0


def test_op6(spark, none):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in op6_langid.query(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in data.select("doc_id", "lang").collect()}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i, r in found.items() if r.held_out]
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.99 * len(held)
    assert op6_langid.identify(none, ["doc_id"]).count() == 0
    model = op6_langid.train({"x": [b"abababab"], "y": [b"cdcdcdcd"]})
    odd = op6_langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "123 $$"), (4, "abab"), (5, "cd" * 800_000)], "doc_id long, text string"), model, ["doc_id"])
    assert {r.doc_id: r.lang_pred for r in odd.collect()} == {1: "und", 2: "und", 3: "und", 4: "x", 5: "y"}


def test_op6_code_lengths():
    """The frozen code length of a text is that of a plain PPM coder over the same counts."""
    sample = [b"the cat and the hat", b"then that"]
    model = op6_langid.train({"x": sample})
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in sample:
        t = b"\n\n\n" + t
        for p in range(3, len(t)):
            for k in range(4):
                counts[k][t[p - k : p]][t[p]] += 1
    total = Counter()
    for k in range(1, 4):
        for c, after in counts[k].items():
            total[c] = sum(after.values())
    def bits(text):
        data, out = b"\n\n\n" + text, 0.0
        for p in range(3, len(data)):
            for k in (3, 2, 1, 0):
                c = data[p - k : p]
                if (k and total[c] < op6_langid.LEAST_SEEN) or c not in counts[k]:
                    continue
                after = counts[k][c]
                whole = sum(after.values()) + len(after)
                if data[p] in after:
                    out -= math.log2(after[data[p]] / whole)
                    break
                out -= math.log2(len(after) / whole)
            else:
                out += 8
        return out
    for text in (b"the cat", b"that hat then", b"zebra", b""):
        assert abs(model.bits(text)[0] - bits(text)) < 1e-3


def test_op7(docs, none, texts):
    rows = rows_of(op7_mixing.mix(docs, ["doc_id", "source"]))
    again = rows_of(op7_mixing.mix(docs.repartition(7), ["doc_id", "source"]))
    assert rows == again
    sizes = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    assert {i: r["size"] for i, r in rows.items()} == sizes
    by = defaultdict(int)
    for i, r in rows.items():
        by[r.source] += sizes[i]
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, able = dict.fromkeys(names, 0.0), 1.5 * sum(by.values()), set(names)
    while left > 1e-9 and able:
        share = left / sum(weight[s] for s in able)
        left = 0.0
        for s in list(able):
            target[s] += share * weight[s]
            if target[s] >= 2 * by[s]:
                left += target[s] - 2 * by[s]
                target[s] = 2.0 * by[s]
                able.discard(s)
    for s in names:
        own = [r for r in rows.values() if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == by[s] for r in own)
        assert abs(sum(r.copies * r["size"] for r in own) - target[s]) <= max(r["size"] for r in own)
        assert all(0 <= r.copies <= 2 for r in own)
    assert op7_mixing.mix(none, ["doc_id"]).count() == 0


def test_op8(docs, none, texts):
    found = rows_of(op8_sharding.shard_records(docs, [1.0] * 40))
    slots = defaultdict(list)
    for i, t in texts.items():
        data = (t or "").encode()
        assert (found[i]["size"], found[i].text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert found[i].grown_shard in (found[i].shard, 40)
        slots[found[i].shard].append(found[i].slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    more = rows_of(op8_sharding.shard_records(docs, [1.0] * 41))
    assert {i: r.grown_shard for i, r in found.items()} == {i: r.shard for i, r in more.items()}
    heavy = Counter(r.shard for r in op8_sharding.shard_records(docs.sparkSession.range(4000).selectExpr("id as doc_id", "'a' as text"), [3.0, 1.0]).collect())
    assert 2.6 < heavy[0] / heavy[1] < 3.4
    assert op8_sharding.shard_records(none, [1.0] * 3).count() == 0


@pytest.mark.parametrize("items", [50_000, 7])
def test_op9(docs, none, texts, items):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = op9_packing.pack_documents(docs, path, capacity=512, items=items).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    total = 0
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, s, min(512, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 512))]
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes()) for s in range(0, len(ids), 512)]
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(by_bin) <= (1.02 if items > 100 else 1.3) * math.ceil(total / 512) + 2
    assert op9_packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("window, block", [(50, 25), (6, 3)])
def test_op10(docs, none, texts, window, block):
    first, expected = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone, own = [False] * len(w), []
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            own.append(key)
            if key in first:
                gone[p : p + window] = [True] * window
        for key in own:
            first.setdefault(key, i)
        expected[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    found = rows_of(op10_substrings.kept_digest(op10_substrings.remove_repeats(docs, ["doc_id", "text"], window, block)))
    assert any(e[1] for e in expected.values())
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in found.items()} == expected
    assert op10_substrings.remove_repeats(none, ["doc_id", "text"]).count() == 0


def test_repeated_rows_and_null_ids(spark, docs):
    """Rows that repeat, and rows without a doc_id, give a row each and never crash."""
    odd = docs.unionByName(docs.filter("doc_id > 100")).unionByName(docs.filter("doc_id < 0").selectExpr("cast(null as long) as doc_id", *[c for c in docs.columns if c != "doc_id"]))
    n, path = odd.count(), public_tokenizers.path("word_bpe_49k.json")
    assert op1_imatch.fingerprints(odd).count() == n
    assert op2_bpe_count.token_counts(odd, public_tokenizers.path("byte_bpe_50k.json")).count() == n
    assert op4_jaccard.near_duplicates(odd).count() == n
    assert op5_records.read_back(op5_records.write_records(odd, path, new_folder(spark, "t"))).count() == n
    assert op6_langid.identify(odd, ["doc_id"]).count() == n
    assert op7_mixing.mix(odd, ["doc_id"]).count() == n
    assert op8_sharding.shard_records(odd, [1.0] * 4).count() == n
    assert op9_packing.pack_documents(odd, path).filter("piece = 0").count() == n
    assert op10_substrings.remove_repeats(odd, ["doc_id"]).count() == n


def test_sql_of_queries(spark):
    """Queries with SQL give its rows on the smallest tables."""
    from lumbung.llm import registry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    queries = registry.queries()
    for name, sql in registry.oracle_sql().items():
        df = queries[name](spark, d)
        own = sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
        cur = con.execute(sql)
        at = sorted(range(len(cur.description)), key=lambda k: cur.description[k][0])
        assert own == sorted(repr(tuple(r[k] for k in at)) for r in cur.fetchall()), name
