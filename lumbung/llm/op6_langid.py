"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import string
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lean

#: Bytes of the longest context, contexts kept over all languages, and times a context must be seen.
ORDER, MOST_CONTEXTS, LEAST_SEEN = 3, 12_000, 4
#: The training sample: documents a language, bytes of a document. Every language is learned; beyond
#: SHARED_FROM of them they share the bytes and contexts that so many would have.
SAMPLE_DOCS, SAMPLE_BYTES, SHARED_FROM = 120, 32_768, 64
#: Texts are scored in blocks of so many bytes, so a long text needs no more memory.
BLOCK = 1 << 20
#: Symbols over which the score weighs the languages' code lengths.
SCORE_SYMBOLS = 50.0
LETTER = regex.compile(r"\p{L}")
#: Share of a language's sampled letters from which a script is learned.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"


@dataclass
class Model:
    """Frozen statistics of all languages as one table of code lengths.

    ``symbol`` maps bytes to symbols; bytes never seen share the last one. ``node`` maps the last
    ORDER symbols to the longest context that any language has seen; ``cost[l, node * n + symbol]`` is
    the code length in bits of a symbol after that context in language l. ``letters`` are the letters
    that were learned (see :func:`learned_letters`).
    """

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    cost: np.ndarray
    n: int
    letters: frozenset[str]

    def learned(self, text: str) -> str | None:
        """The words of ``text`` in learned letters; None if they are all its words."""
        foreign = {c for c in set(text) - self.letters if LETTER.match(c)}
        return " ".join(w for w in text.split() if foreign.isdisjoint(w)) if foreign else None

    def bits(self, data: bytes) -> np.ndarray:
        """Code length of ``data`` in each language. The text starts after ORDER line ends."""
        total = np.zeros(len(self.languages))
        held = b"\n" * ORDER
        for at in range(0, len(data), BLOCK):
            block = held + data[at : at + BLOCK]
            s = self.symbol[np.frombuffer(block, np.uint8)]
            context = np.zeros(len(s) - ORDER, np.int32)
            for i in range(ORDER):
                context *= self.n
                context += s[i : len(s) - ORDER + i]
            index = self.node[context] * np.int32(self.n) + s[ORDER:]
            for language in range(len(self.languages)):
                total[language] += self.cost[language].take(index).sum(dtype=np.float64)
            held = block[-ORDER:]
        return total


def train(samples: dict[str, list[bytes]]) -> Model | None:
    """PPM with escape method C, its counts frozen after the sample.

    In the longest context seen, a symbol seen there has odds count / (total + distinct); else the
    escape, distinct / (total + distinct), is paid and the next shorter context asked. Below the empty
    context every byte value has odds 1/256. A context not seen in a language costs nothing to leave.
    """
    languages = sorted(samples)
    if not languages:
        return None
    seen = sorted({b for texts in samples.values() for t in texts for b in set(t)} | {10})
    n = len(seen) + 1
    symbol = np.full(256, n - 1, np.int32)
    symbol[seen] = np.arange(n - 1)
    counts = {lang: [defaultdict(lambda: defaultdict(int)) for _ in range(ORDER + 1)] for lang in languages}
    weight: dict[tuple[int, int], int] = defaultdict(int)
    for lang in languages:
        for text in samples[lang]:
            s = symbol[np.frombuffer(b"\n" * ORDER + text, np.uint8)].astype(np.int64)
            for k in range(ORDER + 1):
                key = np.zeros(len(s) - ORDER, np.int64)
                for i in range(ORDER - k, ORDER + 1):
                    key = key * n + s[i : len(s) - ORDER + i]
                for gram, c in zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True):
                    counts[lang][k][gram // n][gram % n] += c
        for k in range(1, ORDER + 1):
            for context, after in counts[lang][k].items():
                weight[k, context] += sum(after.values())
    # The contexts kept: the most seen, with every suffix of one kept, since suffixes are seen as often.
    kept = [x for x, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])) if w >= LEAST_SEEN][: MOST_CONTEXTS * SHARED_FROM // max(SHARED_FROM, len(languages))]
    number = {(0, 0): 0}
    for k, context in sorted(kept):
        if (k - 1, context % n ** (k - 1)) in number:
            number[k, context] = len(number)
    cost = np.empty((len(languages), len(number), n), np.float32)
    for l, lang in enumerate(languages):
        for (k, context), at in number.items():
            if k:
                row = cost[l, number[k - 1, context % n ** (k - 1)]].copy()
            else:
                row = np.full(n, 8.0, np.float32)
            if after := counts[lang][k].get(context):
                whole = sum(after.values()) + len(after)
                row += np.float32(-np.log2(len(after) / whole))
                for s, c in after.items():
                    row[s] = -np.log2(c / whole)
            cost[l, at] = row
    node = np.zeros(n**ORDER, np.int32)
    for (k, context), at in number.items():  # shorter contexts come first, longer ones write over them
        node.reshape(n ** (ORDER - k), n**k)[:, context] = at
    return Model(languages, symbol, node, cost.reshape(len(languages), -1), n, learned_letters(samples))


def script(letter: str) -> str:
    """The script of a letter, as its name begins with it."""
    return unicodedata.name(letter, "").split(" ")[0]


def learned_letters(samples: dict[str, list[bytes]]) -> frozenset[str]:
    """The letters seen, of scripts with at least SCRIPT_SHARE of some language's; with Latin, all of ASCII."""
    seen, scripts = set(), set()
    for texts in samples.values():
        counts: Counter[str] = Counter()
        for t in texts:
            counts.update(t.decode("utf-8", "replace"))
        held: Counter[str] = Counter()
        for c in [c for c in counts if LETTER.match(c)]:
            seen.add(c)
            held[script(c)] += counts[c]
        scripts |= {k for k, v in held.items() if v >= SCRIPT_SHARE * held.total()}
    if "LATIN" in scripts:
        seen |= set(string.ascii_letters)
    return frozenset(c for c in seen if script(c) in scripts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> dict[str, list[bytes]]:
    """The training texts: for each language the SAMPLE_DOCS documents of least hashed doc_id that are
    not held out, first those of at most SAMPLE_BYTES bytes, then the first SAMPLE_BYTES bytes of longer
    ones. At most 250 MB whatever the input, about 4 MB a language: beyond SHARED_FROM languages each
    has fewer documents, and beyond SHARED_FROM * SAMPLE_DOCS languages one shorter block."""
    able = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    languages = max(SHARED_FROM, able.select("lang").distinct().count())
    most = max(1, SAMPLE_DOCS * SHARED_FROM // languages)
    size = min(SAMPLE_BYTES, SAMPLE_BYTES * SAMPLE_DOCS * SHARED_FROM // languages)
    long = F.octet_length("text") > size
    block = F.when(long, F.substring(F.col("text").cast("binary"), 1, size).cast("string")).otherwise(F.col("text"))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "text")
    first = able.select("lang", "doc_id", long.alias("long"), block.alias("text")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    out: dict[str, list[bytes]] = {}
    for lang, text, long in first.select("lang", "text", "long").collect():
        # A block may end within a character.
        out.setdefault(lang, []).append((text.rstrip("\ufffd") if long else text).encode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document and lang_pred, score, bits (a byte, in the language named),
    learned_bytes and learned_bits.

    A map over the rows. The language of least code length for the whole text wins, the first by name
    on a tie. The score is that language's share when each language weighs 2 to the power of minus its
    bits a byte times SCORE_SYMBOLS. Null, empty and letterless texts are ``und`` with score 0, as is
    everything if nothing was learned. Repeated rows give a row each. learned_bytes and learned_bits
    are the size and the bits a byte, in the best language, of the text's words in letters that were
    learned: elsewhere code lengths say nothing. learned_bytes is null where a text has no letter. A
    column of ``keep`` named like one of ours gives way to ours; an empty table gives no rows; long
    texts are scored whole, block by block.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("lang_pred", "score", "bits", "learned_bytes", "learned_bits")]
    shared = spark.sparkContext.broadcast(model)
    first = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, score, rate, size, known = [], [], [], [], []
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py()
                if own is None or not text or not LETTER.search(text):
                    names.append(UNKNOWN), score.append(0.0), rate.append(None), known.append(None)
                    size.append(0 if text and LETTER.search(text) else None)
                    continue
                data = text.encode("utf-8", "replace")
                bits = own.bits(data) / len(data)
                best = int(bits.argmin())
                names.append(own.languages[best])
                score.append(float(1.0 / np.exp2((bits[best] - bits) * min(len(data), SCORE_SYMBOLS)).sum()))
                rate.append(float(bits[best]))
                if (part := own.learned(text)) is not None:
                    data = part.encode("utf-8", "replace")
                    bits = own.bits(data) / max(1, len(data))
                size.append(len(data)), known.append(float(bits.min()))
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), pa.array(size, pa.int64()), pa.array(known, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "bits", "learned_bytes", "learned_bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields[:-1]) + ", lang_pred string, score double, bits double, learned_bytes bigint, learned_bits double"
    return first.mapInArrow(lean("op6", run), schema)


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Learn from the labelled documents that are not held out and predict for all.

    doc_id decides only what is learned from; lang, source and doc_id never enter a prediction. The
    model has at most MOST_CONTEXTS contexts, a few MB a language, and is broadcast.
    """
    return predict(docs, train(sample(docs)), keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")
