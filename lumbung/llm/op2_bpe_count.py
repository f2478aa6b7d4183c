"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, lean, when_left

#: Fixed pattern of the vocabulary's byte-level pre-tokenizer.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
DOUBLE_SPACE = regex.compile(r"\p{White_Space}{2}")
#: White space with the run after it. No pre-token crosses from one such piece to the next.
PIECE = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
#: Entries of each memo, and the longest piece kept there: at most about 300 MB a worker.
MEMO_ENTRIES, MEMO_LENGTH = 600_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    A byte whose Latin-1 character is printable stands for itself; the rest are numbered from 256.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    table = {b: chr(b) for b in own}
    return [table[b] if b in table else chr(next(rest)) for b in range(256)]


def merge_count(ids: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Symbols left when the adjacent pair of lowest rank (leftmost first) is merged until none is left.

    The symbols form a doubly linked list; a heap holds rank and left position in one integer. An
    entry is stale if its pair has changed since. Time is O(n log n), so a long unbroken run is no
    special case. No token id leaves this function: the count is the symbols less the merges.
    """
    n = len(ids)
    if n < 2:
        return n
    find = ranks.get
    heap = [r << 32 | i for i in range(n - 1) if (r := find(ids[i] << 20 | ids[i + 1])) is not None]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        top = heappop(heap)
        rank, i = top >> 32, top & 0xFFFFFFFF
        if (j := after[i]) >= n or ids[i] < 0 or find(ids[i] << 20 | ids[j]) != rank:
            continue
        ids[i] = own = made[rank]
        ids[j] = -1
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := find(own << 20 | ids[k])) is not None:
                heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := find(ids[h] << 20 | own)) is not None:
            heappush(heap, r << 32 | h)
    return n - merges


class _Memo(dict):
    """Counts by string, computed when first asked for; a full memo keeps what was asked for of late."""

    def __init__(self, compute):
        self.compute, self.old = compute, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.compute(piece)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = n
        return n


class BpeCounter:
    """Counts tokens of whole texts as the tokenizer file's own library does, without making ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        number = {s: i for i, s in enumerate(symbols)}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(merges):
            self.made.append(number.setdefault(a + b, len(number)))
            self.ranks.setdefault(number[a] << 20 | number[b], rank)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tokens = _Memo(lambda t: merge_count(list(t.encode("utf-8", "replace")), self.ranks, self.made))
        self.first = _Memo(lambda p: sum(map(self.tokens.__getitem__, PRETOKEN.findall(p))))
        self.spaced = _Memo(lambda p: sum(map(self.tokens.__getitem__, PRETOKEN.findall(" " + p))))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if DOUBLE_SPACE.search(text):
            return sum(map(self.first.__getitem__, PIECE.findall(text)))
        head, *rest = text.split(" ")
        return (self.first[head] if head else 0) + sum(map(self.spaced.__getitem__, rest))

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; a special string inside it is one token, as the library has it."""
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> BpeCounter:
    """One counter for each worker process."""
    return BpeCounter(path)


when_left(counter.cache_clear)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every document.

    A map over the rows: nothing is shuffled. Null and empty texts have no bytes and no tokens;
    long texts are counted whole; repeated rows give a row each; other columns are ignored; a null
    doc_id stays null; an empty table gives no rows. ``tokenizer`` is the path of a byte-level BPE ``.json`` file on every executor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            sizes, counts = [], []
            for cell in batch.column(1):
                text = cell.as_py()
                sizes.append(len(text.encode("utf-8", "replace")) if text else 0)
                counts.append(own.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean("op2", run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
