"""Whole texts to token ids, with a bounded memo of the ids of their pieces between white space."""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import quiet_threads, when_left

#: Units that a worker remembers (about 150 bytes each), and the longest kept when it forgets.
MEMO_ENTRIES, MEMO_LENGTH = 1_000_000, 48
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 2_000_000


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``pool[start : start + length]``, one after the other."""
    before = np.cumsum(length) - length
    kind = np.int32 if len(pool) < 1 << 31 and length.sum() < 1 << 31 else np.int64
    at = np.repeat((start - before).astype(kind), length)
    at += np.arange(len(at), dtype=kind)
    return pool[at]


def listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Ids of a tokenizer whose tokens never hold or depend on white space.

    That holds where the pre-tokenizer drops white space: then the ids of a text are those of its
    pieces between spaces, one after the other. Arrow splits a group of texts, numbers its distinct
    pieces and parts those that are a word of common letters, or one with marks after it, into the
    lower-cased word and the marks; other pieces of common characters are split by ``token`` into what
    the pre-tokenizer keeps whole. The library encodes all unknown tokens of a group in one call; they
    are told apart by their word ends. Pieces of other characters are encoded whole, one by one.
    """

    #: Characters that composition leaves alone and that are lower-cased one by one, and their letters.
    common = regex.compile(r"[\x00-\x7f\xa1-\u012f\u0131-\u024f\u2010-\u2027]*")
    letters = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
    marks = ".,;:!?"
    #: What the pre-tokenizer keeps whole in a lower-cased piece. Fixed by the tokenizer file.
    token = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        self.entries = entries
        quiet_threads()
        gc.set_threshold(200_000, 20, 50)  # the memo holds many strings and no cycles
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.type = "<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: The same model for tokens that are already normalized and told apart by spaces.
        self.lean = Tokenizer(self.library.model)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Unit (token, or piece that is kept whole) to entry; an entry's ids are ``pool[start : start + length]``.
        self.memo: dict[str, int] = {"": 0}
        self.start, self.length, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, self.type)

    def _add(self, units: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        first = len(self.start)
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.pool = np.concatenate((self.pool, ids.astype(self.type)))
        self.memo.update(zip(units, range(first, first + len(units)), strict=True))

    def _encode_tokens(self, tokens: list[str]) -> None:
        """Remember the ids of new normalized tokens, which hold no white space."""
        ids = np.array(self.lean.encode_batch_fast([" ".join(tokens)], add_special_tokens=False)[0].ids, self.type)
        cuts = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        if len(cuts) != len(tokens) + 1 or cuts[-1] != len(ids):
            each = [self.lean.encode(t, add_special_tokens=False).ids for t in tokens]
            ids, cuts = np.array([i for x in each for i in x], self.type), np.cumsum([0, *map(len, each)])
        self._add(tokens, ids, np.diff(cuts))

    def _tokens(self, piece: str) -> list[str] | None:
        """The normalized tokens of a piece; None if only the library can tell."""
        if (piece.isascii() or self.common.fullmatch(piece)) and not ("<|" in piece and any(s in piece for s in self.special)):
            return self.token.findall(piece.lower())
        return None

    def _entries(self, tokens: list[str], pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers of normalized tokens and of whole pieces; what is unknown is encoded."""
        memo = self.memo
        new = {t for t in tokens if t not in memo}
        parts = {p: self._tokens(p) for p in pieces if p not in memo}
        new.update(t for x in parts.values() if x for t in x if t not in memo)
        if new:
            self._encode_tokens(sorted(new))
        if parts:
            at = np.fromiter((memo[t] for x in parts.values() for t in x or ()), np.int64)
            ids, before = gathered(self.pool, self.start[at], self.length[at]), np.concatenate(([0], np.cumsum(self.length[at])))
            ends = np.cumsum([len(x or ()) for x in parts.values()])
            length = np.diff(before[ends], prepend=0)
            if whole := [i for i, x in enumerate(parts.values()) if x is None]:
                keys = list(parts)
                found = [np.array(self.library.encode(keys[i], add_special_tokens=False).ids, self.type) for i in whole]
                sizes = np.array([len(x) for x in found], np.int64)
                ids = np.insert(ids, np.repeat(before[ends[whole]], sizes), np.concatenate(found))
                length[whole] = sizes
            self._add(list(parts), ids, length)
        return tuple(np.fromiter(map(memo.__getitem__, x), np.int64, len(x)) for x in (tokens, pieces))

    def _shrink(self, tokens: list[str], pieces: list[str]) -> None:
        """Forget all but what the last group held, if the memo is full."""
        if len(self.memo) > self.entries or len(self.pool) > 16 * self.entries:
            keep = [x for x in dict.fromkeys(["", *tokens, *pieces]) if len(x) <= MEMO_LENGTH][: self.entries // 2]
            at = np.fromiter(map(self.memo.__getitem__, keep), np.int64, len(keep))
            self.pool, self.length = gathered(self.pool, self.start[at], self.length[at]), self.length[at]
            self.start = np.cumsum(self.length) - self.length
            self.memo = dict(zip(keep, range(len(keep)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text (null: empty) with ``end_id`` after it, for groups of consecutive texts.

        Yields (ids, offsets): those of a group's n-th text are ``ids[offsets[n] : offsets[n + 1]]``.
        A group holds one text at least, and about GROUP_BYTES of them at most.
        """
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, side="right")))
            yield self._group(texts.slice(at, to - at), end_id)
            at = to

    def _group(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        simple = pc.match_substring_regex(distinct, f"^[{self.letters}]+[{self.marks}]*$")
        words = distinct.filter(simple)
        tails = pc.replace_substring_regex(words, f"^[{self.letters}]+", "").dictionary_encode()
        words = pc.utf8_lower(pc.utf8_rtrim(words, self.marks)).dictionary_encode()
        tokens, others = [*listed(words.dictionary), *listed(tails.dictionary)], listed(distinct.filter(pc.invert(simple)))
        token, other = self._entries(tokens, others)
        # Each distinct piece is a word and its marks, or one unit and nothing.
        simple = simple.to_numpy(zero_copy_only=False)
        units = np.zeros((len(distinct), 2), np.int64)
        units[simple, 0] = token[: len(words.dictionary)][words.indices.to_numpy()]
        units[simple, 1] = token[len(words.dictionary) :][tails.indices.to_numpy()]
        units[~simple, 0] = other
        length = self.length[units]
        pool = gathered(self.pool, self.start[units].ravel(), length.ravel())
        length = length.sum(axis=1)
        start = np.cumsum(length) - length
        self._shrink(tokens, others)
        lengths = length[index]
        ids = gathered(pool, start[index], lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths)))[bounds - bounds[0]]
        return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


@functools.lru_cache(maxsize=1)
def encoder(path: str, entries: int = MEMO_ENTRIES) -> PieceEncoder:
    """One encoder for each worker process. It outlives its task, so ``entries`` bounds what a worker
    holds; tasks of other operators drop it."""
    return PieceEncoder(path, entries)


when_left(encoder.cache_clear)
