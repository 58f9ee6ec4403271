"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenised word by word with a memory of words per worker, cut into pieces of at most the
sequence length, and dealt by a hash into blocks of some thousand pieces. A block is packed best-fit
(longest first). Where that leaves more sequences than the sum of lengths needs, they are improved: pieces
of an underfull sequence move into gaps, or are exchanged one for one or two for one with pieces of other
underfull sequences, each step raising the sum of squared fills, until sequences are empty. Where no step
is left, some sequences are taken apart and the search goes on. What sequences of all blocks remain
underfull is packed again, many blocks together.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import checkpointed, text_bytes, tidy, worker_memory

CAPACITY = 4096
END_ID = 1
BLOCK = 8192
#: Sequences under this fill are packed once more, those of some blocks together.
FULL_ENOUGH = 4060
MERGED_BLOCKS = 64
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, fill long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others counted on from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words.
    Words in use stay in memory: when ``limit`` bytes of new ones have come, those not used since the last
    time are forgotten, so that two times ``limit`` is the most. A word of Latin letters goes to the merges directly; normalising it is lower-casing.
    """

    #: Bytes that an entry takes beside its word and its ids.
    ENTRY = 180

    def __init__(self, path: str, limit: int = 64 << 20):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.older = Tokenizer.from_file(path), limit, {}
        self.held = 0
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) <= "\xff":
                ids = np.array([t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
            elif text[-1] in ".,;:!?" and len(text) > 1 and text[:-1].isalpha() and text.isascii():
                ids = self[word[:-1]] + self[word[-1:]]
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.held += self.ENTRY + len(word) + len(ids)
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        words = text_bytes(text).split()
        out = []
        for begin in range(0, len(words), 65536):  # also within a text of any length
            if self.held > self.limit:
                self.older = dict(self)
                self.clear()
                self.held = 0
            out.append(b"".join(map(self.__getitem__, words[begin : begin + 65536])))
        return b"".join(out)


def word_tokens(path: str) -> WordTokens:
    return worker_memory(("word tokens", path), lambda: WordTokens(path))


def pieces_of(text: str | None, tokens: WordTokens, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) of a text; its end token comes last."""
    ids = tokens.ids(text) + END_ID.to_bytes(4, "little")
    width = 4 * capacity
    return [(k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), width)) for part in [ids[at : at + width]]]


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; the items come longest first, each goes where the least room is left."""
    free_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for item, length in enumerate(lengths.tolist()):
        fits = mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = free_bins[free].pop()
            if not free_bins[free]:
                mask &= ~(1 << free)
            bins[at].append(item)
        else:
            free, at = capacity, len(bins)
            bins.append([item])
        left = free - length
        if left:
            free_bins[left].append(at)
            mask |= 1 << left
    return bins


class Swaps:
    """Bins of items under moves and exchanges; every step raises the sum of squared fills."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.of = np.zeros(len(lengths), np.int64)
        for b, items in enumerate(bins):
            self.of[items] = b
        self.fill = np.bincount(self.of, weights=lengths, minlength=len(bins)).astype(np.int64)
        self.least = -(-int(lengths.sum()) // capacity)
        self._refresh()

    def used(self) -> int:
        return int(np.count_nonzero(self.fill))

    def _refresh(self) -> None:
        """Only items of underfull bins can take part in a step."""
        self.open_items = np.flatnonzero(self.fill[self.of] < self.capacity)

    def best_step(self, a: int) -> tuple[int, list[int], int, int] | None:
        """(gain, items that leave bin ``a``, the item that comes for them or -1, the other bin): the steepest step out of ``a``."""
        others = self.open_items[self.of[self.open_items] != a]
        own = np.flatnonzero(self.of == a)
        if not len(own) or not len(others):
            return None
        own = own[np.unique(self.lengths[own], return_index=True)[1]]  # items of one length are as good as one another
        twice = [int(np.flatnonzero((self.of == a) & (self.lengths == self.lengths[x]))[1]) for x in own if np.count_nonzero((self.of == a) & (self.lengths == self.lengths[x])) > 1]
        bundles = [[int(x)] for x in own] + [[int(x), int(y)] for i, x in enumerate(own) for y in own[i + 1 :]] + [[int(x), y] for y in twice for x in own if self.lengths[x] == self.lengths[y]]
        sums = np.array([self.lengths[x].sum() for x in bundles])
        bins = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        bins = bins[bins != a]
        out, most = None, 0
        # A bin that takes a bundle for nothing in return stands as an item of length 0.
        given = np.concatenate([self.lengths[others], np.zeros(len(bins), np.int64)])
        where = np.concatenate([self.of[others], bins])
        room, full = self.capacity - self.fill[where], self.fill[where] - self.fill[a]
        for begin in range(0, len(bundles), 64):
            gain = sums[begin : begin + 64, None] - given
            value = np.where((gain > 0) & (gain <= room), gain * (full + gain), 0)
            k, y = divmod(int(value.argmax()), len(given))
            if value[k, y] > most:
                most = int(value[k, y])
                out = int(gain[k, y]), bundles[begin + k], int(others[y]) if y < len(others) else -1, int(where[y])
        return out

    def climb(self, sources: list[int] | None = None) -> None:
        """Steps out of the bins of ``sources`` (every underfull one, the emptiest first) and of those that a step changes, while there are any."""
        if sources is None:
            sources = [a for a in np.argsort(self.fill, kind="stable").tolist() if 0 < self.fill[a] < self.capacity]
        waiting = deque(sources)
        queued = set(sources)
        while waiting and self.used() > self.least:
            a = waiting.popleft()
            queued.discard(a)
            if not 0 < self.fill[a] < self.capacity or (step := self.best_step(a)) is None:
                continue
            gain, leave, come, b = step
            self.of[leave] = b
            if come >= 0:
                self.of[come] = a
            self.fill[b] += gain
            self.fill[a] -= gain
            if not self.fill[a] or self.fill[b] == self.capacity:
                self._refresh()
            if a not in queued:
                waiting.appendleft(a)
                queued.add(a)
            if b not in queued:
                waiting.append(b)
                queued.add(b)

    def kick(self, random: np.random.Generator) -> None:
        """Takes some underfull bins apart and puts their items back in chance order, each where it fits best."""
        bins = np.flatnonzero((self.fill > 0) & (self.fill <= self.capacity))
        weights = (self.capacity - self.fill[bins]) + self.capacity * 0.02
        taken = random.choice(bins, min(len(bins), int(random.integers(2, 6))), replace=False, p=weights / weights.sum())
        items = np.flatnonzero(np.isin(self.of, taken))
        self.fill[taken] = 0
        for x in random.permutation(items):
            room = self.capacity - self.fill[taken]
            fits = np.flatnonzero(room >= self.lengths[x])
            if not len(fits):  # one bin more, to be emptied again
                taken = np.append(taken, len(self.fill))
                self.fill = np.append(self.fill, 0)
                fits, room = np.array([len(taken) - 1]), self.capacity - self.fill[taken]
            b = taken[fits[np.argmin(room[fits])]]
            self.of[x] = b
            self.fill[b] += self.lengths[x]
        self._refresh()
        self.climb(sorted((int(b) for b in taken if self.fill[b]), key=lambda b: int(self.fill[b])))


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY, kicks: int = 60, seed: int = 3) -> list[list[int]]:
    """Fewer bins by steps that raise the sum of squared fills, and by kicks out of where no step is left.

    After a kick the bins are as they were, unless it left fewer of them, or as many of no smaller squared
    fill. The search ends at the lower bound, or after ``kicks`` in a row that did not take a bin away.
    """
    state = Swaps(bins, lengths, capacity)
    state.climb()
    random = np.random.default_rng(seed)
    vain = 0
    while state.used() > state.least and vain < kicks:
        of, fill, used = state.of.copy(), state.fill.copy(), state.used()
        state.kick(random)
        vain = 0 if state.used() < used else vain + 1
        if (state.used(), -int((state.fill**2).sum())) > (used, -int((fill**2).sum())):
            state.of, state.fill = of, fill
            state._refresh()
    order = np.argsort(state.of, kind="stable")
    cuts = np.flatnonzero(np.diff(state.of[order])) + 1
    return [part.tolist() for part in np.split(order, cuts) if len(part)]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; ``lengths`` falls, each at most ``capacity``."""
    if not len(lengths):
        return []
    whole = int(np.searchsorted(-lengths, -capacity, side="right"))  # full pieces are bins of their own
    rest = lengths[whole:]
    inner = local_search(best_fit(rest, capacity), rest, capacity) if len(rest) else []
    return [[i] for i in range(whole)] + [[whole + i for i in items] for items in inner]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(tokenizer)
        for frame in frames:
            rows = [(i, *p) for i, text in zip(frame["doc_id"], frame["text"], strict=True) for p in pieces_of(text, tokens, capacity)]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in out["doc_id"]], "Int64")
            yield out

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECE_SCHEMA)


def best_fit_pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: PIECE_SCHEMA, sequence_id, offset.

    A null text counts as empty: its end token alone is a piece. Null ids are kept. Repeated rows and
    repeated ids are documents of their own. Only documents longer than ``capacity`` are cut. An empty
    table gives an empty result. Further columns are ignored. ``tokenizer`` is a path that exists on
    every executor.
    """

    def packer(level: int):
        @tidy
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            lengths = frame["length"].to_numpy(np.int64)
            sequence, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
            for number, items in enumerate(pack(lengths, capacity)):
                ends = np.cumsum(lengths[items])
                sequence[items] = (int(key[0]) << 24 | number) * 2 + level
                offset[items] = ends - lengths[items]
                fill[items] = ends[-1]
            return frame.drop(columns="block").assign(sequence_id=sequence, offset=offset, fill=fill)

        return run

    blocks = max(1, -(-documents.count() // BLOCK))
    cut = pieces(documents, tokenizer or default_tokenizer(), capacity)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    first = checkpointed(dealt.groupBy("block").applyInPandas(packer(0), PACKED_SCHEMA))  # some 60 bytes a piece
    enough = F.col("fill") * CAPACITY >= F.lit(FULL_ENOUGH * capacity)
    merged = F.pmod(F.xxhash64(F.shiftright("sequence_id", 25)), F.lit(-(-blocks // MERGED_BLOCKS)))
    again = first.where(~enough).withColumn("block", merged).drop("sequence_id", "offset", "fill").groupBy("block").applyInPandas(packer(1), PACKED_SCHEMA)
    return first.where(enough).unionByName(again).drop("fill")
