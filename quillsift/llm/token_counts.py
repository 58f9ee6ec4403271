"""Token counts of a unigram segmentation, by dynamic programming shared in a trie.

A pre-token is a word with its leading mark. The distinct pre-tokens of a batch are inserted in a trie in
sorted order. A node stands for a prefix and stores its forward score, the best sum of piece scores that
segments it, with the number of pieces; so a prefix is computed once, however many pre-tokens share it,
and the node where a pre-token ends has its count. Every task has a trie of its own, of bounded size.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import text_bytes, tidy, worker_memory

MARK = "▁"
#: A byte of a character that no piece covers.
BYTE_SCORE = -25.0
#: Longer pre-tokens are computed alone, so that one of them does not fill the trie.
LONGEST = 64
MOST_NODES = 250_000
#: Bytes of words whose counts are remembered, of each of two generations.
MOST_BYTES = 48 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of a vocabulary's pieces by their rank (Zipf-Mandelbrot), control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1.0 / (r + 2.7) for r in range(len(ranked))))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(ranked)}


class ForwardTrie:
    """Nodes are [score, pieces, children], the last None where there are none.

    The trie and the counts of whole words are bounded each by itself: a full trie is begun anew, and of the
    counts those asked for since the last time stay.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        # Lengths of the pieces that end in two given characters; of one character; only these are looked up.
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}
        self.counts: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.held = 0
        self.plant()

    def plant(self) -> None:
        self.root: list = [0.0, 0, None]
        self.nodes = 1

    def _extend(self, word: str, begin: int, path: list, keep: bool) -> list:
        """Nodes of the prefixes of ``word`` from length ``begin`` + 1 on; ``path``: those up to ``begin``."""
        scores, lengths_at, find = self.scores, self.ends.get, self.scores.get
        node = path[begin]
        for end in range(begin + 1, len(word) + 1):
            char = word[end - 1]
            score, count, _ = node
            alone = find(char)
            if alone is not None:
                score, count = score + alone, count + 1
            else:
                size = len(char.encode("utf-8", "surrogatepass"))
                score, count = score + BYTE_SCORE * size, count + size
            if end > 1:
                for length in lengths_at(word[end - 2 : end], ()):
                    if length > end:
                        break
                    piece = find(word[end - length : end])
                    if piece is not None:
                        before = path[end - length]
                        piece += before[0]
                        if piece > score or (piece == score and before[1] + 1 < count):
                            score, count = piece, before[1] + 1
            fresh = [score, count, None]
            if keep:
                if node[2] is None:
                    node[2] = {char: fresh}
                else:
                    node[2][char] = fresh
                self.nodes += 1
            path.append(fresh)
            node = fresh
        return node

    def count(self, word: str) -> int:
        if len(word) > LONGEST:
            return self._extend(word, 0, [self.root], False)[1]
        node, path = self.root, [self.root]
        for at, char in enumerate(word):
            child = node[2] and node[2].get(char)
            if child is None:
                return self._extend(word, at, path, True)[1]
            path.append(child)
            node = child
        return node[1]

    def text_count(self, words: list[bytes]) -> int:
        if self.nodes > MOST_NODES:
            self.plant()
        if self.held > MOST_BYTES:
            self.older, self.counts, self.held = self.counts, {}, 0
        known, older = self.counts, self.older
        for w in sorted({w for w in words if w not in known}):
            n = older.get(w)
            self.held += 140 + len(w)
            known[w] = self.count(MARK + w.decode("utf-8", "replace")) if n is None else n
        return sum(map(known.__getitem__, words))


def token_counts(documents: DataFrame, pieces: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of ``documents``.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and no tokens. Of segmentations
    with equal scores, the one of fewer pieces counts. Repeated rows get equal results. An empty table
    gives an empty result. Further columns are ignored. ``pieces`` is a path that exists on every executor.
    """
    path = pieces or default_pieces()

    @tidy
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = worker_memory(("forward trie", path), lambda: ForwardTrie(piece_scores(path)))
        for frame in frames:
            # A trie has no cycles, and looking for some would go through all its nodes again and again.
            gc.disable()
            try:
                split = [text_bytes(t).split() for t in frame["text"]]
                counts = [trie.text_count(w) for w in split]
            finally:
                gc.enable()
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "n_words": [len(w) for w in split], "n_tokens": counts})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_words long, n_tokens long")
