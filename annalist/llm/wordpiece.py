"""Token counts by a linear longest-match automaton.

Words are cut greedily from the left into the longest pieces of a vocabulary: initial pieces at the start of a word,
continuation pieces after it; a word that can't be cut is one unknown token. With a bare start a word that no initial piece
begins starts with the bare word-start piece, a token of its own, and goes on with continuation pieces. The automaton is a trie over both kinds with
failure links: when no child fits, it pops the pieces that greedy matching would emit and goes on in the node that
stands for what is left. Only the number of popped pieces is kept at each node, so a word of n characters takes O(n)
steps and no piece is ever built.

Defined results: null and empty texts have 0 words and 0 tokens; an empty table gives an empty table; only the named
columns are read; ids are read as long, a null id is passed through; repeated rows give rows of their own; there is no limit on a word's length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import mapped, session_defaults

#: A word is a run of word characters or one other visible character.
WORDS = r"\w+|[^\w\s]"
CACHE_ENTRIES = 200_000
CACHE_CHARS = 40
WORD_START = "▁"


class Automaton:
    """Greedy longest-match counts. `initial` and `following` are the two kinds of pieces; bare_start: the empty initial piece is one too."""

    def __init__(self, initial: set[str], following: set[str], bare_start: bool = False) -> None:
        self.children: list[dict[str, int]] = [{}, {}]
        self.initial_root, self.following_root = 0, 1
        ends: list[bool] = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for piece in sorted(pieces):
                if not piece:
                    continue
                node = root
                for c in piece:
                    nxt = self.children[node].get(c)
                    if nxt is None:
                        nxt = len(self.children)
                        self.children[node][c] = nxt
                        self.children.append({})
                        ends.append(False)
                    node = nxt
                ends[node] = True
        self._link(ends, bare_start)

    def _link(self, ends: list[bool], bare_start: bool) -> None:
        """Failure link and popped count of each node, breadth first; -1: greedy matching fails from here on."""
        n = len(self.children)
        self.fail, self.popped = [-1] * n, [0] * n
        if bare_start:
            self.fail[0], self.popped[0] = 1, 1
        queue = [(0, c, v) for c, v in self.children[0].items()] + [(1, c, v) for c, v in self.children[1].items()]
        for parent, c, node in queue:
            if ends[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.children[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.children[at][c], count
            queue += [(node, c2, v) for c2, v in self.children[node].items()]

    def count(self, word: str) -> tuple[int, bool]:
        """Tokens of a word, and whether it is known."""
        children, fail, popped = self.children, self.fail, self.popped
        node, total = 0, 0
        for c in word:
            nxt = children[node].get(c)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1, False
                nxt = children[node].get(c)
            node = nxt
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1, False
        return total, True


def all_pieces(model_path: str) -> tuple[set[str], set[str]]:
    """Initial pieces, the bare one as an empty string, and continuation pieces; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    initial, following = set(), set()
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k)
        (initial if piece.startswith(WORD_START) else following).add(piece.removeprefix(WORD_START))
    return initial, following


def pieces_of(model_path: str) -> tuple[set[str], set[str]]:
    """Initial and continuation pieces of a sentencepiece file without the bare start."""
    initial, following = all_pieces(model_path)
    return initial - {""}, following


class Counter:
    def __init__(self, model_path: str, bare_start: bool) -> None:
        initial, following = all_pieces(model_path)
        self.automaton = Automaton(initial, following, bare_start and "" in initial)
        self.find = re.compile(WORDS).findall
        self.cache: dict[str, tuple[int, bool]] = {}

    def word(self, w: str) -> tuple[int, bool]:
        got = self.automaton.count(w)
        if len(w) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[w] = got
        return got

    def text(self, text: str) -> tuple[int, int, int]:
        """Words, tokens, unknown words."""
        get, own, tokens, unknown = self.cache.get, self.word, 0, 0
        words = self.find(text)
        for w in words:
            n, known = get(w) or own(w)
            tokens += n
            unknown += not known
        return len(words), tokens, unknown


@lru_cache(2)
def counter(model_path: str, bare_start: bool) -> Counter:
    return Counter(model_path, bare_start)


def token_counts(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", bare_start: bool = False) -> DataFrame:
    """Columns id, n_words, n_tokens, n_unknown. bare_start: the file's bare word-start piece is used too."""
    session_defaults(documents.sparkSession)

    def make(batch: pa.RecordBatch):
        c = counter(model_path, bare_start)
        rows = [c.text(t or "") for t in batch.column(1).to_pylist()]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_words", "n_tokens", "n_unknown"])

    return mapped(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "id long, n_words long, n_tokens long, n_unknown long")
