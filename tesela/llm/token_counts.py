"""Operator 3, word-piece counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes have failure links. Following a link pops the pieces that
greedy longest match would have taken; each node stores how many these are, so that a word's length
in pieces is found in one pass over its characters and no piece is built.
"""

from __future__ import annotations

from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose length is remembered in a task, at most.
REMEMBER = 200_000


def vocabulary(path: str = DEFAULT_MODEL) -> list[str]:
    """The pieces of a public model, each with its word-start mark if it has one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return [model.id_to_piece(i) for i in plain]


class Matcher:
    """``count(word)``: pieces of greedy longest match over the mark and the word.

    A word that no sequence of longest matches covers is one unknown token, as in word-piece models.
    """

    def __init__(self, pieces: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.is_piece = [False]
        for piece in pieces:
            at = 0
            for ch in piece:
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.is_piece.append(False)
                at = self.child[at][ch]
            self.is_piece[at] = at != 0
        n = len(self.child)
        self.fail = [-1] * n  # -1: nothing to pop, the word is unknown
        self.pops = [0] * n
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for ch, to in self.child[node].items():
                if self.is_piece[to]:
                    self.fail[to], self.pops[to] = 0, 1
                else:
                    back, popped = self.fail[node], self.pops[node]
                    while back >= 0 and ch not in self.child[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[to], self.pops[to] = self.child[back][ch], popped
                queue.append(to)

    def count(self, word: str) -> tuple[int, int]:
        """(tokens, unknown tokens)."""
        child, fail, pops, at, total = self.child, self.fail, self.pops, 0, 0
        for ch in MARK + word:
            while ch not in child[at]:
                total += pops[at]
                at = fail[at]
                if at < 0 or (at == 0 and ch not in child[0]):
                    return 1, 1
            at = child[at][ch]
        while at:
            total += pops[at]
            at = fail[at]
            if at < 0:
                return 1, 1
        return total, 0


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, pieces: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_tokens, n_unknown (long).

    Words are runs of characters other than separators. A null or empty text has no tokens; repeated
    rows are counted as often as they occur; an empty table gives no rows. The vocabulary is read on
    the driver, and its size does not depend on the data.
    """
    pieces = vocabulary(model) if pieces is None else pieces

    def run(batches):
        matcher, seen = Matcher(pieces), {}
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                counts, total, unknown = Counter((t or b"").split()), 0, 0
                for word, k in counts.items():
                    got = seen.get(word)
                    if got is None:
                        got = matcher.count(word.decode("utf-8", "replace"))
                        if len(seen) < REMEMBER and len(word) < 64:
                            seen[word] = got
                    total += k * got[0]
                    unknown += k * got[1]
                n_words.append(counts.total())
                n_tokens.append(total)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
