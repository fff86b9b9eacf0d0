"""Token counts (6): a linear longest-match automaton.

The greedy word-piece count of a word is had in one pass over its bytes. Trie nodes get failure links: from node v, whose
string has the greedy first piece p, the link leads to the node of what is left after p (and after further pieces, while the
rest is no node), and popped[v] says how many pieces that takes. No piece is ever built; see `brute_force` for what is counted.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hunkwise.llm import common


class Automaton:
    """initial: pieces that may begin a word; later: pieces that may follow. Nodes are numbers; 0 begins a word, 1 follows.

    A word without any greedy cover counts as one unknown piece, as word-piece tokenizers have it.
    """

    def __init__(self, initial: set[bytes], later: set[bytes]):
        self.next: dict[int, int] = {}  # (node << 8 | byte) -> node
        self.is_piece = [False, False]
        depth, parent, byte = [0, 0], [-1, -1], [0, 0]
        for root, pieces in ((0, initial), (1, later)):
            for piece in pieces:
                at = root
                for b in piece:
                    if (to := self.next.get(at << 8 | b)) is None:
                        to = self.next[at << 8 | b] = len(depth)
                        depth.append(depth[at] + 1)
                        parent.append(at)
                        byte.append(b)
                        self.is_piece.append(False)
                    at = to
                if at != root:
                    self.is_piece[at] = True
        self.fail, self.popped = [-1] * len(depth), [0] * len(depth)
        for v in sorted(range(2, len(depth)), key=depth.__getitem__):
            if self.is_piece[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            z, n = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and (to := self.next.get(z << 8 | byte[v])) is None:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = to, n

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        get, fail, popped, at, n = self.next.get, self.fail, self.popped, 0, 0
        for b in word:
            while (to := get(at << 8 | b)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Initial and later pieces of a ranks file: what follows a space there may begin a word, all others may do both."""
    tokens = [base64.b64decode(line.split()[0]) for line in open(path, "rb")]
    later = {t for t in tokens if t[:1] != b" "}
    return later | {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1}, later


class Counts(dict):
    """Pieces of words met so far; emptied when it is full."""

    def __init__(self, automaton: Automaton, most: int = 250_000):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


_OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with n_words and n_tokens: ASCII-white-space words of the whole text, and their greedy pieces in all.

    path names a vocabulary of base64 tokens and ranks. A null or empty text has 0 of both. Columns of these names are
    replaced, others pass; repeated rows are counted apart; an empty table gives an empty result.
    """

    def run(counts, texts):
        words, tokens = [], []
        for t in texts:
            w = (t or "").encode().split()
            words.append(len(w))
            tokens.append(sum(map(counts.__getitem__, w)))
        return [words, tokens]

    return common.map_columns(docs, _OUT, [text], run, model=(f"counts {path}", lambda: Counts(Automaton(*vocabulary(path)))))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = re.sub(r"\.json$", ".tiktoken", public_tokenizers.path("byte_bpe_50k.json"))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, path).select("doc_id", "n_words", "n_tokens")


def brute_force(word: bytes, initial: set[bytes], later: set[bytes]) -> int:
    """Greedy longest match by trying every length, for tests."""
    n, at = 0, 0
    while at < len(word):
        pieces = later if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n
