"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Each node has a failure link and the number of tokens
that greedy longest matching pops when it follows the link; so the number of
tokens of a word comes from one walk over its bytes, and no token is built.  The
automaton is built once on the driver from the vocabulary file, which bounds its
size, and is walked for all distinct words of a run of texts at a time.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import hashed_words

#: A public byte-level vocabulary: one base64 token and its rank a line; words after a space start with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens of a vocabulary file on the driver."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: give its path or its tokens")
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie over bytes with failure links (``fail``) and popped-token counts (``pops``; ``ends``: all pops up to the root).

    The vocabulary must hold every single byte; those it lacks are added.
    """

    def __init__(self, vocabulary: list[bytes]):
        words = set(vocabulary) | {bytes([b]) for b in range(256)}
        words.discard(b"")
        children: list[dict[int, int]] = [{}]
        is_word = [False]
        for word in sorted(words):
            u = 0
            for c in word:
                if c not in children[u]:
                    children[u][c] = len(children)
                    children.append({})
                    is_word.append(False)
                u = children[u][c]
            is_word[u] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in children[u].items():
                    below.append(v)
                    if is_word[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while c not in children[z]:
                        n += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = children[z][c], n
            level = below
        edges = sorted((u << 8 | c, v) for u, own in enumerate(children) for c, v in own.items())
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.to = np.array([v for _, v in edges], dtype=np.int32)
        self.fail, self.pops = np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int32)
        ends = np.zeros(len(children), dtype=np.int64)
        level = [u for u in range(1, len(children))]
        todo = np.array(level)
        at, self_ends = todo.copy(), np.zeros(len(children), dtype=np.int64)
        while len(todo):  # every pop shortens what is left
            ends[todo] += self.pops[at]
            at = self.fail[at]
            go = at > 0
            todo, at = todo[go], at[go]
        self.ends = ends + self_ends

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int = 32) -> np.ndarray:
        """Tokens of first + data[start:end] for each pair; first is the byte before a word."""
        root = self._step(np.zeros(1, np.int64), np.array([first]))[0]
        state, total = np.full(len(start), root, dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        order = np.argsort(start - end, kind="stable")  # longest first: those still being read are a prefix
        length = (end - start)[order]
        for k in range(int(length[0]) if len(length) else 0):
            live = order[: np.searchsorted(-length, -k, side="left")]
            c = data[start[live] + k].astype(np.int64)
            while True:
                next_ = self._step(state[live], c)
                state[live] = np.where(next_ >= 0, next_, state[live])
                stuck = next_ < 0
                if not stuck.any():
                    break
                live, c = live[stuck], c[stuck]
                total[live] += self.pops[state[live]]
                state[live] = self.fail[state[live]]
        return total + self.ends[state]

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state << 8 | c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


def token_counts(docs: DataFrame, vocabulary: list[bytes] | None = None, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each whole text under greedy longest matching.

    docs: any frame with an id and a text; other columns are ignored.  Words are
    split at ASCII white space and each is matched with one space before it.
    Returns doc_id, n_words, n_tokens, n_bytes.  Null and empty texts have none of
    each; rows that share an id keep their own rows; an empty table gives an empty
    table.  Without a ``vocabulary`` the driver reads that of ``path``, a local file; a
    missing one is an error before any job starts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary if vocabulary is not None else read_vocabulary(path)))  # as large as the vocabulary

    @F.pandas_udf("n_words long, n_tokens long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        words, tokens, automaton = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), shared.value
        for i, j, data, _, w in hashed_words(pa.array(texts, pa.string(), from_pandas=True)):
            words[i:j] = w.count
            _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
            own = automaton.count(data, w.start[first], w.end[first])
            tokens[i:j] = np.bincount(w.text, weights=own[which], minlength=j - i)[: j - i] if len(which) else 0
        return pd.DataFrame({"n_words": words, "n_tokens": tokens})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.select("doc_id", counted("text").alias("n"), "n_bytes").select("doc_id", "n.n_words", "n.n_tokens", "n_bytes")
