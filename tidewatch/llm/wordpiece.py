"""Greedy longest-match token counts by an automaton over bytes, linear in the text.

The vocabulary is a trie. Where a node has no edge for the next byte, the pieces that greedy matching
is sure of by then are popped and the walk goes on at the node's failure link, which spells what is
left over. Only the number of popped pieces is kept, so no piece is ever built. Every distinct word
of a block is walked once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.tokens import BYTE_BPE, SPELLING

#: Distinct words a Python worker remembers, and bytes of text counted at once.
WORDS, BLOCK_BYTES = 500_000, 6 << 20


class Automaton:
    """Counts the greedy pieces of a word; a space before the word belongs to its first piece.

    A vocabulary is a set of byte strings; those that open a word open with a space. A word that
    pieces cannot spell is one unknown token.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = to
            ends[node] = node != 0
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in self.next[parent].items():
                    below.append(node)
                    if ends[node]:
                        self.fail[node], self.pops[node] = 0, 1
                        continue
                    at, popped = self.fail[parent], self.pops[parent]
                    while at >= 0 and byte not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.next[at][byte], popped
            level = below

    def count(self, word: bytes) -> int:
        """The number of pieces of the word, or -1 if it is unknown."""
        node, total = 0, 0
        for byte in b" " + word:
            to = self.next[node].get(byte)
            while to is None:
                total += self.pops[node]
                node = self.fail[node]
                if node < 0:
                    return -1
                to = self.next[node].get(byte)
            node = to
        while node:
            total += self.pops[node]
            node = self.fail[node]
            if node < 0:
                return -1
        return total


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, without its special tokens."""
    back = {c: b for b, c in SPELLING.items()}
    words = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    return [bytes(back[c] for c in w) for w in sorted(words) if all(c in back for c in w)]


_AUTOMATA: dict[str, tuple[Automaton, dict[str, int]]] = {}


def _automaton(path: str | None) -> tuple[Automaton, dict[str, int]]:
    path = path or public_tokenizers.path(BYTE_BPE)
    if path not in _AUTOMATA:
        _AUTOMATA[path] = (Automaton(vocabulary(path)), {})
    return _AUTOMATA[path]


def block_counts(texts: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, tokens, unknown words) of each text; a null is an empty text."""
    automaton, known = _automaton(path)
    cut = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"[\t-\r]", " "), " ")
    bounds = np.asarray(cut.offsets).astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    if len(known) > WORDS:
        known.clear()
    per_word = np.zeros(len(coded.dictionary), dtype=np.int64)
    for k, word in enumerate(coded.dictionary.to_numpy(zero_copy_only=False).tolist()):
        found = known.get(word)
        if found is None:
            found = known[word] = automaton.count(word.encode()) if word else 0
        per_word[k] = found
    each = per_word[np.asarray(coded.indices)]
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[bounds])
    return total(each != 0), total(np.abs(each)), total(each < 0)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row of docs.

    Words are runs of anything but space and 0x09-0x0D in the whole text. A null or empty text has
    none; an unknown word is one token. Other columns are not read; ids may be null or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
            first = 0
            while first < len(texts):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
                counts = block_counts(texts.slice(first, last - first), tokenizer)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), *[pa.array(c, pa.int64()) for c in counts]],
                    names=["doc_id", "n_words", "n_tokens", "n_unknown"],
                )
                first = last

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
