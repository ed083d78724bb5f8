"""Token ids by a public tokenizer, each distinct word of a block encoded once.

The tokenizer cuts a text before every space that a visible character follows and round every single
line break between visible characters, so the ids of a text are those of its pieces in a row. A block
of texts is cut and dictionary-encoded by Arrow; only pieces not met before reach the tokenizer, and
those of letters go straight to its merge model. A text with other white space, or with the name of a
special token, goes to the tokenizer whole. A full stop or comma before a space is cut off its word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from tidewatch.llm.shared import worker_cache

BYTE_BPE = "byte_bpe_50k.json"
#: Pieces a Python worker learns before those not met since the last time are forgotten.
PIECES = 250_000
#: Bytes of text encoded at once, and words handed to the model at once.
BLOCK_BYTES, BLOCK_WORDS = 4 << 20, 1_000
#: Stands before the first piece of a text, which has no space before it.
_FIRST = "\x01"
#: Marks at the end of a word that are a piece of their own, and what stands before one that is cut off.
_MARKS, _CUT = ".,", "\x02"

#: Spelling of bytes in a byte-level vocabulary: printable ones as they are, the others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELLING = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)
}
_SPACE, _BREAK = SPELLING[0x20], SPELLING[0x0A]
#: The same for a run of words, where a space parts words and a tab is the space before one.
_RUN = SPELLING | {0x20: " ", 0x09: _SPACE}
#: The end of a piece from which a mark may be cut off.
_OPEN = "[A-Za-z0-9À-ÖØ-öø-ɏ]$"
#: A word of Latin letters, behind a line break or not, before a mark or not.
_LETTERS = "^\n?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+[" + _MARKS + "]?$"


def _visible(piece: str) -> bool:
    """Not empty and without white space of any kind."""
    return bool(piece) and piece == piece.strip() and len(piece.split()) == 1


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_FIRST, _CUT, *map(re.escape, special)])
        self.model = Tokenizer(self.tokenizer.model)  # the merges alone, not a copy of them
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.opens = np.array([t[:1] == _SPACE or t == _BREAK for t in self.names()])
        self.marks = {m: self._plain([m])[0][0] for m in _MARKS}
        self.fixed = {_CUT + m: np.uint32(k).tobytes() for m, k in self.marks.items()}
        self.young: dict[str, bytes] = dict(self.fixed)
        self.old: dict[str, bytes] = {}

    def names(self) -> list[str]:
        """The spelling of every id."""
        return [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of words of letters behind a tab, which stands for the space before them, or a line break.

        No token holds a space or a break behind other letters, so a token that opens with one opens a word.
        """
        ids: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)]
        for k in range(0, len(words), BLOCK_WORDS):
            run = " ".join(words[k : k + BLOCK_WORDS]).encode().decode("latin-1").translate(_RUN)
            ids.append(np.array(self.model.encode_batch_fast([run], add_special_tokens=False)[0].ids, dtype=np.uint32))
        flat = np.concatenate(ids)
        return flat, np.append(np.flatnonzero(self.opens[flat]), len(flat))

    def _learned(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of new pieces in their order, none for those of which the cut is not sure."""
        plain = np.asarray(pc.match_substring_regex(new, _LETTERS))
        simple = np.flatnonzero(plain)
        words = new.take(pa.array(simple))
        marked = np.zeros(len(simple), dtype=np.int64) - 1
        for mark, k in self.marks.items():
            marked[np.asarray(pc.ends_with(words, mark))] = k
        words = pc.utf8_rtrim(words, _MARKS)
        behind_tab = pc.binary_join_element_wise(pa.scalar("\t", words.type), words, pa.scalar("", words.type))
        words = pc.if_else(pc.starts_with(words, "\n"), words, behind_tab).dictionary_encode()
        flat, bounds = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = np.asarray(words.indices)
        size = np.diff(bounds)[which]
        lengths = np.zeros(len(new), dtype=np.int64)
        lengths[simple] = size + (marked >= 0)
        rest = []
        for k, p in zip(np.flatnonzero(~plain).tolist(), new.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist(), strict=True):
            if _visible(p[1:] if p[:1] in ("\n", _FIRST) else p):
                rest.append((k, p[1:] if p[0] == _FIRST else p if p[0] == "\n" else " " + p))
        other = self._plain([t for _, t in rest])
        lengths[[k for k, _ in rest]] = [len(x) for x in other]
        ends = np.cumsum(lengths)
        ids = np.zeros(int(ends[-1]) if len(new) else 0, dtype=np.uint32)
        first = (ends - lengths)[simple]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(first, size) + step] = flat[np.repeat(bounds[:-1][which], size) + step]
        ids[(first + size)[marked >= 0]] = marked[marked >= 0]
        for (k, _), x in zip(rest, other, strict=True):
            ids[ends[k] - lengths[k] : ends[k]] = x
        return ids, np.concatenate(([0], ends))

    def _known(self, pieces: pa.Array) -> list[bytes]:
        """The ids of distinct pieces as bytes, empty if the cut of a piece is not sure.

        A piece is kept while it is met: those not met while PIECES others were learned are forgotten.
        """
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, names))
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            ids = self.old.get(names[k])
            if ids is None:
                new.append(k)
            else:
                found[k] = self.young[names[k]] = ids
        if new:
            flat, bounds = self._learned(pieces.take(pa.array(new)))
            data, bounds = flat.tobytes(), (bounds * 4).tolist()
            for k, a, b in zip(new, bounds[:-1], bounds[1:], strict=True):
                found[k] = self.young[names[k]] = data[a:b]
        if len(self.young) > PIECES:
            self.old, self.young = self.young, dict(self.fixed)
        return found

    def _block(self, texts: pa.Array) -> list[np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(texts, self.odd)).copy()
        cut = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST, texts.type), texts, pa.scalar("", texts.type)), "\n", " \n")
        for mark in _MARKS:
            cut = pc.replace_substring(cut, f"{mark} ", f" {_CUT}{mark} ")
        cut = pc.split_pattern(cut, " ")
        bounds = np.asarray(cut.offsets)
        coded = cut.flatten().dictionary_encode()
        piece = np.asarray(coded.indices)
        known = self._known(coded.dictionary)
        lengths = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        flat = np.frombuffer(b"".join(known), dtype=np.uint32)
        length = lengths[piece]
        # Behind anything but a letter or digit a mark would belong to the piece before it.
        marks = np.asarray(pc.starts_with(coded.dictionary, _CUT))
        alone = marks[piece[1:]] & ~np.asarray(pc.match_substring_regex(coded.dictionary, _OPEN))[piece[:-1]]
        unsure = length == 0
        unsure[1:] |= alone
        np.logical_or(odd, np.add.reduceat(unsure, bounds[:-1]) > 0, out=odd)
        ends = np.concatenate(([0], np.cumsum(length)))
        at = np.repeat(starts[piece] - ends[:-1].astype(np.int32), length)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = flat[at]
        out = [ids[ends[a] : ends[b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        whole = np.flatnonzero(odd).tolist()
        for k, x in zip(whole, self._plain([texts[k].as_py() for k in whole]), strict=True):
            out[k] = x
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, equal to those of the tokenizer without special tokens; a null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
            yield from self._block(texts.slice(first, last - first))
            pa.default_memory_pool().release_unused()
            first = last


def encoder(path: str | None = None) -> Encoder:
    """One encoder a Python process and path; by default the public byte-level vocabulary.

    A task has one core, so the library is told to start no threads of its own.
    """
    path = path or public_tokenizers.path(BYTE_BPE)
    known = worker_cache("encoders")
    if path not in known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        known[path] = Encoder(path)
    return known[path]
