"""Cutting texts where byte-level BPE cannot merge across, so that equal pieces are encoded once per task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
# A space after white space may belong to a longer run; texts that have one are cut by the pattern alone.
_ASCII_RUNS = tuple(c + " " for c in " \n\t\r\v\f\x1c\x1d\x1e\x1f")
_OTHER_RUN = re.compile(r"[^\x00-\x7f\S] ")
# What is remembered is bounded in bytes: so many pieces, none of them longer than this; longer ones are encoded anew.
CACHE_PIECES = 100_000
RECENT_WORDS = 250_000
LONGEST_KEPT = 64
GROUP_CHARS = 4_000_000


def has_runs(text: str) -> bool:
    return any(run in text for run in _ASCII_RUNS) or (not text.isascii() and _OTHER_RUN.search(text) is not None)


def pieces(text: str) -> list[str]:
    """Parts of ``text``, in order, at borders that are always borders of the pattern's matches.

    A match that starts at a single space between other characters takes that space, and no match goes on across it,
    so the text may be cut before each such space.
    """
    if has_runs(text):
        return PATTERN.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def matches(piece: str) -> list[str]:
    """The pattern's matches; a word, or a word and one mark, needs no search."""
    if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece]
    if piece[-1] in ".," and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece[:-1], piece[-1]]
    return PATTERN.findall(piece)


class PieceCache:
    """Piece -> encoded value. ``encode`` gets distinct matches of the pattern and returns one list of ids for each.

    Memory is bounded by two generations of ``CACHE_PIECES`` entries: when one is full it becomes the older one, and
    what is used again moves on to the new one, so frequent pieces stay.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], join: Callable[[list[int]], object]):
        self.encode, self.join = encode, join
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.long: list[str] = []

    def learn(self, cut: Iterable[list[str]]) -> None:
        """Make all pieces of ``cut`` known; long ones are known until the next call only."""
        for piece in self.long:
            del self.known[piece]
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = []
        for piece in {p for parts in cut for p in parts}.difference(known):
            if piece in older:
                known[piece] = older[piece]
            else:
                missing.append(piece)
        self.long = [p for p in missing if len(p) > LONGEST_KEPT]
        if not missing:
            return
        found = [matches(p) if p else [] for p in missing]
        distinct = list({m for own in found for m in own})
        ids = dict(zip(distinct, self.encode(distinct)))
        for piece, own in zip(missing, found):
            known[piece] = self.join(ids[own[0]] if len(own) == 1 else [i for m in own for i in ids[m]])


class TextEncoder:
    """Texts' ids as bytes.

    A text without runs of white space is cut before each space. Of a group of texts each distinct word after a space is
    looked up once; words not known yet go together to ``bulk``, which gets them without their spaces and returns each
    one's ids as bytes. The ids of all words are then laid out by array operations. ``encode`` takes one match of the
    pattern; it serves what is not plainly a word after a space.

    Memory is bounded by two generations of ``RECENT_WORDS`` words of at most ``LONGEST_KEPT`` characters.
    """

    def __init__(self, encode: Callable[[str], bytes], bulk: Callable[[list[str]], list[bytes]]):
        self.one, self.bulk = encode, bulk
        self.marks = {m: encode(m) for m in ".,"}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, part: str) -> bytes:
        return b"".join(map(self.one, PATTERN.findall(part)))

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each after a space."""
        known, older = self.known, self.older
        found = list(map(known.get, words))
        fresh, marked, bare = [], [], {}
        for at, ids in enumerate(found):
            if ids is None:
                word = words[at]
                ids = found[at] = older.get(word)
                if ids is not None:
                    known[word] = ids
                elif not word or word[-1].isspace():
                    # joined to other words, its white space would run into the next space
                    found[at] = self._plain(" " + word)
                elif word[-1] in self.marks and word[-2:-1].isalpha():
                    # a mark after a letter is a match of its own
                    marked.append(at)
                    if word[:-1] not in known:
                        ids = older.get(word[:-1])
                        bare[word[:-1]] = ids
                else:
                    fresh.append(at)
                    bare[word] = None
        unseen = [w for w, ids in bare.items() if ids is None]
        bare.update(zip(unseen, self.bulk(unseen)))
        for at in fresh:
            found[at] = bare[words[at]]
        for at in marked:
            word = words[at]
            found[at] = (bare.get(word[:-1]) or known[word[:-1]]) + self.marks[word[-1]]
        known.update((w, ids) for w, ids in bare.items() if len(w) <= LONGEST_KEPT)
        if len(known) > RECENT_WORDS:
            self.known, self.older = {}, known
        return found

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        firsts = np.zeros(int(ends[-1]), bool)
        firsts[ends[:-1]] = True
        heads = cut.values.filter(pa.array(firsts)).to_pylist()
        words = cut.values.filter(pa.array(~firsts)).dictionary_encode()
        laid = pa.array(self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        _, places, data = laid.buffers()
        until = np.frombuffer(places, np.int64)[ends - np.arange(len(ends))].tolist()
        held = memoryview(data)
        return [(self._plain(head) if head else b"") + held[a:b] for head, a, b in zip(heads, until, until[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = [has_runs(t) for t in texts]
        plain = [t for t, r in zip(texts, runs) if not r]
        found: list[bytes] = []
        at = 0
        while at < len(plain):
            end, chars = at, 0
            while end < len(plain) and (end == at or chars + len(plain[end]) <= GROUP_CHARS):
                chars += len(plain[end])
                end += 1
            found += self._group(plain[at:end])
            at = end
        rest = iter(found)
        return [self._plain(t) if r else next(rest) for t, r in zip(texts, runs)]
