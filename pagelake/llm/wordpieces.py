"""Ids of whole texts under a word-level BPE, from the tokenizers library.

White space separates pre-tokens in such a vocabulary, so a text's ids are the
ids of its words in turn. Each distinct word goes through the library once per
worker; a bounded table keeps its ids. This holds for vocabularies with the
normalizer, pre-tokenizer and added tokens named below; with any other the library
gets each text as it is.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata

import numpy as np

#: Settings of the vocabulary file under which words may be told apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(spec: dict) -> bool:
    """Whether a vocabulary file's ids of a text are those of its words."""
    marks = all(x["content"].startswith("<|") and x["content"].split() == [x["content"]] and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec["added_tokens"])
    return marks and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and not (spec["truncation"] or spec["padding"])


@functools.cache
def plain_letters() -> frozenset[str]:
    """Letters that stay one letter under NFC and lowering, whatever stands beside them.

    All were letters in Unicode 3.2 already, so the library's tables have them, too.
    Conjoining jamo, which compose with each other, are left out.
    """
    old = unicodedata.ucd_3_2_0
    letter = lambda c: len(c) == 1 and c.isalpha() and old.category(c).startswith("L")
    found = (chr(i) for i in range(0x10000) if not 0x1100 <= i < 0x1200)
    return frozenset(c for c in found if letter(c) and letter(c.lower()) and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", c.lower()) == c.lower())


#: Entries that a worker's table of words may hold (about 200 bytes each).
#: A full table is emptied; ids do not depend on it. Words above LONG bytes don't stay.
TABLE_WORDS = 1_200_000
LONG = 1024

#: Bytes after which a full stop or comma is not part of a longer run of marks.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def fold(texts: list[bytes]) -> list[bytes]:
    """Texts with the same ids and fewer distinct words.

    ASCII letters are lowered, and a full stop or comma between a letter or digit
    (ASCII, or a small letter of Latin-1) and white space, which is a pre-token by
    itself, gets a space before it. Texts with special strings, or with marks that
    compose with ASCII letters (U+0300 to U+036F), stay as they are.
    """
    odd = [b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts]
    raw = np.frombuffer(b"\n\n".join([b"", *[b"" if o else t.lower() for o, t in zip(odd, texts)], b""]), np.uint8)
    at = np.flatnonzero((raw == 44) | (raw == 46))
    before, after = raw[at - 1], raw[at + 1]
    latin = (raw[at - 2] == 0xC3) & (before >= 0xA0) & (before <= 0xBF) & (before != 0xB7)
    at = at[(_PLAIN[before] | latin) & ((after == 32) | ((after >= 9) & (after <= 13)))]
    made = np.insert(raw, at, 32).tobytes()
    ends = np.cumsum([0, *[2 if o else len(t) + 2 for o, t in zip(odd, texts)]])
    ends += np.searchsorted(at, ends)
    return [t if o else made[s:e] for o, t, s, e in zip(odd, texts, ends[:-1].tolist(), ends[1:].tolist())]


#: ASCII marks that, after letters, are pre-tokens of their own; the apostrophe and ``<``
#: take part in contractions and special strings and are left alone.
_TAIL = b'!#$%&()*+,-./:;=?@[]^_`{}~"|'


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


class WordPieces:
    """Ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        self.table: dict[bytes, bytes] = {}

    def learn(self, words: list[list[bytes]]) -> None:
        """Make sure that the table has all of ``words``."""
        flat, plain = itertools.chain.from_iterable, lambda w: bool(w) and plain_letters().issuperset(_text(w))
        new = list(set(itertools.filterfalse(self.table.__contains__, flat(words))))
        if len(self.table) + len(new) > TABLE_WORDS:
            self.table.clear()
            new = list(set(flat(words)))
        letters = [w for w in new if plain(w)]
        other = set(new) - set(letters)
        cores = {w: core for w in other if (core := w.rstrip(_TAIL)) != w and plain(core)}
        fresh = set(new)
        more = {*cores.values(), *(w[len(core) :] for w, core in cores.items())}
        more = [x for x in more if x not in self.table and x not in fresh]
        letters += [x for x in more if plain(x)]
        single = [*(other - cores.keys()), *(x for x in more if not plain(x))]
        self._encode_letters(letters)
        self._encode_each(single)
        self.table.update({w: self.table[core] + self.table[w[len(core) :]] for w, core in cores.items()})

    def _encode_letters(self, words: list[bytes]) -> None:
        """Words of plain letters are one pre-token each, so word ids tell them apart in a long text."""
        groups = [words[i : i + 512] for i in range(0, len(words), 512)]
        made = self.tokenizer.encode_batch([" ".join(map(_text, g)) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, made):
            cuts = (np.flatnonzero(np.diff(np.array(found.word_ids))) + 1) * 4
            if len(cuts) + 1 == len(group):
                raw = np.array(found.ids, "<u4").tobytes()
                ends = [*cuts.tolist(), len(raw)]
                self.table.update(zip(group, [raw[s:e] for s, e in zip([0, *ends], ends)]))
            else:
                self._encode_each(group)

    def _encode_each(self, words: list[bytes]) -> None:
        for w, one in zip(words, self.tokenizer.encode_batch_fast([_text(w) for w in words], add_special_tokens=False)):
            self.table[w] = np.array(one.ids, "<u4").tobytes()

    def documents(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole text."""
        if not self.by_words:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(list(map(_text, texts)), add_special_tokens=False)]
        words = [t.split() for t in fold(texts)]
        self.learn(words)
        get = self.table.__getitem__
        found = [b"".join(map(get, w)) for w in words]
        for w in {w for ws, t in zip(words, texts) if len(t) > LONG for w in ws if len(w) > LONG}:
            del self.table[w]
        return found


@functools.cache
def word_pieces(path: str) -> WordPieces:
    """The worker's own table, kept from task to task."""
    return WordPieces(path)
