"""Exact, cached byte-level BPE encoding with the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re

import numpy as np
from tokenizers import Tokenizer

_GAP = re.compile(r" (?=\S)")
#: A space, letters, and ASCII punctuation: the letters and the punctuation are encoded apart from each other.
_WORD = re.compile(r" ([^\W\d_]+)([!-/:-@\[-`{-~]*)")
_ENCODERS: dict[tuple[str, int], Encoder] = {}
#: Pieces of text that an encoder remembers, of about 200 bytes each.
REMEMBERED = 1_200_000


def default_tokenizer() -> str:
    """Place of the installed public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE never merges across the border between a visible character and a white space, nor between a white
    space and a visible character with a space of its own before it. So a text is cut before its spaces, every
    distinct piece is encoded once, and the pieces' ids are joined. Pieces are remembered up to ``cache`` entries,
    then forgotten. Texts with runs of white space are cut more carefully; tokenizers built otherwise, and texts that
    hold an added token's string, are encoded whole."""

    def __init__(self, path: str, cache: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cut = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes | bool] = {}
        self.marks: dict[str, bytes] = {}
        self.newline = self._whole("\n")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if self.cut:
            for token, i in self.tokenizer.get_vocab().items():
                self.spaced[i] = token.startswith("Ġ")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Ids of words of letters only, each after a space."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            e = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0]
            ids = np.asarray(e.ids, "<u4")
            ends = np.append(np.flatnonzero(self.spaced[ids])[1:], len(ids))
            assert len(ends) == len(some), "the tokenizer doesn't cut before spaces"
            data, begin = ids.tobytes(), 0
            for w, end in zip(some, (ends * 4).tolist()):
                self.known[" " + w] = data[begin:end]
                begin = end

    def _learn(self, pieces: set[str]) -> None:
        known, words, marked, other = self.known, set(), [], []
        for p in pieces:
            m = _WORD.fullmatch(p)
            if p == " " or p[:1] == " " and p[1].isspace():
                known[p] = False
            elif m and m[1].isalpha():
                if " " + m[1] not in known:
                    words.add(m[1])
                if m[2]:
                    marked.append((p, " " + m[1], m[2]))
            else:
                other.append(p)
        self._learn_words(sorted(words))
        for p in other:
            known[p] = self._whole(p)
        for p, word, mark in marked:
            if mark not in self.marks:
                self.marks[mark] = self._whole(mark)
            known[p] = known[word] + self.marks[mark]

    def _careful(self, text: str) -> bytes:
        pieces = _GAP.split(text)
        pieces = pieces[:1] + [" " + p for p in pieces[1:]]
        fresh = {p for p in pieces if p not in self.known}
        if fresh:
            self._learn(fresh)
        return b"".join([self.known[p] or self._whole(p) for p in pieces])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; a null text is empty."""
        known = self.known
        if len(known) > self.cache:
            known.clear()
            self.marks.clear()
        get = known.get
        done: list[bytes | None] = []
        waiting: list[tuple[int, list[list[str]], list[list]]] = []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            done.append(b"" if not text else None)
            if text and self.cut and "\0" not in text and not any(a in text for a in self.added):
                lines = text.split("\n")
                if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                    cut = [line.replace(" ", "\0 ").split("\0") for line in lines]
                    got = [list(map(get, pieces)) for pieces in cut]
                    try:
                        done[i] = self.newline.join([b"".join(x) for x in got])
                    except TypeError:
                        waiting.append((i, cut, got))
                        for pieces, ids in zip(cut, got):
                            missing.update([p for p, x in zip(pieces, ids) if x is None])
        self._learn(missing)
        for i, cut, got in waiting:
            try:
                done[i] = self.newline.join([b"".join([known[p] if x is None else x for p, x in zip(pieces, ids)]) for pieces, ids in zip(cut, got)])
            except TypeError:  # a run of white space
                pass
        for i, text in enumerate(texts):
            if done[i] is None:
                done[i] = self._careful(text) if self.cut and not any(a in text for a in self.added) else self._whole(text)
        return done


def encoder(path: str | None = None, remembered: int = REMEMBERED) -> Encoder:
    """One encoder a process, vocabulary and number of pieces that it remembers."""
    key = path or default_tokenizer(), remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
