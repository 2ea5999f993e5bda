"""Token ids of whole texts with the ``tokenizers`` library, remembered per word inside a task.

A text is cut at spaces and line ends where the tokenizer itself always cuts, so
the ids of a text are the ids of its pieces one after the other.  Each distinct
word is encoded once per worker.  Texts with a piece at which a cut could matter
(runs of white space, white space at an end, strings of special tokens) are
encoded whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

_REMEMBERED = 1_000_000  # pieces a worker remembers; when full it forgets all, which changes no result
_AT_ONCE = 200_000  # characters handled together
_TOGETHER = 2000  # new words encoded in one call


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``keeps_spaces``: a byte-level vocabulary, where a space belongs to the word
    after it.  Otherwise white space and the case of letters do not count.
    """

    def __init__(self, path: str, keeps_spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces = keeps_spaces
        self.known: dict[str, bytes | None] = {}  # None: a text with this piece is encoded whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A word of letters is one run of tokens; which tokens begin (or end) such a run.
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if keeps_spaces else token.endswith("</w>")
        self.marks = {m: self.plain(m) for m in ".,"}

    def plain(self, text: str | None) -> bytes:
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _words(self, words: list[str]) -> None:
        """Learn words of letters only, many in one call."""
        for begin in range(0, len(words), _TOGETHER):
            some = words[begin : begin + _TOGETHER]
            ids = self._ids(" " + " ".join(some))
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(some):  # a word is not one run after all: one by one
                self.known.update((w, self.plain(" " + w if self.keeps_spaces else w)) for w in some)
                continue
            cuts = [*at.tolist(), len(ids)] if self.keeps_spaces else [0, *(at + 1).tolist()]
            raw = ids.tobytes()
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, cuts, cuts[1:]))

    def _others(self, pieces: list[str]) -> None:
        """Learn pieces of any kind, kept apart by a special token that none of them holds."""
        apart = self.special[0]
        number = self.tokenizer.token_to_id(apart)
        for begin in range(0, len(pieces), _TOGETHER):
            some = pieces[begin : begin + _TOGETHER]
            chunks = [p if p[:1] == "\n" or not self.keeps_spaces else " " + p for p in some]
            ids = self._ids(apart.join(chunks))
            cuts = [-1, *np.flatnonzero(ids == number).tolist(), len(ids)]
            raw = ids.tobytes()
            self.known.update((p, raw[4 * (a + 1) : 4 * b]) for p, a, b in zip(some, cuts, cuts[1:]))

    def _learn(self, pieces) -> None:
        words, derived, others = set(), [], []
        for p in pieces:
            core = p[:-1] if p[-1:] in (".", ",") else p
            if core.isalpha():
                base = core.lower() if not self.keeps_spaces and core.isascii() else core
                if base not in self.known:
                    words.add(base)
                if base != p:
                    derived.append((p, base, p[len(core) :]))
            elif self.keeps_spaces and (not p or p == "\n" or p[-1].isspace()) or any(s in p for s in self.special):
                self.known[p] = None
            else:
                others.append(p)
        self._words(list(words))
        self._others(others)
        for p, base, mark in derived:
            self.known[p] = self.known[base] + self.marks[mark] if mark else self.known[base]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size > _AT_ONCE:  # few enough that the words looked up stay in the processor's cache
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        line = " \n" if self.keeps_spaces else " "
        split = [t.replace("\n", line).split(" ") for t in texts]
        firsts = [pieces.pop(0) if self.keeps_spaces else "" for pieces in split]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        self._learn([p for p in new if p not in self.known])
        known = self.known.__getitem__
        out = []
        for text, first, pieces in zip(texts, firsts, split):
            try:
                ids = b"".join(map(known, pieces))
            except TypeError:  # a piece that needs its surroundings
                out.append(self.plain(text))
                continue
            if self.keeps_spaces:
                # The first piece has no space before it; white space before the first cut counts.
                if not first or first[-1].isspace() or any(s in first for s in self.special):
                    ids = self.plain(text)
                else:
                    ids = self.plain(first) + ids
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def piece_encoder(path: str, keeps_spaces: bool) -> PieceEncoder:
    """One encoder per worker process and vocabulary file."""
    return PieceEncoder(path, keeps_spaces)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
