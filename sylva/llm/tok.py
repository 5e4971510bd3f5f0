"""Token ids of whole texts, word by word, equal to encoding the text at once.

``word_bpe_49k.json`` drops white space and never lets a token span it, so a
text can be cut at white space and each distinct word encoded once.  Words are
looked up as UTF-8 bytes with A-Z lowered (the file's normaliser lowers them
anyway).  A word of Latin letters, and marks after it, goes to the BPE model
itself: its normalised form and its boundaries follow from the file's rules.
Other words go through the whole tokenizer, and so do texts that hold ``<|``,
which could be a special token.  The memo is emptied when it holds MEMO_WORDS
words, which bounds memory and changes no id.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

MEMO_WORDS = 1_500_000
#: Marks that may stand between words while they are learned: the first that is one token serves.
_MARKS = "\u2603\u00a7\u00b6\u2020\u2022\u00a9"
#: Letters that are one lower-cased code point each in NFC, then ASCII marks; an apostrophe can open a suffix token.
_PLAIN = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_WORKER: dict[str, "WordEncoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None) -> "WordEncoder":
    """The worker's encoder for a file, made once per Python worker."""
    path = path or tokenizer_path()
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark = next(m for m in _MARKS if len(self.tok.encode(m, add_special_tokens=False).ids) == 1)
        self.mark_id = self.tok.encode(self.mark, add_special_tokens=False).ids[0]
        self.bpe = self.tok.model.tokenize
        self.memo: dict[bytes, bytes] = {}
        # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + k for k, b in enumerate(others)}


    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a lower-case word of letters of _PLAIN."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.bpe(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of unseen words, which also go to the memo."""
        memo, todo = self.memo, []
        if len(memo) + len(words) > MEMO_WORDS:
            memo.clear()
        for w in words:
            m = _PLAIN(w.decode())
            if m is None:
                todo.append(w)
                continue
            stem, marks = m.groups()
            stem = stem.lower()
            key = stem.encode()
            ids = memo.get(key)
            if ids is None:
                ids = memo[key] = self._letters(stem)
            if marks:
                end = marks.encode()
                if end not in memo:
                    memo[end] = self._whole(marks)
                ids += memo[end]
            memo[w] = ids
        for a in range(0, len(todo), 4096):
            part = todo[a : a + 4096]
            joined = f" {self.mark} ".join(w.decode() for w in part)
            ids = np.asarray(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) != len(part) - 1:  # a word that holds the mark itself: encode one by one
                for w in part:
                    memo[w] = self._whole(w.decode())
                continue
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(part, [*at.tolist(), len(ids)]):
                memo[w] = raw[4 * lo : 4 * hi]
                lo = hi + 1
        return {w: memo[w] for w in words}

    def ids_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null is empty."""
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """ids_bytes of several texts; their unseen words are learned together."""
        get, parts, missing = self.memo.get, [], set()
        for t in texts:
            if not t:
                parts.append(([], []))
            elif "<|" in t:
                parts.append((None, [self._whole(t)]))
            else:
                words = t.encode("utf-8", "replace").lower().split()
                found = list(map(get, words))
                if None in found:
                    missing.update([w for w, x in zip(words, found) if x is None])
                    parts.append((words, found))
                else:
                    parts.append((None, found))
        new = self._learn(missing) if missing else {}
        return [b"".join([new[w] if x is None else x for w, x in zip(words, found)] if words else found) for words, found in parts]
