"""Token ids of whole texts by a `tokenizers` file, with one lookup per word.

The vocabulary file drops white space before anything else, so the ids of a text are the ids of
its words in order, and most words of a corpus come again. The ids of recent words, and of the
runs of letters, digits and signs that the file's own pattern cuts words into, are kept in two
generations of bounded dictionaries; only runs that neither holds reach the model.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Bounds of the caches of one Python worker: entries of one generation (two are held). An entry takes
# about 150 bytes, so that both caches stay near 200 MB. Smaller ones cost far more than they save.
WORDS_KEPT = 300_000
RUNS_KEPT = 400_000
# Longest word, in bytes, that is kept.
LONGEST_KEPT = 48

# Words, and texts of such words, whose split into runs is the same in Python and in the tokenizer's
# own pattern: printable ASCII and precomposed Latin letters. Others go through it word by word.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile("[ \\t\\n\\x0b\\f\\r!-~À-ÖØ-öø-ÿ]*")
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \\t\\n\\x0b\\f\\ra-z0-9ß-öø-ÿ]+")
_SPECIAL = "<|"


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """`encode(text)` gives the ids as little-endian unsigned 32-bit numbers, in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.older_words = {}, {}
        self.runs, self.older_runs = {}, {}

    def encode(self, text: str) -> bytes:
        return b"".join(self._parts(text))

    def _parts(self, text: str) -> list[bytes]:
        if _PLAIN_TEXT.fullmatch(text) and _SPECIAL not in text:
            runs = _RUNS.findall(text.lower())
            parts = list(map(self.runs.get, runs))
            if None in parts:
                run = self._run
                parts = [run(r) if p is None else p for r, p in zip(runs, parts)]
            return parts
        # bytes.split() takes blanks, tabs and line ends for white space, as the file does.
        words = text.encode().split()
        parts = list(map(self.words.get, words))
        if None in parts:
            word = self._word
            parts = [word(w) if p is None else p for w, p in zip(words, parts)]
        return parts

    def _word(self, word: bytes) -> bytes:
        found = self.older_words.get(word)
        if found is None:
            text = word.decode()
            if not _PLAIN.fullmatch(text) or _SPECIAL in text:
                found = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            elif (lower := text.lower()).isalpha():
                found = self._run(lower)
            else:
                found = b"".join([self._run(r) for r in _RUNS.findall(lower)])
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= WORDS_KEPT:
                self.words, self.older_words = {}, self.words
            self.words[word] = found
        return found

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            found = self.older_runs.get(run)
            if found is None:
                mapped = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES)
                found = _packed([t.id for t in self.model.tokenize(mapped)])
            if len(run) <= LONGEST_KEPT:
                if len(self.runs) >= RUNS_KEPT:
                    self.runs, self.older_runs = {}, self.runs
                self.runs[run] = found
        return found


def _byte_names() -> dict[int, int]:
    """How byte-level vocabularies write the bytes that are no printable Latin-1 characters."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255) or b == 173]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTES = _byte_names()


def _packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
