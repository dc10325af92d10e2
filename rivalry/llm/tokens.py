"""Token ids of whole texts with the ``word_bpe_49k`` tokenizer.

The vocabulary file stays where it is (``public_tokenizers.path``, or a path
given by the caller).  :class:`Encoder` gives the ids the tokenizers library
gives for ``encode(text, add_special_tokens=False)``.  White space always
separates tokens of this tokenizer, so texts of plain Latin characters are
encoded word by word from a memory of words seen before; a new word goes
through the tokenizer's own pattern and its own BPE model.  Any other text
(control characters, combining marks, other scripts, special-token strings)
goes to the library whole.  The memory is bounded and only saves time.
"""

from __future__ import annotations

import os
import re

import regex

#: Fixed value: the split pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NAME = "word_bpe_49k.json"

#: Characters whose white space, lower case and composition are the same for
#: Python and the library: ASCII, Latin letters, common punctuation.
OTHER = re.compile("[^\t\n\v\f\r -~¡-įı-ɏ‐-‧‰-⁞€]")
SPECIAL = "<|"           # begins every special token

WORDS_KEPT = 300_000     # entries of the two memories of a Python worker
RUNS_KEPT = 600_000


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(NAME)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on, in byte order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class _Memory(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes.  When it is
    full, the words not asked for since it was last full are forgotten."""

    def __init__(self, encode, limit):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word):
        if 2 * len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.split = regex.compile(PATTERN).findall
        self.runs = _Memory(self._run, RUNS_KEPT)
        self.words = _Memory(self._word, WORDS_KEPT)

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(run)])

    def _word(self, word: str) -> bytes:
        word = word.lower()
        # letters, or letters and one other character: what the pattern finds too
        if word.isalpha():
            return self.runs[word]
        if word[:-1].isalpha():
            return self.runs[word[:-1]] + self.runs[word[-1]]
        return b"".join(map(self.runs.__getitem__, self.split(word)))

    def __call__(self, text: str | None) -> bytes:
        """Ids of a text (NULL: of the empty text) as little-endian unsigned
        32-bit bytes."""
        if not text:
            return b""
        if SPECIAL in text or OTHER.search(text):
            return b"".join([self.bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    import sys
    held = sys.modules.setdefault("_rivalry_llm_encoders", type(sys)("_rivalry_llm_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
