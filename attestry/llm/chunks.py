"""Fast whole-text encoding: a text is cut where the tokenizer's own pattern must cut too, and each distinct chunk is encoded once.

The pattern never joins characters across a single space or line feed that stands between two non-space characters, but for the
space that opens a chunk. So a text whose white space is only such separators (line feeds may also come in pairs) is the
concatenation of its chunks' encodings. Any other text is encoded whole. The cache is bounded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

#: White space, in Unicode's sense, other than the space and the line feed.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def plain(text: str) -> bool:
    """All white space is single separators (or pairs of line feeds) between other characters."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[:1] == " " or text.endswith((" ", "\n\n")) or (any(c in text for c in ASCII_SPACE) if text.isascii() else OTHER_SPACE.search(text)))


def split(text: str) -> list[str]:
    """Chunks of a plain text. Each but the first begins with its space or its line feed."""
    first, *rest = text.replace("\n", " \n").split(" ")
    return ([first] if first else []) + [x if x[:1] == "\n" else " " + x for x in rest]


#: Below this, Python, the regex module and the tokenizers library agree on what a letter is.
LATIN = "\u0250"

#: What ends a word and is a match of its own.
MARKS = (",", ".", "!", "?", ";", ":")

#: Ids of chunks, kept as long as the Python worker lives: tasks that follow in the same worker find them.
_chunks: dict[tuple[str, int], "Chunks"] = {}


def words(chunk: str, find) -> list[str]:
    """The pattern's matches in a chunk of Latin text; what is plainly one word, or one and a mark, needs no pattern."""
    body = chunk[1:]
    if body.isalpha():
        return ["\n", body] if chunk[0] == "\n" else [chunk] if chunk[0] == " " or chunk[0].isalpha() else find(chunk)
    if chunk[0] == " " and body[-1:] in MARKS and body[:-1].isalpha():
        return [chunk[:-1], body[-1]]
    return find(chunk)


class Chunks(dict):
    """Chunks, without the space that opens them, and their ids, worked out when they are first asked for. When there are most, they give way to new ones, but those that are asked for meanwhile are taken over and not worked out again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}
        self.work: Callable[[str], bytes] = str.encode

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            found = self.work(chunk if chunk[:1] == "\n" else " " + chunk)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[chunk] = found
        return found


class Encoder:
    """Texts -> little-endian unsigned 32-bit ids as bytes, by the tokenizers library.

    A new chunk of Latin text is cut into the pattern's matches here, and the library's model encodes each new match; any other chunk goes
    through the library's whole encoding.
    """

    def __init__(self, path: str, pattern: str, most: int = 300_000):
        os_environ_off()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.find = regex.compile(pattern).findall
        self.alphabet = byte_alphabet()
        self.cache = _chunks.setdefault((path, most), Chunks(most))
        self.cache.work = self._chunk
        self.marks: dict[str, bytes] = {}  # single characters

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _tokens(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) >= LATIN:
            return self._whole(chunk)
        found = words(chunk, self.find)
        if len(found) == 1:
            return self._tokens(chunk)
        # a word behind a space is a chunk of its own elsewhere
        return b"".join([self.cache[w[1:]] if w[0] == " " and w[1:].isalpha() else self._mark(w) for w in found])

    def _mark(self, word: str) -> bytes:
        if len(word) > 1:
            return self._tokens(word)
        found = self.marks.get(word)
        if found is None:
            found = self.marks[word] = self._tokens(word)
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        cache = self.cache
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if not plain(text):
                out.append(self._whole(text))
                continue
            first, *rest = text.replace("\n", " \n").split(" ")  # as split() does
            out.append((self._chunk(first) if first else b"") + b"".join(map(cache.__getitem__, rest)))
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


def os_environ_off() -> None:
    """One thread a task: the cores belong to Spark's tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
