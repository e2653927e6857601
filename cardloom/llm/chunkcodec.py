"""Token ids of whole texts from a public tokenizer file, with a bounded cache of words.

Neither pre-tokenizer lets a token reach across a single space or line feed that stands between two characters that are not
white space, so a text's ids are those of its words, one after another. Words repeat, and the model sees each word once per
task. Texts with any other white space, and words that are more than Latin letters, go through the whole tokenizer.
With `added`, texts that hold the string of one of the file's added tokens go whole through the file's own tokenizer, which
gives one id for it; else such strings are ordinary text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

from .base import turn_to

#: Words that a Python worker remembers of each kind, and the longest that it remembers.
CACHE_WORDS, CACHE_CHARS = 900_000, 40
#: White space that the short way doesn't take: all but space and line feed, the part beyond ASCII second.
ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def plain(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0].isspace() or text[-1].isspace():
        return False
    return not any(c in text for c in ASCII_SPACE) and (text.isascii() or not any(c in text for c in WIDE_SPACE))


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


#: Runs of one kind of character, which no token crosses; PLAIN excludes what they don't hold for: white space, apostrophes
#: (short forms) and characters beyond Latin letters or with a numeric value of their own.
RUN, PLAIN = re.compile(r"[^\W\d_]+|\d+|[\W_]+"), re.compile(r"[^'\s\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]+")


class Words(dict):
    """Word to its ids as bytes; `lead` goes before each word, `inner` has runs that stand inside words."""

    def __init__(self, tok, lead: str, inner: Words | None = None, digits: bool = False):
        super().__init__()
        self.tok, self.model, self.lead, self.letters = tok, tok.model, lead, byte_letters()
        self.mark = "".join(self.letters[b] for b in lead.encode())
        self.inner, self.digits = self if inner is None else inner, digits

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = array("I", [t.id for t in self.model.tokenize(self.mark + word)]).tobytes()
        elif not PLAIN.fullmatch(word):
            ids = self.whole(self.lead + word)
        elif len(runs := RUN.findall(word)) == 1:
            letters = self.letters
            shown = [letters[b] for b in (self.lead + word).encode()]
            shown = shown if self.digits and word.isdigit() else ["".join(shown)]
            ids = array("I", [t.id for s in shown for t in self.model.tokenize(s)]).tobytes()
        else:
            ids = self[runs[0]] + b"".join([self.inner[r] for r in runs[1:]])
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


class ChunkCodec:
    def __init__(self, path: str, spaced: bool, added: bool = False):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        self.tok, self.spaced = tok, spaced
        self.first = Words(tok, "", digits=not spaced)  # word files take every digit alone
        self.rest = Words(tok, " ", self.first)
        self.own = Tokenizer.from_file(path)
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()] if added else []
        self.feed = self.first.whole("\n")

    def one(self, text: str) -> bytes:
        if not self.spaced:  # white space is dropped, and case with it; two capitals have lower forms that depend on more than themselves
            if "Σ" in text or "İ" in text:
                words = text.replace("\n", " ").split(" ")
                return b"".join([self.first.whole(w) if "Σ" in w or "İ" in w else self.first[w.lower()] for w in words if w])
            return b"".join(map(self.first.__getitem__, filter(None, text.lower().replace("\n", " ").split(" "))))
        if not plain(text):
            return b"".join([self.first.whole(p) for p in self.cut(text)])
        out, first, rest = [], self.first, self.rest
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.feed)
            out.append(first[words[0]])
            out += map(rest.__getitem__, words[1:])
        return b"".join(out[1:])

    @staticmethod
    def cut(text: str) -> Iterator[str]:
        """Pieces of a text with any white space, cut at single spaces between other characters, of some length."""
        at = 0
        for m in re.finditer(r"(?<=\S) (?=\S)", text):
            if m.start() - at > 2000:
                yield text[at : m.start()]
                at = m.start()
        yield text[at:]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        for t in texts:
            if t and any(a in t for a in self.added):
                yield array("I", self.own.encode(t, add_special_tokens=False).ids).tobytes()
            else:
                yield self.one(t) if t else b""


@lru_cache(maxsize=4)
def _codec(path: str, spaced: bool, added: bool) -> ChunkCodec:
    return ChunkCodec(path, spaced, added)


def codec(path: str, spaced: bool, added: bool = False) -> ChunkCodec:
    """One codec for each file in a Python worker, so that tasks which run there one after another share its words."""
    turn_to("tokens", _codec.cache_clear)
    return _codec(path, spaced, added)
