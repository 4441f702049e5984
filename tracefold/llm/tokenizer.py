"""Exact, cached encoding with public tokenizer files.

The ``tokenizers`` library decides every id. A text is cut into pre-tokens by the file's own pattern, each
distinct pre-token is encoded once per worker by the library, and the ids of a text are the concatenation.
Texts for which that is not proven equal to encoding the whole text (an added special string, or a character
on which Python's character classes and the library's disagree) are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Pre-token patterns of the two supported ``.json`` files, in Python's syntax (fixed values).
_BYTE_LEVEL = r"'(?:[sdmt]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]+|_+)+|\s+(?!\S)|\s+"
_WORDS = r"'(?:[sdmt]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]+|_+)+"
_TEMPLATES = ("a{}a", "1{}1", "!{}!", " {} ", "{0}{0}a", "a {}", "'{}")
#: Byte-level files write byte b as a printable character: itself where it is one, else the next from U+0100 on.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_PRINTABLE = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _SELF)}
#: Lengths of pre-tokens that a worker keeps.
LENGTHS = 600_000
#: Longer pre-tokens are encoded but not kept.
LONGEST_KEPT = 64


def resolve(path: str) -> str:
    """A file path, or the name of a file of the installed ``public_tokenizers`` package, on this machine."""
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def _ranges(chars) -> str:
    """The characters as the inside of a character set."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if b > a else re.escape(chr(a)) for a, b in spans)


class CachedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_entries: int = 300_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        file = resolve(path)
        self.library = Tokenizer.from_file(file)
        self.tokenize = self.library.model.tokenize
        with open(file, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.lower = config["normalizer"] is not None
        self.pattern = re.compile(_WORDS if self.lower else _BYTE_LEVEL)
        self.limit = LENGTHS
        self.words = Kept(self.one, cache_entries)
        self.lengths: dict[str, int] = {}
        self.agreed = self._agreed()
        # explicit sets of the agreed characters are searched about twice as fast as classes
        letters = _ranges(c for c in self.agreed if re.match(r"[^\W\d_]", c))
        marks = _ranges(c for c in self.agreed if re.match(r"[^\s\w]|_", c))
        self.pattern = re.compile(self.pattern.pattern.replace("(?:[^\\s\\w]+|_+)+", f"[{marks}]+").replace("[^\\W\\d_]", f"[{letters}]"))
        # so pieces cover every text of agreed characters, but for white space where words are cut
        lost = [c for c in self.agreed for x in (c.lower() if self.lower else c) if not (x.isspace() or self.pattern.fullmatch(x))]
        if lost:
            raise ValueError(f"characters that the pre-token pattern would lose: {lost}")

    def _agreed(self) -> frozenset[str]:
        """Characters on which the pattern above and the library's own pre-tokenizer cut alike."""
        spans = [range(0x3000)] if not self.lower else [range(0x300), range(0x370, 0x530), range(0x2000, 0x2C00)]
        normal, cut = self.library.normalizer, self.library.pre_tokenizer.pre_tokenize_str
        good = []
        for c in (chr(i) for span in spans for i in span):
            if self.lower and not c.isspace() and any(normal.normalize_str(t) != t.lower() for t in (f"a{c}", f"{c}a", f"a{c}a")):
                continue
            for t in _TEMPLATES:
                text = t.format(c)
                seen = normal.normalize_str(text) if self.lower else text
                theirs = [seen[a:b] for _, (a, b) in cut(seen)]
                if self.pattern.findall(text.lower() if self.lower else text) != theirs:
                    break
            else:
                good.append(c)
        # the pattern meets what a character becomes in lower case, so that must be agreed too
        found = frozenset(good)
        while self.lower and (out := {c for c in found if not found.issuperset(c.lower())}):
            found -= out
        return found

    def pretokens(self, text: str) -> list[str] | None:
        """Pre-tokens of the text, or None where only the library may cut it."""
        if not self.agreed.issuperset(set(text)):
            return None
        for s in self.special:
            if s in text:
                return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def one(self, pretoken: str) -> bytes:
        """Ids of a text that is one pre-token: the library's model alone, on the bytes' printable characters."""
        return array("I", [x.id for x in self.tokenize(pretoken.encode().decode("latin-1").translate(_PRINTABLE))]).tobytes()

    def single(self, pretokens: list[str]) -> list[bytes]:
        return list(map(self.one, pretokens))

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def admit(self, wanted: set[str], cache: dict, convert=None, base: dict | None = None) -> list[str]:
        """Puts what the cache lacks into it; returns the entries to be dropped again after use.

        A full cache keeps what it has, unless most of what is wanted is missing: then it starts anew from
        ``base``. ``convert`` turns the bytes of a pre-token's ids into the value to be kept.
        """
        missing = list(wanted.difference(cache))
        if len(missing) > len(wanted) // 2 and len(cache) > self.limit // 2:
            cache.clear()
            cache.update(base or {})
            missing = list(wanted.difference(cache))
        room = max(0, self.limit - len(cache))
        got = self.single(missing)
        cache.update(zip(missing, map(convert, got) if convert else got, strict=True))
        return [w for k, w in enumerate(missing) if k >= room or len(w) > LONGEST_KEPT]

    def each(self, texts: list[str], cache: dict, join, convert=None, base: dict | None = None) -> list:
        """``join`` over the cached values of each text's pre-tokens."""
        cuts = [self.pretokens(t) for t in texts]
        drop = self.admit(set().union(*(c for c in cuts if c is not None)), cache, convert, base)
        get = cache.__getitem__
        other = [i for i, c in enumerate(cuts) if c is None]
        whole = dict(zip(other, self.whole([texts[i] for i in other]), strict=True)) if other else {}
        out = [join([convert(whole[i]) if convert else whole[i]] if c is None else map(get, c)) for i, c in enumerate(cuts)]
        for w in drop:
            del cache[w]
        return out

    def text(self, text: str) -> bytes:
        """Ids of a whole text, from its pre-tokens where that is proven equal."""
        cut = self.pretokens(text)
        return self.whole([text])[0] if cut is None else b"".join(map(self.words.__getitem__, cut))

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.text, texts))


class Kept(dict):
    """Values made on demand and kept up to a limit; anew when most of what comes is no longer among them."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.missed = make, limit, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) < self.limit:
            if len(key) <= LONGEST_KEPT:
                self[key] = value
        else:
            self.missed += 1
            if self.missed > 4 * self.limit:
                self.clear()
                self.missed = 0
        return value


@lru_cache(maxsize=4)
def encoder(path: str, cache_entries: int = 300_000) -> CachedEncoder:
    """One encoder per file and Python worker."""
    return CachedEncoder(path, cache_entries)
