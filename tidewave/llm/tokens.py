"""Byte-level BPE ids of whole texts with the tokenizers library, for use inside tasks.

A single space between two characters that aren't white space always begins a new pre-token, so a text
may be cut before such spaces and its parts encoded apart with the same ids. Encoder does that and
keeps the ids of short parts it has met, up to a fixed number of bytes. Parts that are letters with punctuation behind
them are one or two pre-tokens, which go to the library's BPE model at once; all others go through its
whole encoder. Texts with other white space next to a space, and texts that hold one of the tokenizer's
added tokens (which the library takes out before it cuts anything), go there uncut.

Very long texts are encoded whole; a long part (an unspaced text, say) is encoded and forgotten.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterable

PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
#: Bytes of parts and ids that a process remembers in one generation at most (there are two), and the longest part remembered.
REMEMBER, LONGEST = 120 << 20, 64
#: What a part costs besides its letters and ids: two objects' headers and a place in the dictionary.
ENTRY = 170


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for themselves, the rest for those from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Parts(dict):
    """part -> its ids as bytes, None where a text with that part must not be cut; lead stands before each part.

    Two generations: what is met is in this dict; when it is full, it becomes `old`, and parts met again come back from there.
    """

    def __init__(self, lib, code: str, lead: str, remember: int):
        self.lib, self.model, self.code, self.lead, self.letters = lib, lib.model, code, lead, _byte_letters()
        self.mark, self.tails, self.old, self.bytes, self.remember = lead.translate(self.letters), {"": b""}, {}, 0, remember

    def keep(self, part: str, ids: bytes | None) -> None:
        if len(part) > LONGEST:
            return
        self.bytes += ENTRY + (len(part) if part.isascii() else 4 * len(part)) + len(ids or b"")
        if self.bytes > self.remember:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self[part] = ids

    def _ids(self, s: str) -> bytes:
        s = s.translate(self.letters) if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(s)]).tobytes()

    def __missing__(self, part: str) -> bytes | None:
        if part in self.old:
            out = self.old[part]
        elif part.isalpha():  # one pre-token
            out = array(self.code, [t.id for t in self.model.tokenize(self.mark + part)]).tobytes() if part.isascii() else self._ids(self.lead + part)
        elif (m := PLAIN.fullmatch(part)) and m[1].isalpha():  # and another behind it
            letters, tail = m.groups()
            end = self.tails.get(tail)
            if end is None:
                end = self._ids(tail)
                if len(tail) <= 8 and len(self.tails) < 10_000:
                    self.tails[tail] = end
            word = self.get(letters) or self.old.get(letters)
            out = (self.__missing__(letters) if word is None else word) + end
        elif not part or part[0].isspace() or part[-1].isspace():
            out = None
        else:
            out = array(self.code, self.lib.encode(self.lead + part, add_special_tokens=False).ids).tobytes()
        self.keep(part, out)
        return out


class Encoder:
    """text -> bytes of little-endian unsigned ids of the given numpy type."""

    def __init__(self, path: str, kind: str = "<u4", remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        # a text has one head, and most parts behind it
        self.heads, self.rest = _Parts(self.lib, self.code, "", remember // 16), _Parts(self.lib, self.code, " ", remember - remember // 16)
        added = [t.content for t in self.lib.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).search if added else lambda t: None

    def whole(self, text: str) -> bytes:
        return array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out = []
        gc.disable()  # nothing here makes cycles, and collections would walk all that is remembered
        try:
            for t in texts:
                if self.added(t):
                    out.append(self.whole(t))
                    continue
                head, *rest = t.split(" ")
                try:
                    out.append(self.heads[head] + b"".join(map(self.rest.__getitem__, rest)))
                except TypeError:  # a None among them
                    out.append(self.whole(t))
        finally:
            gc.enable()
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str = "<u4") -> Encoder:
    """One a worker process, loaded once."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
