"""Pre-tokens of byte-level BPE text, exactly as the tokenizers library cuts them, at the speed of one regular expression."""

from __future__ import annotations

import functools
import os
import re
import unicodedata

#: Both engines agree on every code point below this one; texts with later ones (where Unicode versions may differ) go through the library.
AGREED_BELOW = 0x540
_LATER = re.compile(f"[\\U{AGREED_BELOW:08x}-\\U0010ffff]")


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256))
    return [chr(b) if b in keep else chr(256 + next(others)) for b in range(256)]


@functools.cache
def _fast():
    """The library's pattern below AGREED_BELOW with its classes written out, which `re` runs faster than property lookups."""
    below = [chr(c) for c in range(AGREED_BELOW)]
    letters = "".join(re.escape(c) for c in below if unicodedata.category(c)[0] == "L")
    digits = "".join(re.escape(c) for c in below if unicodedata.category(c)[0] == "N")
    spaces = "".join(re.escape(c) for c in below if c.isspace() and not 0x1C <= ord(c) <= 0x1F)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall


class PreTokens:
    """Cuts a text at special strings, then into pre-tokens. specials: string -> id; pieces(text) yields pre-tokens and special ids."""

    def __init__(self, tokenizer):
        import json

        self.find = _fast()
        self.library = tokenizer.pre_tokenizer
        added = json.loads(tokenizer.to_str())["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens with stripping or word rules are not supported")
        self.specials = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.specials, key=len, reverse=True)
        #: What every special string begins with: a text without it holds none.
        self.hint = os.path.commonprefix(longest_first)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if added else lambda t: [t]

    def words(self, segment: str) -> list[str]:
        if segment.isascii() or not _LATER.search(segment):
            return self.find(segment)
        return [segment[i:j] for _, (i, j) in self.library.pre_tokenize_str(segment)]

    def segments(self, text: str) -> list[str]:
        """Odd places hold special strings, even places plain text."""
        return self.cut(text) if self.hint in text else [text]
