"""The two metric profiles.

``core`` follows ECMAScript regular-expression classes (ASCII words, Unicode
white space, four line terminators); ``service`` follows Python's (Unicode
words, one line terminator). Java's own ``\\s``, ``\\b`` and ``.`` match
neither, so every class is spelled out and words are bounded by look-around.

A negated class holds one wide item at most: a pattern with a class of two took 0.17
microseconds a character in one thread and 2 in eight of one JVM, for the type checks, it
seems, that Java makes in a union of a union.
"""

from __future__ import annotations

from dataclasses import dataclass

# White space, as insides of a regular-expression class. The wide
# part sits behind one range test, so most characters fail after two tests.
_ASCII_SPACE = r"\t\n\x0b\f\r "
_WIDE_SPACE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE_CHARS = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@dataclass(frozen=True)
class Dialect:
    name: str
    space: str
    space_chars: str
    word: str
    digit: str
    eol: str

    @property
    def inline_space(self) -> str:
        """White space other than the newline, as the inside of a class."""
        return self.space.replace(r"\n", "")

    @property
    def s(self) -> str:
        return f"[{self.space}]"

    @property
    def w(self) -> str:
        """One word character; the bare ``\\w`` is quicker than a class."""
        return self.word if self.word == r"\w" else f"[{self.word}]"

    @property
    def rest_of_line(self) -> str:
        """Everything up to a line end. Java's dot also stops at U+0085, which
        is no line end here, but tests faster than a class."""
        return r".*+(?:\u0085.*+)*+" if self.is_core else rf"[^{self.eol}]*+"

    @property
    def line_start(self) -> str:
        return r"(?<!.)(?<!\u0085)" if self.is_core else f"(?<![^{self.eol}])"

    def words(self, *words: str) -> str:
        """Pattern for any of the words standing alone. The look-ahead drops
        most positions before the dearer look-behind is tried."""
        heads = "".join(sorted({w[0] for w in words}))
        return f"(?=[{heads}])(?<!{self.w})(?:{'|'.join(words)})(?!{self.w})"

    @property
    def is_core(self) -> bool:
        return self.name == "core"


CORE = Dialect(
    "core",
    space=rf"{_ASCII_SPACE}\u00a0[\u1680-\ufeff&&[{_WIDE_SPACE}\ufeff]]",
    space_chars="\t\n\x0b\f\r \xa0" + "".join(map(chr, _WIDE_CHARS)) + "\ufeff",
    word=r"\w",
    digit="0123456789",
    eol=r"\n\r\u2028-\u2029",
)
SERVICE = Dialect(
    "service",
    space=rf"{_ASCII_SPACE}\x1c\x1d\x1e\x1f\x85\u00a0[\u1680-\u3000&&[{_WIDE_SPACE}]]",
    space_chars="\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, _WIDE_CHARS)),
    word=r"\p{L}\p{N}_",
    digit=r"\p{Nd}",
    eol=r"\n",
)
_BY_NAME = {"core": CORE, "service": SERVICE}


def dialect(profile: str | Dialect) -> Dialect:
    return profile if isinstance(profile, Dialect) else _BY_NAME[profile]
