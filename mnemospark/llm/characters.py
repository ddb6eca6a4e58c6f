"""Character properties shared by the text operators: invisible, unstable and look-alike characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts drawn like a Latin letter (lower case, then upper case).
CYRILLIC = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
            "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W"}
GREEK = {"ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
         "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C"}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B"}
COPTIC = {"Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X"}
LISU = {"ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U"}
LOOK_ALIKE = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **COPTIC, **LISU}

# Characters without ink outside the category of format characters.
FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍᠎⠀ㅤﾠ"

#: Java class of everything that shows nothing; its complement is a visible character.
BLANK_JAVA = r"\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
VISIBLE_JAVA = f"[^{BLANK_JAVA}]"

#: Blocks that hold unstable characters; ideographs, syllables and private use are stable as a whole.
_BLOCKS = ((0x00, 0x3400), (0xA4D0, 0xAC00), (0xF900, 0x10000), (0x10000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def invisible(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or ch in FILLERS or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or (o < 32 and not ch.isspace()) or 0x7F <= o < 0xA0 and o != 0x85


@lru_cache(1)
def folding() -> dict[int, str | None]:
    """Translation of decomposed text: look-alikes to Latin, invisible characters to nothing."""
    table: dict[int, str | None] = {ord(a): b for a, b in LOOK_ALIKE.items()}
    for lo, hi in _BLOCKS:
        table |= {o: None for o in range(lo, hi) if invisible(chr(o))}
    return table


def fold(text: str) -> str:
    """The consistent form of a text or segment, white space apart."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text).translate(folding()))


@lru_cache(1)
def unstable_ranges() -> list[tuple[int, int]]:
    """Code points that the quick check cannot pass: those that fold changes by themselves,
    those that may combine with a character before them, and white space other than a space."""
    seconds = set()
    for lo, hi in _BLOCKS:
        for o in range(lo, hi):
            parts = unicodedata.decomposition(chr(o)).split()
            if len(parts) == 2 and parts[0][0] != "<":
                seconds.add(int(parts[1], 16))
    seconds |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    out: list[tuple[int, int]] = []
    for lo, hi in _BLOCKS:
        for o in range(lo, hi):
            ch = chr(o)
            if o in seconds or unicodedata.combining(ch) or (ch.isspace() and ch != " ") or fold(ch) != ch:
                if out and out[-1][1] == o - 1:
                    out[-1] = (out[-1][0], o)
                else:
                    out.append((o, o))
    return out


#: What the JVM's quick check passes at once: a few ranges that hold no unstable character.
_STABLE = ((0x20, 0x7E), (0xC0, 0x131), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x3001, 0x3002), (0x3008, 0x3011), (0x2010, 0x2010), (0x2018, 0x201D), (0x2190, 0x21FF), (0x2600, 0x27BF))


@lru_cache(1)
def python_class() -> str:
    """Exact in the basic plane, where a lookup is one step; beyond it whole blocks count as
    unstable, which only means that their characters are looked at."""
    low = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in unstable_ranges() if b < 0x10000)
    return low + "\U00010000-\U0001ffff\U0002f800-\U0002fa1f\U000e0000-\U000e01ff"


@lru_cache(1)
def java_stable() -> str:
    """A class of stable characters, without those that would be unstable in its ranges."""
    bad = {o for a, b in unstable_ranges() for o in range(a, b + 1)}
    parts = []
    for lo, hi in _STABLE:
        start = None
        for o in range(lo, hi + 2):
            good = o <= hi and o not in bad
            if good and start is None:
                start = o
            if not good and start is not None:
                parts.append(f"\\x{{{start:X}}}-\\x{{{o - 1:X}}}")
                start = None
    return "".join(parts)
