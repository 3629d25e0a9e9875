"""Text functions as Column expressions. They follow Unicode, not ASCII, where a class of characters is meant."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that str.strip() knows.
_SPACE = r"[\s\x1c-\x1f]"
EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png")


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, so that chains of steps do not multiply in the plan."""
    return F.transform(F.array(value), use)[0]


def beyond_ascii(c: Column) -> Column:
    """Whether a text holds characters beyond ASCII; told by its length in bytes, which is cheap."""
    return F.octet_length(c) != F.length(c)


def _visible(char: Column) -> Column:
    """Whether a text starts with a character of ASCII that is no white space."""
    return F.ascii(char).between(33, 126)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; a text that plainly has none is not searched."""
    return F.when(_visible(c) & _visible(F.right(c, F.lit(1))), c).otherwise(_stripped(c))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (~_visible(c) & (F.length(_stripped(c)) == 0))


def _class(codes: list[int], gap: int = 1) -> str:
    """The inside of a character class that holds the codes; codes at most `gap` apart make one range."""
    runs: list[list[int]] = []
    for code in codes:
        if runs and code - runs[-1][1] <= gap:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


#: Hangul syllables and the three rows of letters that they are made of.
HANGUL = ("\uac00", "\ud7a3")
LEADS, VOWELS, TAILS = [chr(0x1100 + i) for i in range(19)], [chr(0x1161 + i) for i in range(21)], ["", *(chr(0x11A8 + i) for i in range(27))]


@cache
def _decompositions() -> tuple[dict[str, str], dict[str, str], list[int]]:
    """Characters whose compatibility decomposition without combining marks is one other character; those for which it
    is none or several (Hangul left out); and the code points of combining marks."""
    one, several, marks = {}, {}, []
    for code in range(0x80, 0x110000):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(code)
        elif unicodedata.decomposition(char):
            base = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
            if base != char:
                (one if len(base) == 1 else several)[char] = base
    return one, several, marks


def _spelt_out(c: Column) -> Column:
    """Each character that decomposes into several replaced by them; only texts that hold some do any work."""
    _, several, _ = _decompositions()
    # coarse ranges are quick to test; what they hold beyond the map stays as it is
    coarse = _class(sorted(map(ord, several)), gap=0x40) + "".join(f"{HANGUL[0]}-{HANGUL[1]}")
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())), F.lit("\x01"), F.lit("\x02"))

    def letters(char: Column) -> Column:
        i = F.ascii(char) - 0xAC00
        at = lambda rows, j: F.element_at(F.split(F.lit(",".join(rows)), ","), j.cast("int") + 1)
        hangul = F.concat(at(LEADS, F.floor(i / 588)), at(VOWELS, F.floor(i % 588 / 28)), at(TAILS, i % 28))
        return F.when(char.between(*HANGUL), hangul).otherwise(F.coalesce(F.try_element_at(known, char), char))

    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"[{coarse}]"), F.lit(0)))
    return F.when(c.rlike(f"[{coarse}]"), F.aggregate(found, c, lambda text, char: F.replace(text, char, letters(char)))).otherwise(c)


def strip_accents(c: Column) -> Column:
    """The full compatibility decomposition without combining marks; only texts beyond ASCII do any work."""
    one, _, marks = _decompositions()
    bare = F.regexp_replace(_spelt_out(c), rf"[\p{{M}}\p{{Cn}}&&[{_class(marks)}]]", "")
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(bare, "".join(one), "".join(one.values()))).otherwise(c)


@cache
def _digits() -> tuple[str, str, list[int]]:
    """Decimal digits of all scripts, what they stand for, and the code points that isdigit() calls digits beyond them."""
    plain = [chr(c) for c in range(0x80, 0x110000) if chr(c).isdecimal()]
    return "".join(plain), "".join(str(unicodedata.decimal(c)) for c in plain), [c for c in range(0x80, 0x110000) if chr(c).isdigit() and not chr(c).isdecimal()]


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    return let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.translate(x, *_digits()[:2])).otherwise(x))


def other_digits() -> str:
    """The inside of a character class of digits that are no decimal ones, superscripts for instance."""
    return _class(_digits()[2])


def all_digits() -> str:
    """The inside of a character class of all digits beyond ASCII."""
    return _class(sorted([*map(ord, _digits()[0]), *_digits()[2]]))


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII that case folding turns into one other character, and those that it turns into several."""
    changed = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.casefold() != c}
    return {c: f for c, f in changed.items() if len(f) == 1}, {c: f for c, f in changed.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """Full case folding: small letters first, then what folding says beyond them; only texts beyond ASCII need the latter."""
    one, several = _folds()

    def folded(x: Column) -> Column:
        single = F.translate(x, "".join(one), "".join(one.values()))
        found = F.array_distinct(F.regexp_extract_all(single, F.lit(f"[{_class(sorted(map(ord, several)))}]"), F.lit(0)))
        known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())), F.lit("\x01"), F.lit("\x02"))
        return F.aggregate(found, single, lambda text, char: F.replace(text, char, F.element_at(known, char)))

    return F.when(beyond_ascii(c), let(F.lower(c), folded)).otherwise(F.lower(c))


def normalize_text(c: Column) -> Column:
    """No accents, small letters, punctuation to spaces, single spaces, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}_]+", " "))


@cache
def _latin() -> dict[str, str]:
    """Printable ASCII and the letters up to U+017F that are one letter of ASCII with accents, as norm_key() writes them."""
    one = _decompositions()[0]
    letters = {c: one[c].lower() for c in map(chr, range(0xC0, 0x180)) if "a" <= one.get(c, "").lower() <= "z"}
    return letters | {chr(i): chr(i).lower() for i in range(0x20, 0x7F)} | {"_": " "}


def norm_key(c: Column) -> Column:
    """F1: field names compare without accents, case, underscores and repeated space; punctuation counts.

    Names in plain Latin letters take one translation.
    """
    latin = _latin()
    changed = {k: v for k, v in latin.items() if k != v}
    quick = F.trim(F.regexp_replace(F.translate(c, "".join(changed), "".join(changed.values())), " {2,}", " "))
    slow = F.trim(F.regexp_replace(casefold(F.translate(strip_accents(c), "_", " ")), rf"(?U){_SPACE}+", " "))
    return F.when(c.rlike(rf"^[{_class(sorted(map(ord, latin)))}]*\z"), quick).otherwise(slow)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """The last `.ext` of a file name; '' where the dot is the first or the last character."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def is_supported_ext(path: Column) -> Column:
    """S2"""
    return F.lower(suffix(file_name(path))).isin(*EXTENSIONS)
