"""File and folder names from user patterns, compiled to Column expressions.

A null anywhere makes the whole name null: such a document must not be filed under half a name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import PurePosixPath, PureWindowsPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, strip, strip_accents

#: The form of a token, characters that a file name must not hold, and reserved names.
TOKEN = re.compile(r"\{([^{}:]+)(?::([^{}]+))?\}")
FORBIDDEN = r'[<>:"/\\|?*]'
#: A component that is safe as it stands, so far as it is short enough: no such characters, no point, longer than reserved names.
SAFE = r'^[!-~&&[^<>:"/\\|?*.]][ -~&&[^<>:"/\\|?*.]]{3,}[!-~&&[^<>:"/\\|?*.]]\z'
RESERVED = (
    "CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)

Lookup = Callable[[str], Column]


def from_map(fields: Column) -> Lookup:
    return lambda name: F.try_element_at(fields, F.lit(name))


def strip_quotes(c: Column) -> Column:
    """N1"""
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"""^["']+|["']+\z""", ""))


def _ends(c: Column) -> Column:
    return F.regexp_replace(c, r"[ .]+\z", "")


def sanitize_component(c: Column, max_len: int = 200) -> Column:
    """One safe path component; null stays null."""
    def trimmed(x: Column) -> Column:
        return F.when(x.rlike(r"^[. ]*\z"), F.lit("_")).otherwise(_ends(x))

    def unreserved(x: Column) -> Column:
        base = F.when(x.contains("."), F.regexp_extract(x, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(x)
        return F.when(F.upper(base).isin(*RESERVED), F.concat(F.lit("_"), x)).otherwise(x)

    def shortened(x: Column) -> Column:
        ext = F.regexp_extract(x, r"(?s)(\.[^.]*)$", 1)
        room = F.lit(max_len) - F.length(ext)
        kept = _ends(F.when((F.length(ext) > 0) & (room > 0), F.concat(F.substr(x, F.lit(1), F.least(room, F.length(x) - F.length(ext))), ext)).otherwise(F.substr(x, F.lit(1), F.lit(max_len))))
        return F.when(F.length(x) > max_len, F.coalesce(F.nullif(kept, F.lit("")), F.lit("_"))).otherwise(x)

    slow = let(let(let(F.regexp_replace(c, FORBIDDEN, "_"), trimmed), unreserved), shortened)
    return F.when(c.rlike(SAFE) & (F.length(c) <= max_len), c).otherwise(slow)


def head(c: Column, n: int) -> Column:
    """The first n characters; a negative n leaves out as many at the end."""
    return F.substr(c, F.lit(1), F.lit(n)) if n >= 0 else F.substr(c, F.lit(1), F.greatest(F.length(c) + n, F.lit(0)))


def head_words(c: Column, n: int) -> Column:
    words = F.filter(F.split(strip(c), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    count = F.lit(n) if n >= 0 else F.greatest(F.size(words) + n, F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), count), " ")


def fmt_date(iso: Column, spec: str) -> Column:
    """Aaaa, mm and dd of an ISO date; null for any other value. Months are not checked."""
    parts = F.split(iso, "-")
    out = F.replace(F.lit(spec), F.lit("aaaa"), F.get(parts, F.lit(0)))
    out = F.replace(F.replace(out, F.lit("mm"), F.get(parts, F.lit(1))), F.lit("dd"), F.get(parts, F.lit(2)))
    places = {"aaaa": (1, 4), "mm": (6, 2), "dd": (9, 2)}
    pieces = [F.substring(iso, *places[p]) if p in places else F.lit(p) for p in re.split("(aaaa|mm|dd)", spec) if p]
    plain = iso.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.when(plain, F.concat(*pieces) if pieces else F.lit("")).when(iso.rlike(r"(?U)^\d{4}-\d+-\d+\z"), out)


def _whole(text: str) -> int | None:
    try:
        return int(text)
    except ValueError:
        return None


def apply_filter(c: Column, spec: str) -> Column:
    """One filter of a token; unknown filters and arguments that are no whole numbers change nothing."""
    name, _, arg = spec.strip().partition("=")
    if name == "palavras" and _whole(arg) is not None:
        return head_words(c, _whole(arg))
    if name in ("letras", "truncar") and _whole(arg) is not None:
        return head(c, _whole(arg))
    if spec.strip() == "maiusc":
        return F.upper(c)
    if spec.strip() == "minusc":
        return F.lower(c)
    if spec.strip() == "sem_acento":
        return strip_accents(c)
    if name == "substituir":
        old, _, new = arg.partition(">")
        return F.replace(c, F.lit(old), F.lit(new)) if old else F.regexp_replace(c, "(?s)(?=.)|$", re.sub(r"([\\$])", r"\\\1", new))
    if name == "formato":
        return fmt_date(c, arg)
    return c


def substitute(pattern: str, fields: Lookup) -> Column:
    """The pattern with its tokens filled in; null if a token has no value and no padrao= default."""
    parts, at = [], 0
    for m in TOKEN.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        value = fields(m[1].strip())
        missing, filters = blank(value), [f.strip() for f in m[2].split(":")] if m[2] is not None else []
        default = next((f[len("padrao=") :] for f in filters if f.startswith("padrao=")), None)
        shortcut = m[2] is not None and "=" not in m[2].strip() and re.search("aaaa|mm|dd", m[2])

        def piped(c: Column, filters=filters) -> Column:
            for f in filters:
                c = apply_filter(c, f)
            return c

        filled = fmt_date(value, m[2].strip()) if shortcut else piped(value)
        parts.append(F.when(~missing, filled) if default is None else F.when(~missing, filled).otherwise(piped(F.lit(default))))
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


def resolve_pattern(pattern: str, fields: Lookup, max_len: int = 200) -> Column:
    """A file name."""
    pattern = pattern.strip().strip("\"'").strip()
    return sanitize_component(substitute(pattern, fields), max_len)


def resolve_dest_folder(pattern: str, fields: Lookup, base: str, max_len: int = 200) -> Column:
    """A folder. A drive, share or root at the start is kept as it is; relative patterns go under base."""
    pattern = (pattern or "").strip().strip("\"'").strip()
    windows, posix = PureWindowsPath(pattern), PurePosixPath(pattern)
    if not pattern:
        return F.lit(None).cast("string")
    if windows.drive:
        anchor, segments, separator = windows.anchor, windows.parts[1:], "\\"
    elif posix.is_absolute():
        anchor, segments, separator = posix.anchor, posix.parts[1:], "/"
    else:
        anchor, segments, separator = base.rstrip("/") + "/", [s for s in re.split(r"[/\\]", pattern) if s not in ("", ".")], "/"
        if not segments:
            return F.lit(None).cast("string")
    parts: list[Column] = [F.lit(anchor)]
    for i, segment in enumerate(segments):
        parts += [F.lit(separator)] * (i > 0) + [sanitize_component(substitute(segment, fields), max_len)]
    return F.concat(*parts)
