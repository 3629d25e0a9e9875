"""Secret scan: fixed credential patterns plus a sliding-window entropy detector.

Base kinds are `assign`, `access` and `hex`. The method adds the kind `entropy`: over every candidate string (a run of
token characters, `=` only as padding at its end) a window slides with incrementally kept character counts; the Shannon
entropy of the window is compared with a threshold of the character class of that window (hex, letters, alphanumeric,
base64; windows of digits are numbers). Suppressed are proven shapes only: UUIDs, numbers and words joined by - or _, one
repeated unit, e-mail addresses, and URLs without user information up to their query.

Edge cases: null and empty texts give no spans; very long candidates cost O(length), since counts are incremental;
repeated rows give repeated results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_batches

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")

#: Window length, and bits per character that a window of a class must reach (hex tops out at 4.0).
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "letters": 3.9, "alnum": 3.7, "base64": 3.9}
LEAST = min(THRESHOLDS.values())
#: The first class that holds all characters of a window counts.
CLASSES = {"digits": str.isdigit, "hex": frozenset("0123456789abcdefABCDEF").__contains__, "letters": str.isalpha, "alnum": str.isalnum}

ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    # words and camel humps; a longer run of letters is no proven word
    re.compile(r"[-_/+=]*+(?:(?:[A-Z]?[a-z]{2,19}+(?![a-z])|(?:A[nst]|B[ey]|Do|Go|I[dfnst]|M[ey]|No|O[fnr]|To|Up)(?![a-z])|[A-Z]{2,19}+(?![A-Z])|[A-Za-z](?![A-Za-z]))[-_/+=]*+)++"),
    re.compile(r"[-_/+=]*[0-9]+([-_/+=]+[0-9]+)*[-_/+=]*"),
    re.compile(r"(.{1,8})\1+"),
)

#: A URL up to its query, and an e-mail address; neither may hold or be user information, as in scheme://user:password@host.
URL = re.compile(r"\b(?:https?|ftps?|wss?|file)://[A-Za-z0-9.:_%-]*+(?!@)(?:/[A-Za-z0-9._~%/+-]*+)?", re.IGNORECASE)
USER_INFO = re.compile(r"""://[^\s/?#"'<>]*@""")
EMAIL = re.compile(r"(?:(?<=mailto:)|(?<![A-Za-z0-9._%+:/-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, kinds array<string>, starts array<long>, ends array<long>"


def window_entropies(text: str, width: int = WINDOW) -> list[float]:
    """Shannon entropy of every window, from counts that change by two characters a step."""
    width = min(width, len(text))
    if not width:
        return []
    term = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    for c in text[:width]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(term[n] for n in counts.values())
    top, out = math.log2(width), []
    out.append(top - total / width)
    for gone, come in zip(text, text[width:], strict=False):
        if gone != come:
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
            n = counts.get(come, 0)
            total += term[n + 1] - term[n]
            counts[come] = n + 1
        out.append(top - total / width)
    return out


def reaches(word: str, width: int = WINDOW) -> bool:
    """Whether a window of word has the entropy that its own character class asks for."""
    runs = {name: list(accumulate((not test(c) for c in word), initial=0)) for name, test in CLASSES.items()}
    for i, bits in enumerate(window_entropies(word, width)):
        if bits >= LEAST:
            end = min(i + width, len(word))
            kind = next((name for name, other in runs.items() if other[end] == other[i]), "base64")
            if bits >= THRESHOLDS.get(kind, math.inf):
                return True
    return False


class Places:
    """Disjoint spans in order, asked by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def touch(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def hold(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start) - 1
        return i >= 0 and end <= self.ends[i]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def proven(text: str) -> list[Places]:
    """Places of URLs without user information, and of e-mail addresses."""
    logins = Places([m.span() for m in USER_INFO.finditer(text)] if "://" in text and "@" in text else [])
    kinds = [p.finditer(text) for sign, p in (("://", URL), ("@", EMAIL)) if sign in text]
    return [Places([m.span() for m in found if not logins.touch(*m.span())]) for found in kinds]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Candidate strings with a window over the threshold of its class, proven shapes left out."""
    found, harmless = [], None
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if word.isdigit() or any(p.fullmatch(word) for p in ALLOW) or not reaches(word):
            continue
        harmless = proven(text) if harmless is None else harmless
        if not any(p.hold(*m.span()) for p in harmless):
            found.append(m.span())
    return found


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span in text, sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 and more found from the left is the same maximal run that [0-9a-f]+ finds
    spans += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    base = sorted(spans)
    taken = Places(joined([(s, e) for s, _, e in base]))
    extra = [(s, 3, e) for s, e in entropy_spans(text) if not taken.touch(s, e)]
    return sorted(base + extra)


def _scan(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {n.split(" ")[0]: [] for n in SCHEMA.split(", ")}
    for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
        spans = scan_text(text or "")
        out["doc_id"].append(doc_id)
        for i, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(k == i for _, k, _ in spans))
        out["kinds"].append([KINDS[k] for _, k, _ in spans])
        out["starts"].append([s for s, _, _ in spans])
        out["ends"].append([e for _, _, e in spans])
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, and parallel arrays kinds / starts / ends of all spans.

    Offsets are code points, ends exclusive. Rows keep their partitions; nothing is shuffled.
    """
    return map_batches(docs.select("doc_id", "text"), _scan, SCHEMA)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
