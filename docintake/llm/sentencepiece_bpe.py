"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies by a score-ordered agenda.

A text is put into the form the vocabulary is written in (a leading blank, blanks as U+2581) and cut where no piece of
the vocabulary can reach across: before a blank that follows another character, and between characters that no chain of
neighbours within pieces links. Merges never cross such a place, so each chunk is worked out by itself. In a chunk, an agenda holds the adjacent pairs of symbols that make a piece, best score first, leftmost of equals first; the pair on top
becomes one symbol, and its new neighbours join the agenda. The agenda of a short chunk is a list in order of place, whose
least number is looked for, that of a long one is a heap. Symbols that are no piece become their UTF-8 bytes. Each
distinct chunk of a worker is resolved once and remembered in a bounded table.

checked() holds the agenda against the sentencepiece library: every chunk that an Arrow batch resolves is encoded and
decoded by the library too, all chunks of the batch in one call, and each row says whether its chunks agree. Whole texts
are held against the library in the tests.

Edge cases: null and empty texts give no pieces (the end id alone, where it is asked for). The blank and U+2581 are one
in this format, so a text that holds U+2581 decodes with blanks there, as the library does it. One very long chunk costs
O(n log n). Rows are worked out each by itself; columns other than doc_id and text are not read. Models that are not of
the merge type, change the text first (other than by the leading blank) or have user-defined or unused pieces are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

#: Fixed values of the format: the mark that stands for a blank, and the kinds of pieces.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
#: Distinct chunks in each of the two generations that a worker remembers (about 0.25 KB each).
REMEMBERED = 350_000
#: Chunks of more characters are not remembered.
LONGEST = 64
#: Chunks of more characters have a heap as their agenda.
LISTED = 40
#: Stands in a list of ranks for a pair that is no piece; beyond all ranks.
NO_PIECE = 1 << 60
#: Error handler by which each byte that is no UTF-8 becomes one U+FFFD, as the library has it.
EACH_BYTE = "replace_each_byte"
codecs.register_error(EACH_BYTE, lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Model:
    """Pieces of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kinds = {p.type for p in spec.pieces}
        form = spec.normalizer_spec
        plain = form.escape_whitespaces and not (form.precompiled_charsmap or form.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix)
        if spec.trainer_spec.model_type != MERGE_TYPE or not plain or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("not a merge-type vocabulary over plain text")
        self.leading_blank = form.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        best = {score: rank for rank, score in enumerate(sorted({p.score for p in spec.pieces if p.type == NORMAL}, reverse=True))}
        self.ranks = {p.piece: best[p.score] for p in spec.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.end = next((i for i, p in enumerate(spec.pieces) if p.type == CONTROL and p.piece == (spec.trainer_spec.eos_piece or "</s>")), None)
        self.spoken = {str(i): p.piece.replace(BLANK, " ").encode() for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.spoken |= {str(i): bytes([b]) for b, i in self.byte_ids.items()}
        self.spoken |= {str(i): b"" for i, p in enumerate(spec.pieces) if p.type == CONTROL}
        self.spoken |= {str(i): (spec.trainer_spec.unk_surface or " ⁇ ").encode() for i, p in enumerate(spec.pieces) if p.type == UNKNOWN}
        self.names = {p: str(i) for p, i in self.ids.items()}
        said = [self.spoken[str(i)] for i in range(len(spec.pieces))]
        self.lengths = np.array([len(x) for x in said])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(said), np.uint8)
        self.is_byte = np.isin(np.arange(len(said)), list(self.byte_ids.values()))
        self.chunks = self._cutter().findall
        self.seen = Remembered(self)

    def _cutter(self) -> re.Pattern:
        """Splits a prepared text where no piece reaches across: blanks, then a run of characters that pieces link."""
        long = [p for p in self.ids if len(p) > 1]
        linked: dict[str, str] = {c: c for p in long for c in p}

        def root(c: str) -> str:
            while linked[c] != c:
                c = linked[c]
            return c

        inner = any(b == BLANK != a for p in long for a, b in zip(p, p[1:], strict=False))
        for p in long:
            for a, b in zip(p, p[1:], strict=False):
                if inner or BLANK not in (a, b):
                    linked[root(a)] = root(b)
        groups: dict[str, list[str]] = {}
        for c in sorted(linked):
            if inner or c != BLANK:
                groups.setdefault(root(c), []).append(re.escape(c))
        before = "" if inner else f"{BLANK}*"
        runs = [f"{before}[{''.join(g)}]+" for g in sorted(groups.values(), key=len, reverse=True)]
        return re.compile("|".join([*runs, f"{BLANK}+", "."]), re.DOTALL)

    def merge(self, chunk: str) -> list[str]:
        """The symbols of a chunk when no adjacent pair is a piece any more."""
        return self.merge_long(chunk) if len(chunk) > LISTED else self.merge_short(chunk)

    def merge_short(self, chunk: str) -> list[str]:
        """merge() with one number for each place in the agenda: the rank of the score of the pair that begins there."""
        find, symbols = self.ranks.get, list(chunk)
        agenda = [find(a + b, NO_PIECE) for a, b in zip(chunk, chunk[1:])]  # noqa: B905 - pairs
        while agenda and (best := min(agenda)) < NO_PIECE:
            i = agenda.index(best)
            del agenda[i]
            symbols[i] = made = symbols[i] + symbols.pop(i + 1)
            if i < len(agenda):
                agenda[i] = find(made + symbols[i + 1], NO_PIECE)
            if i:
                agenda[i - 1] = find(symbols[i - 1] + made, NO_PIECE)
        return symbols

    def merge_long(self, chunk: str) -> list[str]:
        """merge() with a heap; an entry is one number: rank of the score, place of the left symbol, length of the pair."""
        find, n = self.ranks.get, len(chunk)
        bits = n.bit_length()
        mask, shift = (1 << bits) - 1, 2 * bits
        symbols = list(chunk)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [rank << shift | i << bits | 2 for i in range(n - 1) if (rank := find(chunk[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry >> bits & mask
            first = symbols[i]
            if not first or (j := right[i]) >= n or len(first) + len(symbols[j]) != entry & mask:
                continue  # one of the two has become part of another symbol
            symbols[i] = made = first + symbols[j]
            symbols[j] = ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (rank := find(both := made + symbols[k])) is not None:
                    heappush(agenda, rank << shift | i << bits | len(both))
            if (k := left[i]) >= 0 and (rank := find(both := symbols[k] + made)) is not None:
                heappush(agenda, rank << shift | k << bits | len(both))
        return [s for s in symbols if s]

    def resolve(self, chunk: str) -> str:
        """Decimal ids of a chunk, joined by blanks."""
        symbols = self.merge(chunk)
        try:
            return " ".join([self.names[s] for s in symbols])
        except KeyError:
            return " ".join(self._ids(symbols))

    def _ids(self, symbols: Iterable[str]) -> Iterable[str]:
        for s in symbols:
            if (i := self.names.get(s)) is not None:
                yield i
            else:
                yield from (str(self.byte_ids[b]) for b in s.encode())

    def encode(self, text: str, end: bool) -> str:
        """Decimal ids of text, joined by blanks."""
        coded = map(self.seen.__getitem__, self.chunks(self.prepared(text)))
        return " ".join([*coded, str(self.end)] if end else coded)

    def prepared(self, text: str) -> str:
        return (BLANK if text and self.leading_blank else "") + text.replace(" ", BLANK)

    def spell(self, ids: str) -> bytes:
        return b"".join(map(self.spoken.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by blanks, without the leading blank; bytes that are no UTF-8 become U+FFFD each."""
        if not ids:
            return ""
        numbers = np.fromstring(ids, np.int64, sep=" ")
        if numbers.min() < 0:
            raise IndexError("not an id of the vocabulary")
        lengths = self.lengths[numbers]
        places = np.repeat(self.starts[numbers] - np.cumsum(lengths) + lengths, lengths)
        places += np.arange(len(places))
        data = self.blob[places].tobytes()
        if self.leading_blank and data[:1] == b" " and not self.is_byte[numbers[np.argmax(lengths > 0)]]:
            data = data[1:]
        return data.decode("utf-8", EACH_BYTE)


class Remembered(dict):
    """chunk -> its ids; resolved on first sight and then noted in `fresh`, where that is a list.

    When it is full it becomes the older generation; chunks met again move back, the others go with the next turn.
    """

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.older = model, {}
        self.fresh: list[tuple[str, str]] | None = None

    def __missing__(self, chunk: str) -> str:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.model.resolve(chunk)
            if self.fresh is not None:
                self.fresh.append((chunk, ids))
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Referee:
    """The library with the same pieces, without the leading blank, so that it takes chunks as they are."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        spec.normalizer_spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.model = Model(path)
        self.model.seen.fresh = []
        self.differing: set[str] = set()

    def judge(self) -> None:
        """Holds the chunks resolved since the last call against the library."""
        fresh, self.model.seen.fresh = self.model.seen.fresh, []
        theirs = self.library.encode([c for c, _ in fresh], num_threads=1)
        spoken = self.library.decode(theirs, num_threads=1)
        for (chunk, ids), want, said in zip(fresh, theirs, spoken, strict=True):
            if ids != " ".join(map(str, want)) or self.model.spell(ids).decode("utf-8", EACH_BYTE) != said:
                self.differing.add(chunk)

    def agrees(self, text: str) -> bool:
        return not self.differing or self.differing.isdisjoint(self.model.chunks(self.model.prepared(text)))


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


_REFEREES: dict[str, Referee] = {}


def referee(path: str) -> Referee:
    if path not in _REFEREES:
        _REFEREES[path] = Referee(path)
    return _REFEREES[path]


def encode(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """doc_id, ids array<int> for each row of docs(doc_id, text), by the model file at `path` (readable on every worker)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        m = model(path)
        coded = [m.encode(t or "", end) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "ids": [[int(i) for i in x.split(" ")] if x else [] for x in coded]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the inverse of encode(); null ids give a null text."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        m = model(path)
        return {"doc_id": rows["doc_id"], "text": [None if x is None else m.decode(" ".join(map(str, x))) for x in rows["ids"]]}

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id long, text string")


def checked(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees: encodes every text, decodes its ids and digests both.

    `agrees` is false where the library codes a chunk of the text otherwise; it changes nothing in the other columns.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        judge = referee(path)
        m = judge.model
        out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in rows["text"]:
            ids = m.encode(text or "", end)
            out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        judge.judge()
        out["agrees"] = [judge.agrees(t or "") for t in rows["text"]]
        return out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
