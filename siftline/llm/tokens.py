"""Encoding with a public tokenizer, and tokens attributed to fields and sections."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import ragged, strings

# Bytes of cached pieces, about, before the cache starts anew; longer pieces than LONGEST characters are not kept.
CACHE_BYTES, LONGEST = 96 << 20, 256
_ENTRY_BYTES = 200
# Bytes of texts that are encoded together where offsets are kept.
BYTES_AT_ONCE = 1 << 20
# Lower-case pieces that the normalizer leaves as they are, and the units that the pre-tokenizer makes of them: runs of letters,
# single digits, runs of marks. Pieces with an apostrophe (contractions) or with other characters go to the library whole.
_LETTERS, _MARKS = "a-z\u00df-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+").fullmatch
_UNITS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+").findall


# The parts of the two tokenizers' files that decide where texts may be cut, as the encoders below rely on them.
_WORD_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_BYTE_PARTS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "post_processor": None,
}
# Parts of a BPE model that would encode a piece otherwise than its merges do.
_PLAIN_MODEL = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def relies_on(path: str, parts: dict) -> bool:
    """Whether a tokenizer's file has exactly these parts, a plain BPE model, and added tokens that all begin with ``<|``."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model = found["model"]
    plain = model.get("type") == "BPE" and all(model.get(name, value) == value for name, value in _PLAIN_MODEL.items())
    own = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in found["added_tokens"])
    return plain and own and all(found.get(name) == value for name, value in parts.items())


class Pieces(dict):
    """A cache from pieces of text to bytes, bounded by its bytes: when half of them are taken, what is here becomes the earlier half,
    from which pieces that come again are taken over."""

    def __init__(self):
        super().__init__()
        self.held, self.earlier = 0, {}

    def keep(self, piece: str, value: bytes) -> bytes:
        if len(piece) <= LONGEST:
            self[piece] = value
            self.held += _ENTRY_BYTES + len(piece) + len(value)
        return value

    def bound(self) -> None:
        if self.held > CACHE_BYTES // 2:
            self.earlier, self.held = dict(self), 0
            self.clear()


def byte_letters() -> dict[int, str]:
    """The letter of each byte in a byte-level vocabulary: its own where printable in Latin-1, else the next from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(Pieces):
    """Ids of whole texts from a tokenizer that lowers case and drops white space, so that texts fall into pieces at blanks and line ends.

    Each distinct piece is encoded once by the library and its ids kept; the ids of a text are its pieces' ids in order,
    the same as the library gives for the whole text. With a tokenizer of any other kind, the library takes each text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.largest = self.tokenizer.get_vocab_size(with_added_tokens=True) - 1
        self.kind = np.dtype("<u2" if self.largest < 1 << 16 else "<u4")
        self._code = "H" if self.kind.itemsize == 2 else "I"
        self._model, self._letters = self.tokenizer.model, byte_letters()
        self.by_pieces = relies_on(path, _WORD_PARTS)

    def __missing__(self, piece: str) -> bytes:
        if (known := self.earlier.get(piece)) is not None:
            return self.keep(piece, known)
        lower = piece.lower() if _in_latin(piece) else piece
        if not piece:
            ids = b""
        elif "<|" in piece or not _PLAIN(lower):
            ids = array(self._code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        elif len(units := _UNITS(lower)) > 1:
            ids = b"".join([self[u] for u in units])
        elif lower != piece:
            ids = self[lower]
        else:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
            ids = array(self._code, [t.id for t in self._model.tokenize(letters)]).tobytes()
        return self.keep(piece, ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each UTF-8 text."""
        out = []
        for raw in texts:
            if not self.by_pieces:
                ids = self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
                out.append(array(self._code, ids).tobytes())
                continue
            self.bound()
            text = raw.decode("utf-8", "replace").replace("\n", " ")
            if "<|" not in text and _in_latin(text):
                text = text.lower()
            out.append(b"".join(map(self.__getitem__, text.split(" "))))
        return out


def _in_latin(text: str) -> bool:
    """Only Latin-1: there lower case goes letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a worker process, whose cache outlives a task."""
    return Encoder(path)


RULES = ("start", "largest", "share")


def allotted(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens of each section, of those the tokens that cross its edge, tokens outside all sections).

    ``tokens`` and ``sections`` are (start, end) rows in order; sections do not overlap. A token inside one section
    belongs to it. One that crosses an edge goes, by ``rule``, to the section of its first character (``start``; the
    first section it meets, if that character stands between sections), to the section that holds most of it
    (``largest``; the earlier of equals) or to all that it meets by their share of its characters there (``share``).
    """
    none = np.zeros(len(sections)), np.zeros(len(sections), np.int64), float(len(tokens))
    if not len(sections) or not len(tokens):
        return none
    start, stop = tokens[:, 0], np.maximum(tokens[:, 1], tokens[:, 0] + 1)
    first = np.searchsorted(sections[:, 1], start, "right")
    last = np.searchsorted(sections[:, 0], stop, "left") - 1
    met = last >= first
    group, place = ragged(np.where(met, last - first + 1, 0))
    section = first[group] + place
    shared = np.minimum(stop[group], sections[section, 1]) - np.maximum(start[group], sections[section, 0])
    cross = shared < (stop - start)[group]
    if rule == "share":
        weight = shared / np.bincount(group, shared, minlength=len(tokens))[group]
    else:
        rank = -shared if rule == "largest" else place
        order = np.lexsort((place, rank, group))
        weight = np.zeros(len(group))
        weight[order[np.flatnonzero(np.diff(group[order], prepend=-1))]] = 1.0
    counts = np.bincount(section, weight, minlength=len(sections))
    crossing = np.bincount(section[cross & (weight > 0)], minlength=len(sections))
    return counts, crossing, float((~met).sum())


def field_sections(texts: list[str], gap: int) -> tuple[list[int], np.ndarray]:
    """(field number, spans) of the sections of a document of joined fields: each field but the last, and the last one's lines.

    Empty fields and lines are no sections.
    """
    fields, spans, at = [], [], 0
    for number, text in enumerate(texts):
        if number + 1 < len(texts):
            parts = [(0, len(text))]
        else:
            ends = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
            parts = [(a + 1, b) for a, b in zip(ends, ends[1:])]
        for a, b in parts:
            if a < b:
                fields.append(number)
                spans.append((at + a, at + b))
        at += len(text) + gap
    return fields, np.array(spans, np.int64).reshape(-1, 2)


# White space of plain texts, how a byte-level pre-tokenizer cuts texts around it, and white space that is not plain.
_BLANK = r" \t\n\x0b\x0c\r"
_CUTS = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+").findall
_ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
# Pieces of Latin-1 letters, digits and ASCII marks, and the units that the pre-tokenizer makes of them. Apostrophes (contractions) and other
# characters go to the library.
_LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIMPLE = re.compile(f" ?[{_LATIN}0-9{_MARKS}]+").fullmatch
_SIMPLE_UNITS = re.compile(f" ?[{_LATIN}]+| ?[0-9]+| ?[{_MARKS}]+").findall


class OffsetEncoder(Pieces):
    """Places of the tokens of whole texts, from a byte-level tokenizer.

    Its pre-tokenizer never joins what stands before a blank with what stands after, so a text is the sequence of its
    words with the blank before each; each distinct one is encoded once by the library and its places kept. With a
    tokenizer of any other kind, the library takes each text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._model, self._letters = self.tokenizer.model, byte_letters()
        self.by_pieces = relies_on(path, _BYTE_PARTS)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    def __missing__(self, piece: str) -> bytes:
        if (known := self.earlier.get(piece)) is not None:
            return self.keep(piece, known)
        places = array("i")
        if not _SIMPLE(piece):
            for a, b in self.tokenizer.encode(piece, add_special_tokens=False).offsets:
                places.extend((a, b))
        elif len(units := _SIMPLE_UNITS(piece)) > 1:
            at = 0
            for unit in units:
                own = array("i", self[unit])
                places.extend([x + at for x in own] if at else own)
                at += len(unit)
        else:
            # A token's letters are bytes; a character of two bytes counts for each token that holds one of them.
            letters = piece.encode().decode("latin-1").translate(self._letters)
            of_byte = None if len(letters) == len(piece) else [i for i, c in enumerate(piece) for _ in range(1 + (c > "\x7f"))]
            at = 0
            for token in self._model.tokenize(letters):
                end = at + len(token.value)
                places.extend((at, end) if of_byte is None else (of_byte[at], of_byte[end - 1] + 1))
                at = end
        return self.keep(piece, places.tobytes())

    def offsets(self, text: str) -> np.ndarray:
        """(start, end) of each token, in code points."""
        if not self.by_pieces or _ODD_BLANK(text):
            return self.whole(text)
        self.bound()
        pieces = _CUTS(text)
        known = list(map(self.__getitem__, pieces))
        places = np.frombuffer(b"".join(known), np.int32).reshape(-1, 2).astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(len, known), np.int64, len(known)) // 8
        return places + np.repeat(np.cumsum(sizes) - sizes, tokens)[:, None]


@lru_cache(maxsize=1)
def offset_encoder(path: str) -> OffsetEncoder:
    """The encoder of a worker process, whose cache outlives a task."""
    return OffsetEncoder(path)


def attributed(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "text"),
    rule: str = "largest", gap: str = " ",
) -> DataFrame:
    """(id, section, field, start, end, tokens, crossing): the tokens of each section of every row.

    A row's fields are joined by ``gap`` into one document, which is encoded once and whole; sections are the fields, the
    last one cut into its lines. Tokens that meet no section stand in section -1 with field null, so the counts
    of a row sum to its tokens. Null fields are empty; a row with no token still has its section -1, with 0. Places are in
    code points. Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, section int, field string, start long, end long, tokens double, crossing long"

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = offset_encoder(tokenizer)
        for batch in tables:
            texts = [[t.decode("utf-8", "replace") for t in row] for row in zip(*(strings(batch.column(i + 1)) for i in range(len(fields))))]
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held < BYTES_AT_ONCE):
                    held += sum(map(len, texts[stop]))
                    stop += 1
                rows, section, names, spans, counts, crossing = [], [], [], [], [], []
                for row in range(at, stop):
                    tokens = encoder.offsets(gap.join(texts[row]))
                    numbers, own = field_sections(texts[row], len(gap))
                    inside, edges, outside = allotted(tokens, own, rule)
                    rows += [row] * (len(own) + 1)
                    section += [-1, *range(len(own))]
                    names += [None, *(fields[n] for n in numbers)]
                    spans += [(None, None), *own.tolist()]
                    counts += [outside, *inside.tolist()]
                    crossing += [0, *edges.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())), pa.array(section, pa.int32()), pa.array(names, pa.string()),
                        pa.array([a for a, _b in spans], pa.int64()), pa.array([b for _a, b in spans], pa.int64()),
                        pa.array(counts, pa.float64()), pa.array(crossing, pa.int64()),
                    ],
                    names=[id_col, "section", "field", "start", "end", "tokens", "crossing"],
                )
                at = stop

    return docs.select(F.col(id_col), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields))).mapInArrow(batches, schema)
