"""SentencePiece encoding that keeps where each piece comes from.

A text is normalised by the map compiled into the model: at each place the longest entry that fits is replaced, and
every byte written remembers the byte it was read from. Blanks become U+2581 and one is put in front. No piece
has that character after another one, so the normalised text is cut into units (a run of it and what follows),
and each distinct unit of a slice of the table is encoded once. Piece lengths, summed up, are offsets in the
normalised text; the remembered places turn them into spans of the original bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cohortlab.llm.shingles import binary
from cohortlab.llm.tables import field, in_arrow

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
# Bytes of text that are encoded together, but for one longer text, and bytes given to the library in one call.
SLICE, CALL = 2_000_000, 32_768
# Bytes of units and ids, with what Python adds to each, that are looked up again in later slices before they are
# forgotten; a unit longer than LONG is not looked up again.
REMEMBERED, ADDED, LONG = 24_000_000, 250, 256


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields of a serialised message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ((4, at) if kind == 5 else (8, at))
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double array over UTF-8 bytes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that ``data`` has at a place."""
        if not self.units:
            return None
        found, node, unit = None, 0, self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


def _width(byte: int) -> int:
    return 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


@dataclass(frozen=True)
class Encoded:
    """Ids of several texts one after the other, where those of each text begin, the byte of its text at which each
    piece ends, and the ids of each text joined by commas."""

    ids: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray
    joined: list[str]


class Pieces:
    """A model file: its normaliser, and the library's encoder for units."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            model = list(fields(file.read()))
        normaliser = dict(fields(next((v for k, v in model if k == 3), b"")))
        self.map = CharMap(normaliser.get(2, b""))
        self.prefix, self.tidy = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        if not normaliser.get(5, 1):
            raise ValueError("a model without escaped blanks is not supported")
        entries = [dict(fields(v)) for k, v in model if k == 1]
        texts = [e[1].decode() for e in entries]
        # Type 6: one byte; type 1, or none: a piece of text.
        self.sizes = np.array([1 if e.get(3) == 6 else len(e[1]) for e in entries], dtype=np.int64)
        by_unit = all(BLANK not in t.lstrip(BLANK) for t in texts)
        if not by_unit or not any(e.get(3) == 6 for e in entries) or any(e.get(3) == 4 for e in entries):
            raise ValueError("the model needs pieces for single bytes, no pieces across words and no own symbols")
        if not self.prefix:
            raise ValueError("a model that puts no blank in front is not supported")
        self.blank = texts.index(BLANK)
        # Bytes of a piece in the text, where a blank is one byte.
        self.plain = self.sizes - np.array([2 * t.count(BLANK) for t in texts])
        self.known: dict[bytes, tuple[bytes, str]] = {}
        self.held = 0
        self.digits = [str(i) for i in range(len(texts))]

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and the end, the place of the original byte."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.tidy:
            raw = np.frombuffer(data, np.uint8)
            blanks = np.where(raw == 0x20, 3, 1)
            places = np.repeat(np.arange(len(raw)), blanks)
            front = np.zeros(3, dtype=np.int64)
            return BLANK + text.replace(" ", BLANK), np.concatenate((front, places, [len(raw)]))
        out, places, at = [], [], 0
        while at < len(data):
            found = self.map.longest(data, at)
            size, new = found or (_width(data[at]), data[at : at + _width(data[at])])
            for i, byte in enumerate(new):
                # A copied character keeps its own bytes; a replacement belongs to the start of its source.
                out.append(byte)
                places.append(at + i if found is None else at)
            at += size
        if self.tidy:
            keep = [i for i, b in enumerate(out) if b != 0x20 or (i > 0 and out[i - 1] != 0x20)]
            while keep and out[keep[-1]] == 0x20:
                keep.pop()
            out, places = [out[i] for i in keep], [places[i] for i in keep]
        text = bytes(out).decode().replace(" ", BLANK)
        wide = np.where(np.array(out, dtype=np.uint8) == 0x20, 3, 1)
        places = np.repeat(np.array(places, dtype=np.int64), wide)
        front = np.full(3 * bool(out), places[0] if out else 0)
        return BLANK * bool(out) + text, np.concatenate((front, places, [len(data)]))

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def _learn(self, group: list[bytes], found: dict[bytes, tuple[bytes, str]]) -> None:
        """Encode new units in one call; the ends of the pieces tell which belong to which unit."""
        text = b"".join(group)[1:].decode()
        ids = np.array(self.library.encode(text) if text else [self.blank], dtype=np.int32)
        # A blank is one byte here and three in pieces.
        sizes = np.fromiter((3 * len(u) - 2 * len(u.lstrip(b" ")) for u in group), np.int64, len(group))
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1
        names = [self.digits[i] for i in ids.tolist()]
        data = ids.tobytes()
        first = 0
        for unit, last in zip(group, ends.tolist(), strict=True):
            found[unit] = data[4 * first : 4 * last], ",".join(names[first:last])
            first = last

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of units that all begin with a blank, how many each has, and each joined by commas.

        A unit of blanks only would run into the next one, so it goes by itself.
        """
        found = {u: self.known[u] for u in units if u in self.known}
        group, size = [], 0
        for unit in units:
            if unit in found:
                continue
            if unit.strip(b" "):
                group.append(unit)
                size += len(unit)
            else:
                self._learn([unit], found)
            if size > CALL:
                self._learn(group, found)
                group, size = [], 0
        if group:
            self._learn(group, found)
        for unit, (ids, text) in found.items():
            if len(unit) <= LONG and unit not in self.known:
                if self.held > REMEMBERED:
                    self.forget()
                self.known[unit] = ids, text
                self.held += len(unit) + len(ids) + len(text) + ADDED
        pairs = [found[u] for u in units]
        counts = np.fromiter((len(ids) for ids, _ in pairs), np.int64, len(pairs)) // 4
        return np.frombuffer(b"".join([ids for ids, _ in pairs]), np.int32), counts, [text for _, text in pairs]

    def encode(self, texts: list[bytes]) -> Encoded:
        parts, places = [], {}
        mark = BLANK.encode()
        for i, text in enumerate(texts):
            if self.map.units or self.tidy or mark in text:
                normal, places[i] = self.normalise(text.decode())
                parts.append(normal.replace(BLANK, " ").encode())
            else:
                parts.append(b" " + text if text else b"")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        data = b"".join(parts)
        raw = np.frombuffer(data, np.uint8)
        blank = raw == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        first = np.cumsum(lengths) - lengths
        begins[first[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data)).astype(np.int64)
        units = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        at = units.indices.to_numpy()
        known, counts, joined = self._units(units.dictionary.to_pylist())
        # Where the ids of each unit of the texts are among those of the distinct units.
        own = counts[at]
        total = np.append(0, np.cumsum(own))
        where = np.repeat((np.cumsum(counts) - counts)[at] - total[:-1], own) + np.arange(total[-1])
        ids = known[where]
        in_text = np.searchsorted(starts, np.append(first, len(data)))
        bounds = total[in_text]
        ends = np.cumsum(self.plain[ids])
        before = np.append(0, ends)[bounds[:-1]]
        ends -= np.repeat(before + 1, np.diff(bounds))
        for i, place in places.items():
            mine = slice(bounds[i], bounds[i + 1])
            ends[mine] = place[np.cumsum(self.sizes[ids[mine]])]
        names = pa.array(joined, pa.string()).take(units.indices)
        lists = pa.ListArray.from_arrays(pa.array(in_text.astype(np.int32)), names)
        return Encoded(ids, bounds, ends, pc.binary_join(lists, ",").to_pylist())

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def pieces(model: str | None = None) -> Pieces:
    """``model``: path of a model file; by default one of the public tokenizers."""
    import public_tokenizers

    return Pieces(model or public_tokenizers.path(MODEL))


_SCHEMA = ("doc_id long, n_tokens long, ids array<int>, ends array<int>, n_bytes long, ids_sha256 string, "
           "decoded_sha256 string")


def _slices(sizes: list[int]) -> Iterator[slice]:
    first = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def _encoder(model: str | None, columns: list[str]) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for part in _slices(sizes):
                yield _encoded(p, batch.slice(part.start, part.stop - part.start), columns)
        # Workers live on after a task; what it needed must not stay with them.
        p.forget()
        pa.default_memory_pool().release_unused()

    return encode


def _encoded(p: Pieces, batch: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    e = p.encode([t or b"" for t in binary(batch.column("text"))])
    sizes = np.diff(e.bounds)
    offsets = pa.array(e.bounds.astype(np.int32))
    out = {
        "doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes),
        "ids": pa.ListArray.from_arrays(offsets, pa.array(e.ids)),
        "ends": pa.ListArray.from_arrays(offsets, pa.array(e.ends.astype(np.int32))),
        "n_bytes": pa.array(np.where(sizes > 0, np.append(e.ends, 0)[e.bounds[1:] - 1], 0)),
    }
    if "ids_sha256" in columns:
        decoded = (p.decode(e.ids[a:b].tolist()) for a, b in zip(e.bounds, e.bounds[1:], strict=False))
        for name, strings in (("ids_sha256", e.joined), ("decoded_sha256", decoded)):
            out[name] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in strings])
    return pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)


def encode_texts(docs: DataFrame, model: str | None = None, digests: bool = False, ids: bool = True) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: ``doc_id``, ``n_tokens``, ``ids`` and ``ends`` (the byte of the original
    text at which each piece ends; it begins where the one before ends), ``n_bytes`` (the last end); with
    ``digests`` also the hex digests of the ids, joined by commas, and of the decoded text.

    Null or empty text: no ids, the digests of nothing. Null ids and repeated rows are passed on. Very long texts are
    encoded whole. An empty table gives no rows. Ties cannot arise. Other columns are not used.
    """
    wanted = ["doc_id", "n_tokens", *(["ids", "ends"] if ids else []), "n_bytes"]
    wanted += ["ids_sha256", "decoded_sha256"] if digests else []
    kinds = dict(f.split() for f in _SCHEMA.split(", "))
    rows = docs.select(field("doc_id").cast("long").alias("doc_id"), field("text").cast("string").alias("text"))
    return in_arrow(rows, _encoder(model, wanted), ", ".join(f"{c} {kinds[c]}" for c in wanted))
