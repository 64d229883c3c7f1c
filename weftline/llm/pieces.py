"""Operator 2: SentencePiece encoding and decoding with spans of the original bytes."""

from __future__ import annotations

import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import batches
from weftline.llm.ragged import PairTable, merge

SPACE = "▁"
UNKNOWN = " ⁇ "
#: Units that a task remembers from step to step, slots that its table has at first, and new units that are merged together.
REMEMBER, SLOTS, TOGETHER = 200_000, 1 << 18, 1 << 18
#: Text bytes of a step, whose arrays take many times as much.
STEP_BYTES = 1 << 18
U = np.uint64
RANDOM = np.random.default_rng(2).integers(1, 1 << 63, 256, np.int64).astype(U)
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


class CharMap:
    """A compiled character map: a double-array trie over source prefixes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        self.units = np.empty(0, np.uint32)
        self.replacements = b""
        if blob:
            n = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4")
            self.replacements = blob[4 + n :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source prefix that starts at a byte."""
        units = self.units
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        found = None
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != raw[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = k + 1 - at, int(units[node]) & 0x7FFFFFFF
        if found is None:
            return None
        size, place = found
        return size, self.replacements[place : self.replacements.index(b"\0", place)]


class PieceModel:
    """A BPE model of the sentencepiece format: normaliser, encoder, decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        charmap, self.prefix, self.squeeze, self.escape, self.fallback, model_type, suffix = b"", True, True, True, False, 1, False
        for number, value in fields(raw):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append(p.get(1, b"").decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif number == 2:
                t = dict(fields(value))
                model_type, suffix, self.fallback = t.get(3, 1), bool(t.get(24, 0)), bool(t.get(35, 0))
            elif number == 3:
                n = dict(fields(value))
                charmap, self.prefix, self.squeeze, self.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        self.kinds = kinds
        if model_type != 2 or suffix or not self.escape or {USER, UNUSED} & set(kinds):
            raise ValueError(f"only BPE models without user-defined or unused pieces are read: {path}")
        self.map = CharMap(charmap)
        self.unk = kinds.index(UNK)
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"a piece crosses words: {path}")
        # best score first; every split of a piece into two pieces is a pair with that rank
        order = sorted(self.ids.values(), key=lambda i: (-scores[i], i))
        rank, level = np.zeros(len(self.pieces), np.int64), -1
        for k, i in enumerate(order):
            level += k == 0 or scores[i] != scores[order[k - 1]]
            rank[i] = level
        cuts = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, whole = (np.array(x, np.int64) for x in zip(*cuts, strict=True))
        self.base = len(self.pieces) + 0x110000
        self.piece_size = np.array([len(p) for p in self.pieces], np.int64)
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.odd = np.array([k != NORMAL for k in kinds])
        for b, i in self.bytes.items():  # an ASCII byte is a character by itself
            if b < 128:
                self.shown[i], self.odd[i] = chr(b), False
        self.table = PairTable(left, right, rank[whole], whole, self.base)
        # Marks that stand beside a letter or digit in some piece; between any other mark and a letter or digit, no piece crosses.
        letter = re.compile(r"[^\W_]")
        tied = {"_"}
        for p in self.ids:
            p = p.lstrip(SPACE)
            for a, b in zip(p, p[1:], strict=False):
                if bool(letter.match(a)) != bool(letter.match(b)):
                    tied.add(b if letter.match(a) else a)
        #: Kind of each byte of a text: 0 space, 1 letter or digit, 2 mark that no piece ties to these, 3 any other.
        self.kind = np.full(256, 3, np.uint8)
        for c in map(chr, range(128)):
            self.kind[ord(c)] = 0 if c == " " else 1 if letter.match(c) else 3 if c in tied else 2
        self.forget()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the byte of the original where it begins."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if not len(self.map.units) and not self.squeeze:  # each character stays itself
            byte = np.frombuffer(raw, np.uint8)
            start = np.flatnonzero((byte & 0xC0) != 0x80)
            out = text.replace(" ", SPACE)
            if self.prefix:
                return SPACE + out, np.concatenate([[0], start, [len(raw)]])
            return out, np.append(start, len(raw))
        chars: list[str] = []
        begin: list[int] = []
        at, spaced = 0, self.squeeze
        for size, new in self.prefixes(raw):
            for c in new:
                if self.squeeze and c == " " and spaced:
                    continue
                chars.append(c)
                begin.append(at)
                spaced = c == " "
            at += size
        end = at
        while self.squeeze and chars and chars[-1] == " ":
            chars.pop()
            end = begin.pop()
        if not chars:
            return "", np.zeros(1, np.int64)
        if self.prefix:
            chars.insert(0, SPACE)
            begin.insert(0, begin[0])
        return "".join(chars).replace(" ", SPACE), np.array([*begin, end])

    def prefixes(self, raw: bytes):
        """(source bytes, replacement) of each step of longest-prefix normalisation; a character without an entry stays itself."""
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if len(self.map.units) else None
            if hit:
                size, new = hit
                yield size, new.decode()
            else:
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                yield size, raw[at : at + size].decode()
            at += size

    def units(self, flat: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and hash of the units of normalised texts, whose spaces are still plain; texts: the byte where each begins.

        A unit begins with a text, with the first space of a run, or, in words
        of ASCII and Latin-1 letters and of marks that no piece ties to them,
        where letters and marks meet. No piece crosses the edge of a unit.
        """
        kind = self.kind[flat]
        lead = np.flatnonzero(flat[:-1] == 0xC3)
        lead = lead[(flat[lead + 1] != 0x97) & (flat[lead + 1] != 0xB7)]
        kind[lead] = 1
        kind[lead + 1] = 1
        word = np.zeros(len(flat), bool)
        word[1:] = (kind[1:] == 0) & (kind[:-1] != 0)
        word[texts] = True
        split = np.zeros(len(flat), bool)
        split[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0) & (kind[1:] != 0)
        starts = np.flatnonzero(word)
        whole = np.maximum.reduceat(kind, starts) == 3
        if whole.any():
            split &= ~np.repeat(whole, np.diff(np.append(starts, len(flat))))
        begin = np.flatnonzero(word | split)
        size = np.diff(np.append(begin, len(flat)))
        place = np.arange(len(flat)) - np.repeat(begin, size)
        power = np.cumprod(np.full(int(size.max()), U(0x9E3779B97F4A7C15), U))
        h = np.add.reduceat(RANDOM[flat] * power[place], begin)
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        h ^= h >> U(31)
        h[h == 0] = 1
        return begin, h

    def store(self, words: list[str]) -> np.ndarray:
        """Numbers of new units, whose pieces are kept; all are merged together."""
        get, over = self.ids.get, len(self.pieces)
        flat = np.array([get(c, over + ord(c)) for w in words for c in w], np.int64).astype(np.int32)
        symbols, left = merge(flat, np.array([len(w) for w in words]), self.table)
        spelled = symbols >= over  # characters without a piece
        symbols, which = symbols.astype(np.int64), np.repeat(np.arange(len(words)), left)
        size = np.where(spelled, 1, self.piece_size[np.where(spelled, 0, symbols)])
        first = np.cumsum(size) - size
        first -= first[np.cumsum(left) - left][which]
        if spelled.any():  # as many ids as the character has bytes, or one for the unknown piece
            spell = {s: [self.bytes[b] for b in chr(s - over).encode()] if self.fallback else [self.unk] for s in set(symbols[spelled].tolist())}
            new = [spell[s] if s >= over else (s,) for s in symbols.tolist()]
            times = np.array([len(n) for n in new])
            symbols = np.fromiter(chain.from_iterable(new), np.int64)
            first, size, which = (np.repeat(x, times) for x in (first, size, which))
            left = np.bincount(which, minlength=len(words))
        self.spelled.add([w.replace(SPACE, " ").encode() for w in words])
        number = len(self.count) + np.arange(len(words), dtype=np.int32)
        self.first = np.append(self.first, len(self.flat[0]) + np.cumsum(left) - left)
        self.count = np.append(self.count, left)
        self.size = np.append(self.size, [len(w) for w in words])
        self.flat = [np.concatenate([own, more.astype(np.int32)]) for own, more in zip(self.flat, (symbols, first, first + size), strict=True)]
        return number

    def forget(self) -> None:
        """Starts the table of known units anew: from the hash of a unit to its number, and what holds for it by number."""
        self.known = batches.Numbers(SLOTS)
        self.count, self.first, self.size = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = [np.zeros(0, np.int32) for _ in range(3)]
        self.spelled = batches.Spelling()

    def join(self, ids: list[int]) -> str:
        """Text of ids with spaces in place, before the first space goes."""
        out: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            kind = self.kinds[i] if i >= 0 else CONTROL
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(replaced(bytes(held)))
                held.clear()
            if kind == UNK:
                out.append(UNKNOWN)
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces joined to characters, and the space that encoding put first taken off."""
        text = self.join(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if (self.prefix or self.squeeze) and first is not None and self.kinds[first] == NORMAL and text.startswith(" ") else text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of all texts, one behind the other: ids, original byte where each piece begins and ends; the number of ids of each text; the decoded texts."""
        normal = [self.normalise(t or "") for t in texts]
        raw = [t.replace(SPACE, " ").encode() for t, _ in normal]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        edge = np.cumsum([0, *map(len, raw)])
        if not len(flat):
            none = np.zeros(0, np.int64)
            return none.astype(np.int32), none, none, np.zeros(len(texts), np.int64), [""] * len(texts)
        begin, h = self.units(flat, np.unique(edge[:-1][np.diff(edge) > 0]))
        if len(self.count) > REMEMBER:
            self.forget()
        number = self.known.find(h)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            new, at = np.unique(h[fresh], return_index=True)
            at = fresh[at]
            stop = np.append(begin, len(flat))[at + 1]
            held = flat.tobytes()
            for k in range(0, len(new), TOGETHER):
                edges = zip(begin[at[k : k + TOGETHER]].tolist(), stop[k : k + TOGETHER].tolist(), strict=True)
                self.known.add(new[k : k + TOGETHER], self.store([held[a:b].decode().replace(" ", SPACE) for a, b in edges]))
            number[fresh] = self.known.find(h[fresh])
        size = np.diff(np.append(begin, len(flat)))
        other = self.spelled.differ(number, flat, begin, size)
        if len(other):  # units with the hash of another one
            held = flat.tobytes()
            number[other] = self.store([held[a : a + n].decode().replace(" ", SPACE) for a, n in zip(begin[other].tolist(), size[other].tolist(), strict=True)])
        count = self.count[number]
        last = np.cumsum(count)
        row = np.arange(int(last[-1])) + np.repeat(self.first[number] - (last - count), count)
        ids, first, end = (x[row] for x in self.flat)
        unit_edge = np.searchsorted(begin, edge)
        total = np.concatenate([[0], last])[unit_edge]
        # place of each unit in the characters of all normalised texts; a text has one place more than characters
        size = self.size[number]
        before = np.cumsum(size) - size + np.repeat(np.arange(len(texts)), np.diff(unit_edge))
        shift = np.repeat(before, count)
        place = np.concatenate([p for _, p in normal])
        odd = np.concatenate([[0], np.cumsum(self.odd[ids])])[total]
        flat_ids, shown, decoded = ids.tolist(), self.shown, []
        for k, (a, b) in enumerate(zip(total.tolist(), total[1:].tolist(), strict=False)):
            if odd[k + 1] > odd[k]:
                decoded.append(self.decode(flat_ids[a:b]))
                continue
            text = "".join([shown[i] for i in flat_ids[a:b]])
            decoded.append(text[1:] if (self.prefix or self.squeeze) and text.startswith(" ") else text)
        return ids, place[first + shift], place[end + shift], np.diff(total), decoded


def replaced(raw: bytes) -> str:
    """UTF-8 text of bytes, with U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def load(path: str) -> PieceModel:
    return batches.only(("pieces", path), lambda: PieceModel(path))


def listed(flat: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat, kind))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, ids, begins, ends, decoded) of every row.

    ids are those of the sentencepiece library without begin or end ids;
    begins and ends give for each piece the bytes of the original text that it
    stands for (all pieces of a character that is spelled in bytes have the
    character's span, the first space that encoding adds an empty one);
    decoded is the text of ids. A null text counts as empty and has no pieces.
    Repeated rows each give a row, a null id stays null, other columns are not
    read. Without spans, begins and ends are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def make():
        model = load(path)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, begin, end, count, text = model.encode(part.column("text").to_pylist())
            own = [part.column("doc_id"), listed(ids, count, pa.int32()), pa.array(text, pa.string())]
            if not spans:
                return pa.RecordBatch.from_arrays(own, ["doc_id", "ids", "decoded"])
            return pa.RecordBatch.from_arrays([*own[:2], listed(begin, count, pa.int32()), listed(end, count, pa.int32()), own[2]], ["doc_id", "ids", "begins", "ends", "decoded"])

        return step

    more = "begins array<int>, ends array<int>, " if spans else ""
    return batches.map_steps(src, make, f"doc_id {kind}, ids array<int>, {more}decoded string", limit=STEP_BYTES).withColumnRenamed("doc_id", id_col)
