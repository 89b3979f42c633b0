"""SentencePiece encoding and decoding with spans of the original bytes."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ROW, packed, unpacked
from .tokens import vocabulary_path

SPACE = "▁"
#: Distinct words a Python worker remembers; beyond that the memory starts anew, which changes no result.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 40
#: Words up to this length are merged by scanning their pairs, longer ones by a heap.
SCANNED = 200
#: Documents whose new words are merged together.
TOGETHER = 256
# The piece types of the model file.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            size = varint() if size is None else size
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled map: the size of a double-array trie, its units, and the replacements it points to, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.replacements = blob[4 + size :]
        self.known: dict[bytes, tuple[bytes, int] | None] = {}

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest prefix of data[at:] in the map, and that prefix's length."""
        if not self.units:
            return None
        best, units = None, self.units
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = units[node] & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        return self.replacements[best[0] : self.replacements.index(b"\0", best[0])], best[1]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class PairTable:
    """Which neighbouring symbols merge: an open hash table of pairs in arrays, with the merged symbol and its rank (low is early)."""

    BITS = 19
    NONE = np.int32(2**31 - 1)

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        while len(pairs) * 3 > 1 << self.BITS:
            self.BITS += 1
        self.keys = np.full(1 << self.BITS, -1, dtype="int64")
        self.ranks = np.full(1 << self.BITS, self.NONE, dtype="int32")
        self.merged = np.zeros(1 << self.BITS, dtype="int32")
        left = np.array([self._key(np.int64(a), np.int64(b)) for a, b in pairs], dtype="int64")
        for key, slot, (rank, symbol) in zip(left.tolist(), self._slots(left).tolist(), pairs.values()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, symbol

    @staticmethod
    def _key(a, b):
        return (a << 24) | b

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype("int64")

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (`NONE` without a merge) and merged symbols of pairs."""
        keys = self._key(a, b)
        slots = self._slots(keys)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.BITS) - 1)
            at = self.keys[slots[open_]]
            open_ = open_[(at != keys[open_]) & (at != -1)]
        return self.ranks[slots], self.merged[slots]


class PieceModel:
    """A BPE model file: pieces, merge scores, the normaliser's rules. Models with user-defined or unused pieces aren't supported."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        pieces = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in _fields(data):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.read_rules(rules)
        self.names = [p[1].decode() for p in pieces]
        types = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or {USER, UNUSED} & set(types) or trainer.get(24, 0):
            raise ValueError("only BPE models of normal, control and byte pieces are supported")
        self.ids = {name: i for i, (name, t) in enumerate(zip(self.names, types)) if t == NORMAL}
        self.scores = {self.names[i]: float(np.frombuffer(pieces[i].get(2, bytes(4)), dtype="<f4")[0]) for i in self.ids.values()}
        self.bytes = {int(name[3:5], 16): i for i, (name, t) in enumerate(zip(self.names, types)) if t == BYTE}
        self.unknown = types.index(UNK)
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        #: A unit may be merged by itself only if no piece has a space mark after another character.
        self.by_word = all(SPACE not in name.lstrip(SPACE) for name in self.ids)
        surface = {NORMAL: lambda n: n.replace(SPACE, " ").encode(), BYTE: lambda n: bytes([int(n[3:5], 16)]), CONTROL: lambda n: b"", UNK: lambda n: " ⁇ ".encode()}
        self.surfaces = [surface[t](name) for name, t in zip(self.names, types)]
        self.is_byte = np.array([t == BYTE for t in types])
        self.is_plain = [t != CONTROL for t in types]
        #: Bytes of the normalised text that a piece stands for; unknown characters are found otherwise.
        self.widths = np.array([len(n.encode()) if t == NORMAL else int(t == BYTE) for n, t in zip(self.names, types)])
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: A symbol is a piece's id, or, for a character that is no piece, the number of pieces and the code point.
        self.characters = np.arange(0x110000, dtype="int64") + len(self.names)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.characters[ord(name)] = i
        rank = {score: r for r, score in enumerate(sorted(set(self.scores.values()), reverse=True))}

        def symbol(text: str) -> int | None:
            return int(self.characters[ord(text)]) if len(text) == 1 else self.ids.get(text)

        splits = ((name, i, symbol(name[:at]), symbol(name[at:])) for name, i in self.ids.items() for at in range(1, len(name)))
        self.pairs = PairTable({(a, b): (rank[self.scores[name]], i) for name, i, a, b in splits if a is not None and b is not None})

    def read_rules(self, rules: dict) -> None:
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy_prefix, self.trims, self.escapes = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the original byte where its character starts.

        At every place the longest prefix in the character map is replaced; a character that has none stays.
        """
        data = text.encode()
        if not self.map.units and not self.trims and self.escapes:
            if not text:
                return "", np.zeros(1, dtype="int64")
            raw = np.frombuffer(data, dtype="uint8")
            widths = np.where(raw == 32, 3, 1)
            mark = 3 if self.dummy_prefix else 0
            starts = np.concatenate([np.zeros(mark, dtype="int64"), np.repeat(np.arange(len(raw)), widths), [len(raw)]])
            return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), starts
        out, starts, at = bytearray(), [], 0
        space = SPACE.encode() if self.escapes else b" "

        def step(at: int) -> tuple[bytes, int]:
            found = self.map.longest(data, at)
            if found:
                return found
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return data[at : at + size], size

        if self.trims:
            while at < len(data):
                new, size = step(at)
                if new != b" ":
                    break
                at += size
        if at == len(data):
            return "", np.zeros(1, dtype="int64")
        if self.dummy_prefix:
            out += space
            starts += [at] * len(space)
        after_space = self.trims
        while at < len(data):
            new, size = step(at)
            if self.trims and after_space:
                new = new.lstrip(b" ")
            if new:
                escaped = new.replace(b" ", space)
                out += escaped
                starts += [at] * len(escaped)
                after_space = new.endswith(b" ")
            at += size
            if not self.trims:
                after_space = False
        end = at
        if self.trims:
            while out.endswith(space):
                del out[-len(space) :]
                end = starts[len(out)]
                del starts[len(out) :]
        return out.decode(errors="replace"), np.array([*starts, end], dtype="int64")

    def merged(self, unit: str) -> list[str]:
        """The pieces that BPE leaves: the best-scored neighbours merge first, the leftmost of equals."""
        symbols, get, none = list(unit), self.scores.get, float("-inf")
        if len(symbols) <= SCANNED:
            pairs = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
            while pairs:
                best = max(pairs)
                if best == none:
                    break
                i = pairs.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = get(symbols[i - 1] + symbols[i], none)
                if i < len(pairs):
                    pairs[i] = get(symbols[i] + symbols[i + 1], none)
            return symbols
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                both = symbols[i] + symbols[j]
                score = get(both)
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, both))

        for i, j in zip(count(), after):
            offer(i, j)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] != j or not symbols[i] or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -2
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def unit_ids(self, unit: str) -> bytes:
        ids: list[int] = []
        for symbol in self.merged(unit):
            number = self.ids.get(symbol)
            if number is not None:
                ids.append(number)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            else:
                ids.append(self.unknown)
        return array("I", ids).tobytes()

    def learn(self, units) -> None:
        """Remembers the ids of units; those of one length are merged together, one merge per unit and round."""
        if len(self.memory) >= REMEMBERED:
            # Frequent words come back from the older half.
            self.older, self.memory = self.memory, {}
        by_length: dict[int, list[str]] = {}
        for unit in units:
            found = self.older.get(unit)
            if found is not None:
                self.memory[unit] = found
            elif len(unit) <= LONGEST_REMEMBERED:
                by_length.setdefault(len(unit), []).append(unit)
        for length, words in by_length.items():
            codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)
            symbols, alive = self.merged_together(self.characters[codes])
            sizes = alive.sum(axis=1)
            ends = (4 * np.cumsum(sizes)).tolist()
            data = symbols[alive].astype("<u4").tobytes()
            odd = (symbols >= len(self.names)).any(axis=1).tolist()
            start = 0
            for word, end, other in zip(words, ends, odd):
                self.memory[word] = self.unit_ids(word) if other else data[start:end]
                start = end

    def merged_together(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merged` for rows of symbols of one length: the symbols left, and which places hold them."""
        n, length = symbols.shape
        symbols = symbols.copy()
        alive = np.ones((n, length), dtype=bool)
        ranks = np.full((n, length), PairTable.NONE, dtype="int32")
        if length < 2:
            return symbols, alive
        following = np.tile(np.arange(1, length + 1), (n, 1))
        before = np.tile(np.arange(-1, length), (n, 1))
        ranks[:, :-1] = self.pairs.find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())[0].reshape(n, length - 1)
        rows = np.arange(n)
        while True:
            at = ranks[rows].argmin(axis=1)
            going = ranks[rows, at] != PairTable.NONE
            rows, at = rows[going], at[going]
            if not len(rows):
                return symbols, alive
            right = following[rows, at]
            symbols[rows, at] = self.pairs.find(symbols[rows, at], symbols[rows, right])[1]
            alive[rows, right] = False
            ranks[rows, right] = PairTable.NONE
            after = following[rows, right]
            following[rows, at] = after
            before[rows, after] = at
            self._rank(symbols, ranks, rows, at, after, after < length)
            earlier = before[rows, at]
            self._rank(symbols, ranks, rows, earlier, at, earlier >= 0)

    def _rank(self, symbols, ranks, rows, left, right, has) -> None:
        """Ranks of pairs at `left`; none where there is no neighbour."""
        if not has.all():
            lone = ~has & (left >= 0)
            ranks[rows[lone], left[lone]] = PairTable.NONE
            rows, left, right = rows[has], left[has], right[has]
        ranks[rows, left] = self.pairs.find(symbols[rows, left], symbols[rows, right])[0]

    def units(self, text: str) -> list[str]:
        """Parts of a normalised text that are merged by themselves: no piece reaches over the start of a word."""
        if not text or not self.by_word:
            return [text] if text else []
        if SPACE * 2 not in text and text[0] == SPACE and text[-1] != SPACE:
            return [SPACE + w for w in text[1:].split(SPACE)]
        return _UNITS.findall(text)

    def encode_normalised(self, text: str) -> np.ndarray:
        """Ids without begin and end."""
        known = self.memory.get
        return np.frombuffer(b"".join([known(u) or self.recall(u) for u in self.units(text)]), dtype="<u4")

    def recall(self, unit: str) -> bytes:
        found = self.older.get(unit) or self.unit_ids(unit)
        if len(unit) <= LONGEST_REMEMBERED:
            self.memory[unit] = found
        return found

    def encode_many(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`encode` for many texts, whose new words are learnt together."""
        for start in range(0, len(texts), TOGETHER):
            part = [t or "" for t in texts[start : start + TOGETHER]]
            norms = [self.normalise(t) for t in part]
            new = {u for norm, _ in norms for u in self.units(norm)}
            self.learn(new.difference(self.memory))
            for text, (norm, starts) in zip(part, norms):
                yield self.encode(text, norm, starts)

    def encode(self, text: str | None, norm: str | None = None, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids without begin and end, and the original byte where each piece starts, with the last one's end.

        A byte piece that doesn't end its character is empty and stands at the character's start; the last one has it whole.
        """
        if norm is None or starts is None:
            norm, starts = self.normalise(text or "")
        ids = self.encode_normalised(norm)
        widths = self.widths[ids]
        if not self.bytes and self.unknown in ids:
            widths = self.unknown_widths(norm, ids)
        edges = np.empty(len(ids) + 1, dtype="int64")
        edges[0] = starts[0]
        edges[1:] = starts[np.cumsum(widths)]
        if self.is_byte[ids].any():
            raw = np.frombuffer((text or "").encode() + b"\0", dtype="uint8")
            for _ in range(3):
                edges = edges - ((raw[edges] & 0xC0) == 0x80)
        return ids, edges

    def unknown_widths(self, norm: str, ids: np.ndarray) -> np.ndarray:
        widths, at, data = [], 0, norm.encode()
        for i in ids.tolist():
            size = self.widths[i] if i != self.unknown else (1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4)
            widths.append(size)
            at += size
        return np.array(widths)

    def decode(self, ids) -> str:
        """The text of ids: spaces for marks, without the first piece's mark; bytes that aren't UTF-8 are replacement characters."""
        surfaces = self.surfaces
        numbers = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        data = b"".join([surfaces[i] for i in numbers])
        if self.dummy_prefix and data[:1] == b" ":
            first = next(i for i in numbers if self.is_plain[i])
            if first != self.unknown and self.names[first].startswith(SPACE):
                data = data[1:]
        return data.decode(errors="replace")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per worker process."""
    return PieceModel(path)


ENCODED = "ids array<int>, begins array<long>, ends array<long>"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long"


def encode_documents(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", digest: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Adds `ids`, begin and end id included, and the span of original bytes of each (`begins`, `ends`; empty for the two).

    With `digest`, adds instead what pins them down: `n_tokens`, the SHA-256 of the ids as little-endian 32-bit numbers, that of the text
    that decoding them gives, and the number of original bytes the spans cover. A null text is empty: its ids are begin and end.
    Rows are independent, whole texts of any length are encoded; a carried column with the name of an output is replaced.
    """
    kind = DIGEST if digest else ENCODED
    names = [f.split()[0] for f in kind.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = piece_model(vocabulary_path(model))
        for texts in batches:
            out = []
            for ids, edges in known.encode_many(texts.tolist()):
                whole = np.concatenate([[known.begin], ids, [known.end]]).astype("<u4")
                if digest:
                    decoded = known.decode(whole).encode()
                    out.append((len(whole), hashlib.sha256(whole.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), int(edges[-1] - edges[0])))
                else:
                    ends = np.concatenate([edges[:1], edges[1:], edges[-1:]])
                    begins = np.concatenate([edges[:1], edges[:-1], edges[-1:]])
                    out.append((whole.astype("int32"), begins, ends))
            yield pd.DataFrame(out, columns=names)

    found = F.pandas_udf(run, kind)(F.col(f"`{text}`"))
    return unpacked(docs.select(packed(docs, carry), found.alias("__f")).select(ROW, "__f.*"), names)


def decode_documents(encoded: DataFrame, ids: str = "ids", model: str = "piece_bpe_32k.model", carry: list[str] | None = None) -> DataFrame:
    """Adds `text`, what the ids decode to; null for null ids."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = piece_model(vocabulary_path(model))
        for rows in batches:
            yield pd.Series([None if r is None else known.decode(np.asarray(r)) for r in rows], dtype=object)

    return unpacked(encoded.select(packed(encoded, carry), F.pandas_udf(run, "string")(F.col(f"`{ids}`")).alias("text")), ["text"])
