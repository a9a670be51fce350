"""Byte-level BPE as deterministic transducers.

Two machines run one after the other over a buffer of texts:

1. The splitter, a DFA with eight states over nine symbols (character classes with the look-ahead that the
   split pattern needs folded in). The buffer is cut into chunks of equal length; every chunk computes its state
   map (end state for each start state) in lockstep with all others, and the maps compose by a parallel prefix
   scan. For counts the maps carry, beside the end state, the tokens of the pieces that start in the chunk, and
   both compose together (`counts_of`); for ids a second pass from the known start states marks where pieces begin.
2. The piece transducer, over strides of up to eight bytes. A transition that does not end a piece leads to a
   state and emits nothing; a transition that ends one emits the piece's tokens and returns to the start. Its
   transitions are compiled on first use from the vocabulary (each with the tokens that the library's own model
   gives its piece) and kept in an open-addressing table. The table is emptied when `capacity` is reached, and
   within one buffer it stops growing at three quarters of its slots: pieces that find no room are encoded one by
   one. So memory is bounded by the table and the buffer, and every probe ends.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import tiktoken
from tokenizers import Tokenizer

L, N, O, A1, A2, SPACE_THEN, WS_THEN, WS, END = range(9)
FRESH, IN_L, IN_N, IN_O, IN_WS, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
SPACE_CLASS, WS_CLASS = SPACE_THEN, WS
STARTS = 16
CHUNK = 64
LONGEST = 256
#: Bytes of text that are worked through at once.
WINDOW = 1 << 20
#: Places where a piece starts whatever stands before: white space, then a visible character.
SAFE = re.compile(rb"[ \t\n\r](?=[!-~\xe4-\xe9])")


def _transition(state: int, symbol: int) -> int:
    run = {L: IN_L, N: IN_N, O: IN_O}
    if symbol == L and state in (ONE_MORE, TWO_MORE):
        return {ONE_MORE: FRESH, TWO_MORE: ONE_MORE}[state]
    if symbol in run:
        return run[symbol] | (0 if state in (run[symbol], AFTER_SPACE) else STARTS)
    if symbol in (A1, A2):
        return IN_O if state in (IN_O, AFTER_SPACE) else STARTS | (ONE_MORE if symbol == A1 else TWO_MORE)
    if symbol == WS:
        return IN_WS | (0 if state == IN_WS else STARTS)
    return STARTS | {SPACE_THEN: AFTER_SPACE, WS_THEN: FRESH, END: FRESH}[symbol]


STEP = np.array([[_transition(q, s) for s in range(9)] for q in range(8)], np.uint8).ravel()
NEXT = STEP & 7


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunk_maps(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk the state after it by the state before it, and for each symbol a bit for every state before
    its chunk under which a piece starts there. All chunks run in lockstep, all eight states at once."""
    n = len(symbols)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    begun = np.empty_like(grid)
    for row, out in zip(grid, begun, strict=True):
        maps *= 9
        maps += row[:, None]
        both = STEP[maps]
        out[:] = np.packbits(both >= STARTS, axis=1, bitorder="little")[:, 0]
        maps = both & np.uint8(7)
    return maps, begun.T.ravel()[:n]


@dataclass
class Buffer:
    """Some texts, each followed by an end."""

    joined: bytes
    at: np.ndarray  # place of each symbol among the bytes (and the end)
    symbols: np.ndarray
    closing: np.ndarray  # symbols that stand for an end or a special token
    marks: dict[int, int]  # special tokens: piece by first symbol
    first: np.ndarray  # the first symbol of each text (and the end)


class BpeTransducer:
    def __init__(self, path: str, capacity: int = 1 << 20):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        library = Tokenizer.from_file(path)
        self.model, self.split = library.model, library.pre_tokenizer.pre_tokenize_str
        of = byte_alphabet()
        self.printable = {b: c for c, b in of.items()}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.by_rank = None  # a faster encoder, where ids rise in the order of the merges
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)) and all(bytes([b]) in ranks for b in range(256)):
            self.by_rank = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.classes = np.full(0x110000, 255, np.uint8)
        self.slots = 1 << (2 * capacity - 1).bit_length()
        self.capacity = capacity
        self._clear()

    def encode_piece(self, piece: bytes) -> list[int]:
        if self.by_rank is not None:
            return self.by_rank.encode_ordinary(piece.decode())
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.printable))]

    def _clear(self) -> None:
        self.k1, self.k2, self.to = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.used, self.states = 0, 1
        self.counts, self.offsets, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)
        self.pieces, self.held = 0, 0
        for i in [-1, *self.special.values()]:  # piece 0 is empty, then one for each special token
            self._emit([] if i < 0 else [i])

    def _emit(self, ids: list[int]) -> int:
        """A new piece that emits these tokens."""
        p, n = self.pieces, len(ids)
        if p == len(self.counts):
            self.counts, self.offsets = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while self.held + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.counts[p], self.offsets[p] = n, self.held
        self.flat[self.held : self.held + n] = ids
        self.pieces, self.held = p + 1, self.held + n
        return p

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        """Character classes; those not met before are read off the tokenizer's own splitter."""
        out = self.classes[points]
        if (out == 255).any():
            joined = lambda s: len(self.split(s)) == 1
            for c in np.unique(points[out == 255]).tolist():
                x = chr(c)
                self.classes[c] = SPACE_CLASS if c == 32 else L if joined("a" + x) else N if joined("1" + x) else O if joined("!" + x) else WS_CLASS
            out = self.classes[points]
        return out

    def _symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sym = self._class_of(points)
        sym[ends] = END
        after = np.append(sym[1:], np.uint8(END))
        dark = (after != SPACE_CLASS) & (after != WS_CLASS) & (after != END)
        white, space = sym == WS_CLASS, sym == SPACE_CLASS
        quotes = np.flatnonzero((points == 39) & (sym == O))
        sym[white & dark] = WS_THEN
        sym[space & ~dark] = WS
        if len(quotes):
            text = np.append(points, [0, 0])
            text[ends] = 0
            one, two = text[quotes + 1], text[quotes + 2]
            sym[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = A1
            long = np.zeros(len(quotes), bool)
            for x, y in ("re", "ve", "ll"):
                long |= (one == ord(x)) & (two == ord(y))
            sym[quotes[long]] = A2
        return sym

    @staticmethod
    def starts(sym: np.ndarray) -> np.ndarray:
        """Where pieces start: chunk state maps, their prefix scan, then one pass from the known states."""
        n = len(sym)
        lanes = -(-n // CHUNK)
        grid = np.full(lanes * CHUNK, END, np.uint8)
        grid[:n] = sym
        grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
        maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
        for row in grid:
            maps *= 9
            maps += row[:, None]
            maps = NEXT[maps]
        d = 1
        while d < lanes:  # after each round maps[i] covers the 2d chunks that end with i
            maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)
            d *= 2
        state = np.concatenate([[np.uint8(FRESH)], maps[:-1, FRESH]])
        out = np.empty_like(grid)
        for row, to in zip(grid, out, strict=True):
            both = STEP[state * np.uint8(9) + row]
            np.right_shift(both, 4, out=to)
            state = both & np.uint8(7)
        return np.flatnonzero(out.T.ravel()[:n])

    def _home(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        h = k1 * np.uint64(0x9E3779B97F4A7C15) ^ (k2 + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def _find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Targets of transitions; -1 where there is none yet."""
        at = self._home(k1, k2)
        hit = (self.k1[at] == k1) & (self.k2[at] == k2)
        out = np.where(hit, self.to[at], -1)
        left = np.flatnonzero(~hit & (self.k2[at] != 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.slots - 1)
            a = at[left]
            hit = (self.k1[a] == k1[left]) & (self.k2[a] == k2[left])
            out[left[hit]] = self.to[a[hit]]
            left = left[~hit & (self.k2[a] != 0)]
        return out

    def _add(self, k1: np.ndarray, k2: np.ndarray, to: np.ndarray) -> None:
        """New transitions, all different and none of them known."""
        at, left = self._home(k1, k2), np.arange(len(k1))
        while len(left):
            free = left[self.k2[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.k1[at[own]], self.k2[at[own]], self.to[at[own]] = k1[own], k2[own], to[own]
            left = np.setdiff1d(left, own, assume_unique=True)
            at[left] = np.where(self.k2[at[left]] != 0, (at[left] + 1) & (self.slots - 1), at[left])
        self.used += len(k1)

    def _pieces_of(self, buffer: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Run the piece transducer over pieces of the buffer (which ends with eight spare bytes)."""
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        out = np.zeros(len(begin), np.int32)
        state = np.zeros(len(begin), np.uint64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        done = 0
        while len(live):
            left = size[live] - done
            n = np.minimum(left, 8)
            last = left <= 8
            k1 = words[begin[live] + done] & mask[n]
            k2 = state[live] << np.uint64(5) | (n << 1 | last).astype(np.uint64)
            to = self._find(k1, k2)
            if len(new := np.flatnonzero(to < 0)):
                keys = np.empty(len(new), [("a", np.uint64), ("b", np.uint64)])
                keys["a"], keys["b"] = k1[new], k2[new]
                own, first, back = np.unique(keys, return_index=True, return_inverse=True)
                if self.used + len(own) > self.slots * 3 // 4:  # no room left in this buffer
                    for j in live[new].tolist():
                        out[j] = self._emit(self.encode_piece(buffer[begin[j] : begin[j] + size[j]]))
                    kept = to >= 0
                    live, to, last = live[kept], to[kept], last[kept]
                    new = new[:0]
            if len(new):
                target = np.empty(len(own), np.int32)
                for i, j in enumerate(live[new[first]].tolist()):
                    if own["b"][i] & np.uint64(1):
                        target[i] = self._emit(self.encode_piece(buffer[begin[j] : begin[j] + size[j]]))
                    else:
                        target[i], self.states = self.states, self.states + 1
                self._add(own["a"].copy(), own["b"].copy(), target)
                to[new] = target[back.ravel()]
            out[live[last]] = to[last]
            state[live] = to.astype(np.uint64)
            live, done = live[~last], done + 8
        for j in np.flatnonzero(size > LONGEST).tolist():
            out[j] = self._emit(self.encode_piece(buffer[begin[j] : begin[j] + size[j]]))
        return out

    def _read(self, texts: list[bytes]) -> Buffer:
        if self.used > self.capacity or self.held > 8 * self.capacity:
            self._clear()
        joined = b"\n".join([*texts, b""])
        text = joined.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = np.ones(len(points), np.int64) if len(points) == len(joined) else (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        at = np.cumsum(width)
        at -= width
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1  # the byte that separates
        last = np.searchsorted(at, stop)
        marks: dict[int, int] = {}
        ends = [last]
        for k, s in enumerate(self.special):
            i = text.find(s)
            while i >= 0:
                marks[i] = k + 1
                ends.append(np.arange(i, i + len(s)))
                i = text.find(s, i + len(s))
        ends = np.concatenate(ends)
        closing = np.zeros(len(points), bool)
        closing[ends] = True
        return Buffer(joined, np.append(at, len(joined)), self._symbols(points, ends), closing, marks, np.concatenate([[0], last + 1]))

    def _pieces_at(self, b: Buffer, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The pieces that lie between these symbols (begin rising)."""
        size = b.at[end] - b.at[begin]
        size[b.closing[begin]] = 0
        out = self._pieces_of(b.joined + bytes(8), b.at[begin], size)
        for i, k in b.marks.items():
            out[np.searchsorted(begin, i)] = k
        return out

    def windows(self, texts: list[bytes], most: int = WINDOW) -> Iterator[tuple[list[bytes], list[int]]]:
        """Runs of parts of texts with about `most` bytes, and the text that each part is of.

        Long texts are cut where a piece starts in any case, so parts have the tokens of the whole.
        """
        held, owner, n = [], [], 0
        whole = any(re.search(r"\s", s) for s in self.special)
        for i, t in enumerate(texts):
            begin = 0
            while begin is not None:
                place = SAFE.search(t, begin + most) if not whole and len(t) - begin > most else None
                stop = place.start() if place else len(t)
                if held and n + stop - begin > most:
                    yield held, owner
                    held, owner, n = [], [], 0
                held.append(t[begin:stop])
                owner.append(i)
                n += stop - begin
                begin = stop if place else None
        if held:
            yield held, owner

    def tokens_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all texts; of each piece the number of tokens and the last byte (0 at the end of a text or
        part); and the index of each text's first piece (and the end).

        Texts are UTF-8. Strings of special tokens inside a text are special tokens, as in the library.
        """
        ids, counts, final, of = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
        for parts, owner in self.windows(texts):
            b = self._read(parts)
            starts = self.starts(b.symbols)
            stops = np.append(starts[1:], len(b.symbols))
            pieces = self._pieces_at(b, starts, stops)
            ids.append(self.ids_of(pieces))
            counts.append(self.counts[pieces].astype(np.int64))
            final.append(np.frombuffer(b.joined, np.uint8)[b.at[stops] - 1] * ~b.closing[starts])
            of.append(np.array(owner)[np.searchsorted(b.first, starts, "right") - 1])
        return *(np.concatenate(x) for x in (ids, counts, final)), np.searchsorted(np.concatenate(of), np.arange(len(texts) + 1))

    def counts_of(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for parts, owner in self.windows(texts):
            np.add.at(out, owner, self._counts(parts))
        return out

    def _counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text of a window, by composing count-annotated chunk maps.

        What follows the start of a piece depends on its first symbol only. So a piece has one extent and one
        emission whatever the state its chunk began in, and a chunk is a map from each start state to the state at
        its end and the tokens of the pieces that start inside it. These maps compose by a prefix scan.
        """
        b = self._read(texts)
        n = len(b.symbols)
        maps, begun = chunk_maps(b.symbols)  # lanes x 8; bit s: a piece starts here if the chunk began in state s
        lanes = len(maps)
        somewhere = np.flatnonzero(begun)
        bits = begun[somewhere]
        lane = somewhere // CHUNK
        end = np.zeros(len(somewhere), np.int64)
        own = [np.flatnonzero(bits >> s & 1) for s in range(8)]
        first = np.full((lanes + 1, 8), -1, np.int64)  # the first start in a chunk, by start state
        first[lanes] = n
        for s, mine in enumerate(own):
            head = np.flatnonzero(np.diff(lane[mine], prepend=-1))
            first[lane[mine[head]], s] = somewhere[mine[head]]
        for s, mine in enumerate(own):
            end[mine[:-1]] = somewhere[mine[1:]]
            tail = mine[np.flatnonzero(np.diff(lane[mine], append=lanes))]
            at, state = lane[tail] + 1, maps[lane[tail], s]
            while len(open_ := np.flatnonzero(first[at, state] < 0)):  # no piece starts in the chunk that follows
                state[open_] = maps[at[open_], state[open_]]
                at[open_] += 1
            end[tail] = first[at, state]
        pieces = self._pieces_at(b, somewhere, end)  # may move the counts
        tokens = self.counts[pieces].astype(np.int64)
        emitted = np.stack([np.bincount(lane[mine], tokens[mine], lanes) for mine in own], 1).astype(np.int64)
        d = 1
        while d < lanes:  # after each round a map covers the 2d chunks that end with its own
            left = maps[:-d].astype(np.intp)
            emitted[d:] = emitted[:-d] + np.take_along_axis(emitted[d:], left, 1)
            maps[d:] = np.take_along_axis(maps[d:], left, 1)
            d *= 2
        state = np.concatenate([[FRESH], maps[:-1, FRESH]])
        before = np.concatenate([[0], emitted[:-1, FRESH]])
        real = np.flatnonzero(bits >> state[lane] & 1)
        inside = np.concatenate([[0], np.cumsum(tokens[real])])
        place = np.searchsorted(somewhere[real], b.first[:-1])  # the first piece of each text
        chunk = b.first[:-1] // CHUNK
        total = before[chunk] + inside[place] - inside[np.searchsorted(lane[real], chunk)]
        return np.diff(np.append(total, emitted[-1, FRESH]))

    def ids_of(self, pieces: np.ndarray) -> np.ndarray:
        """The tokens that these pieces emit, in order."""
        n = self.counts[pieces]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.offsets[pieces] - (ends - n), n)]


_machines: dict[str, BpeTransducer] = {}


def machine(path: str) -> BpeTransducer:
    """The worker's transducer for a vocabulary; tasks that follow in the same worker find it warm."""
    if path not in _machines:
        _machines[path] = BpeTransducer(path)
    return _machines[path]
