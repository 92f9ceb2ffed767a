"""Byte-level BPE as two deterministic transducers.

Splitter
    A finite automaton over character classes cuts a text into pieces, as the pre-tokenizer's pattern does. Its transitions are annotated with the places, relative to the character just read, where a piece begins. The maps of its states onto states form a finite monoid under composition; the map of a chunk of text is one element, and elements compose by table look-up, so that the states at which chunks begin come from a parallel prefix scan.

Merger
    Within a piece, a transducer over bytes keeps in its state what later bytes can depend on: for each suffix that may still grow into a token, the last token before it and the number of tokens before it, relative to now. Each transition carries the change in the number of tokens. States and transitions are made when first met.

    A piece is cut into chunks of bytes. The map of a chunk, from the state at its beginning to the state at its end and the tokens emitted on the way, is taken for all chunks at once, at first from the states that the bytes just before them lead to. In rounds, each chunk whose predecessor ends in another state than it was taken from is taken again from that one; the maps then compose, and a prefix sum over the emitted counts gives those of pieces.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from canopy.llm.text import slices

# Character classes of the splitter. FILL pads chunks and changes no state; END follows each document.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, S_T_M_D, R, V, E, LOW_L, END, FILL = range(13)
CLASSES = 13
#: Bytes of a chunk of a piece, and bytes before a chunk from which its state is guessed.
CHUNK, LEAD = 64, 32


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = BLANK
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for c in "stmd":
        table[ord(c)] = S_T_M_D
    table[ord("r")], table[ord("v")], table[ord("e")], table[ord("l")] = R, V, E, LOW_L
    return table


class Splitter:
    """States: what the current piece is and, where that is open, how it may go on."""

    STATES = ("start", "letters", "numbers", "others", "space", "blank", "spaces", "blanks", "quote", "quote_r", "quote_v", "quote_l", "closed")

    def __init__(self) -> None:
        index = {s: i for i, s in enumerate(self.STATES)}
        n = len(self.STATES)
        self.next = np.zeros((n, CLASSES), np.uint8)
        #: Bit k: a piece begins k characters before the one just read.
        self.begins = np.zeros((n, CLASSES), np.uint8)
        for state in self.STATES:
            for c in range(CLASSES):
                to, bits = self._step(state, c)
                self.next[index[state], c], self.begins[index[state], c] = index[to], bits
        self._monoid()

    @staticmethod
    def _open(c: int) -> str:
        if c == NUMBER:
            return "numbers"
        if c == SPACE:
            return "space"
        if c == BLANK:
            return "blank"
        if c == QUOTE:
            return "quote"
        return "others" if c == OTHER else "letters"

    def _step(self, state: str, c: int) -> tuple[str, int]:
        if c == FILL:
            return state, 0
        if c == END:
            return "start", 0
        letter = c in (LETTER, S_T_M_D, R, V, E, LOW_L)
        kind = "letters" if letter else {NUMBER: "numbers", OTHER: "others", QUOTE: "others"}.get(c, "white")
        if state in ("letters", "numbers", "others"):
            return (state, 0) if kind == state else (self._open(c), 1)
        if state in ("start", "closed"):
            return self._open(c), 1
        if state in ("space", "blank", "spaces", "blanks"):
            if kind == "white":
                return ("spaces" if c == SPACE else "blanks"), 0
            # The last white character leaves a longer run; a space goes with what follows, another stands alone.
            left = 2 if state in ("spaces", "blanks") else 0
            if state in ("space", "spaces"):
                return kind, left
            return self._open(c), left | 1
        if state == "quote":
            if c == S_T_M_D:
                return "closed", 0
            if c in (R, V, LOW_L):
                return {R: "quote_r", V: "quote_v", LOW_L: "quote_l"}[c], 0
            return ("others", 0) if kind == "others" else (self._open(c), 1)
        # An apostrophe and a letter that may begin a contraction: is it one?
        if (state, c) in (("quote_r", E), ("quote_v", E), ("quote_l", LOW_L)):
            return "closed", 0
        # It isn't: the letter began a piece of its own.
        return ("letters", 2) if letter else (self._open(c), 3)

    def _monoid(self) -> None:
        """All maps that class sequences induce, and their composition with one class or with each other."""
        n = len(self.STATES)
        unit = tuple(range(n))
        ids, order, step = {unit: 0}, [unit], []
        for m in order:
            row = []
            for c in range(CLASSES):
                to = tuple(int(self.next[s, c]) for s in m)
                if to not in ids:
                    ids[to] = len(order)
                    order.append(to)
                row.append(ids[to])
            step.append(row)
        self.maps = np.array(order, np.uint8)
        self.extend = np.array(step, np.uint16)
        base = n ** np.arange(n, dtype=object)
        keys = {int((np.array(m, dtype=object) * base).sum()): i for m, i in ids.items()}
        self.compose = np.empty((len(order), len(order)), np.uint16)
        for i, m in enumerate(self.maps):
            after = self.maps[:, m]  # first m, then each of the others
            self.compose[i] = [keys[int((row.astype(object) * base).sum())] for row in after]

    def chunk_maps(self, chunks: np.ndarray) -> np.ndarray:
        """The map of each row of classes, as an element of the monoid."""
        m = np.zeros(len(chunks), np.uint16)
        for j in range(chunks.shape[1]):
            m = self.extend[m, chunks[:, j]]
        return m

    def scan(self, maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition in log2(n) rounds."""
        out, step = maps.copy(), 1
        while step < len(out):
            out[step:] = self.compose[out[:-step], out[step:]]
            step *= 2
        return out

    def pieces(self, codes: np.ndarray, first: np.ndarray, width: int = 256) -> np.ndarray:
        """Positions, in order, at which pieces begin in documents ``codes[first[d]:first[d + 1]]``; END stands between documents."""
        docs = len(first) - 1
        if not len(codes):
            return np.zeros(0, np.int64)
        stream = np.full(-(-(len(codes) + docs) // width) * width, FILL, np.uint8)
        place = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(docs), np.diff(first))
        stream[place] = classes()[codes]
        stream[first[1:] + np.arange(docs)] = END
        chunks = np.ascontiguousarray(stream.reshape(-1, width))
        ends = self.maps[self.scan(self.chunk_maps(chunks)), 0]
        state = np.concatenate(([0], ends[:-1])).astype(np.uint8)
        marks = np.zeros(len(stream) + 2, bool)
        bits = np.empty(chunks.shape, np.uint8)
        for j in range(width):
            c = chunks[:, j]
            bits[:, j] = self.begins[state, c]
            state = self.next[state, c]
        flat = bits.reshape(-1)
        marks[: len(stream)] |= (flat & 1) > 0
        marks[: len(stream) - 1] |= (flat[1:] & 2) > 0
        return np.flatnonzero(marks[place])


@lru_cache(maxsize=1)
def splitter() -> Splitter:
    return Splitter()


def vocabulary(spec: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Tokens as bytes with their ids, and added tokens, from the text of a byte-level BPE's JSON file."""
    model = json.loads(spec)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    decode = {chr(b): b for b in printable}
    decode |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    return {bytes(decode[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}, added


class Merger:
    """Counts the tokens of a piece. Ranks are ids, as in vocabularies whose ids follow the order of merges."""

    def __init__(self, tokens: dict[bytes, int], max_states: int = 250_000) -> None:
        self.tokens, self.max_states = tokens, max_states
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in tokens.items():
            at = 0
            for b in token:
                if b not in self.children[at]:
                    self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                at = self.children[at][b]
            self.token_at[at] = i
        self.bytes_of = {i: t for t, i in tokens.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; they are made again when met. Keeps memory bounded."""
        self.ids: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.column = np.full(256, -1, np.int16)  # bytes get columns of the tables when first met
        self.columns = 0
        self.next = np.full((1024, 64), -1, np.int32)
        self.delta = np.zeros((1024, 64), np.int8)
        self._pairs.clear()
        self._id(array("i", (0, -1, 0)).tobytes())

    def _id(self, key: bytes) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.states)
            self.states.append(key)
            if i == len(self.next):
                rows = len(self.next) // 2
                self.next = np.concatenate([self.next, np.full((rows, self.next.shape[1]), -1, np.int32)])
                self.delta = np.concatenate([self.delta, np.zeros((rows, self.delta.shape[1]), np.int8)])
        return i

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """Columns of bytes; new bytes get the next free ones."""
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            if self.columns == self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full((len(self.next), 32), -1, np.int32)], axis=1)
                self.delta = np.concatenate([self.delta, np.zeros((len(self.delta), 32), np.int8)], axis=1)
            self.column[b] = self.columns
            self.columns += 1
        return self.column[data]

    def merge(self, piece: bytes) -> list[int]:
        """The merges themselves, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.tokens.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.tokens[p] for p in parts]

    def _follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when merged from the bytes of both."""
        if left < 0:
            return True
        key = (left, right)
        if key not in self._pairs:
            self._pairs[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self._pairs[key]

    def _make(self, state: int, b: int) -> None:
        grown, last, count = [], None, 0
        entries = array("i")
        entries.frombytes(self.states[state])
        for k in range(0, len(entries), 3):
            node, before, n = entries[k : k + 3]
            to = self.children[node].get(b)
            if to is None:
                continue
            token = self.token_at[to]
            if last is None and token >= 0 and self._follows(before, token):
                last, count = token, n + 1
            if self.children[to]:
                grown.append((to, before, n))
        if last is None:
            raise ValueError(f"no token ends at byte {b}")
        key = array("i")
        for node, before, n in grown:
            key.extend((node, before, n - count))
        key.extend((0, last, 0))
        to = self._id(key.tobytes())
        self.next[state, self.column[b]], self.delta[state, self.column[b]] = to, count

    def _advance(self, data: np.ndarray, columns: np.ndarray, starts: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maps of slices from the states given: states at their ends, and tokens emitted. All slices take one transition a step, the longest first."""
        order = np.argsort(-size, kind="stable")
        at0, left, now = starts[order], size[order], state[order]
        total = np.zeros(len(size), np.int64)
        for j in range(int(left[0]) if len(left) else 0):
            alive = int(np.searchsorted(-left, -j, side="left"))
            s, at = now[:alive], at0[:alive] + j
            c = columns[at]
            to = self.next[s, c]
            if (to < 0).any():
                new = to < 0
                for key in np.unique(s[new] * 256 + data[at[new]]).tolist():
                    self._make(key >> 8, key & 255)
                to = self.next[s, c]
            total[:alive] += self.delta[s, c]
            now[:alive] = to
        end, emitted = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        end[order], emitted[order] = now, total
        return end, emitted

    def count(self, data: np.ndarray, offsets: np.ndarray, width: int = CHUNK, lead: int = LEAD) -> np.ndarray:
        """Tokens of each slice of ``data``, by chunks of at most ``width`` bytes."""
        if len(self.states) > self.max_states:
            self.reset()
        columns = self._columns(data)
        size = np.diff(offsets)
        n = -(-size // width)
        first = np.cumsum(n) - n
        piece = np.repeat(np.arange(len(size)), n)
        number = np.arange(len(piece)) - first[piece]
        starts = offsets[:-1][piece] + number * width
        length = np.minimum(width, offsets[1:][piece] - starts)
        state = np.zeros(len(piece), np.int64)
        later = np.flatnonzero(number > 0)
        if len(later):
            state[later] = self._advance(data, columns, starts[later] - lead, np.full(len(later), lead), state[later])[0]
        end, emitted = self._advance(data, columns, starts, length, state)
        while len(later):
            wrong = later[state[later] != end[later - 1]]
            if not len(wrong):
                break
            state[wrong] = end[wrong - 1]
            end[wrong], emitted[wrong] = self._advance(data, columns, starts[wrong], length[wrong], state[wrong])
        total = np.concatenate(([0], np.cumsum(emitted)))
        return total[first + n] - total[first]


def split_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of UTF-8 documents ``data[offsets[d]:offsets[d + 1]]``, dictionary-encoded, and the n + 1 positions of documents among them."""
    text = data.tobytes().decode("utf-8")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # byte at which each character begins
    first = np.searchsorted(heads, offsets)
    begins = splitter().pieces(codes, first)
    bounds = np.concatenate((heads[begins], [len(data)])).astype(np.int64)
    return slices(data, bounds).dictionary_encode(), np.searchsorted(bounds[:-1], offsets)
