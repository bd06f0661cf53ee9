"""Operator 12: byte-level BPE by a finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges make of its bytes just if the same holds for each two neighbours: a merge over a
token's border would be made in the two tokens' own bytes as well, as no merge outside them has a say in their order.
So for each prefix of a piece one token alone can be its last, and where it starts the same holds again. Reading a
byte, the transducer goes on with every token that may still become part of the result: one thread for each place where
such a token starts, with the tokens before that place. The threads together are one state. States and their moves are
made when a text first needs them and kept, and a move writes the tokens that all its threads agree on.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held_by_worker
from .tokens import IdEncoder

ENDED = float("inf")
TEXT_AT_ONCE = 2_000_000
ENCODED = "doc_id bigint, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def borders(token: bytes, ranks: dict[bytes, int]) -> tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]]:
    """(first parts, last parts) of a token while the merges make it, each with the greatest rank merged until it changes.

    The merges are carried out one by one: of all neighbours that make a token those of the least rank, the leftmost first.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    firsts, lasts, most = [], [], [-1, -1]
    while len(parts) > 1:
        found = [ranks.get(a + b, ENDED) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(found)
        if least == ENDED:
            raise ValueError(f"the merges don't make the token {token!r}")
        at, last = found.index(least), len(parts) - 2
        most = [max(x, least) for x in most]
        if at == 0:
            firsts.append((parts[0], most[0]))
            most[0] = -1
        if at == last:
            lasts.append((parts[-1], most[1]))
            most[1] = -1
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [*firsts, (parts[0], ENDED)], [*lasts, (parts[-1], ENDED)]


#: (last written token or -1, threads); a thread is (place in the tree of tokens, tokens not yet written).
State = tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]


class Transducer:
    """The merges of a rank file, compiled when they are needed.

    The first thread of a state is the token that starts here, at the tree's root. Tables are bounded: a full one starts
    again.
    """

    most_moves, most_missed, most_pairs, most_pieces = 200_000, 200_000, 300_000, 250_000

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes((b,)) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        # The tree of tokens: by (node, byte) the next node, or -1 less the token if nothing goes on from there; and the token
        # that ends at a node, or -1.
        self.next: dict[int, int] = {}
        self.ends = [-1]
        for token in sorted(ranks, key=len, reverse=True):
            node = 0
            for b in token[:-1]:
                key = node << 8 | b
                if key not in self.next:
                    self.next[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.next[key]
            at = self.next.setdefault(node << 8 | token[-1], -1 - ranks[token])
            if at >= 0:
                self.ends[at] = ranks[token]
        self.start = (-1, ((0, ()),))
        self.clear()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[list, list]] = {}
        self.pieces: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def clear(self) -> None:
        """Forgets all states and the moves between them."""
        self.numbers, self.states, self.moves, self.missed = {self.start: 0}, [self.start], {}, set()

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when b follows a.

        Each makes its own parts in its own order, whichever is of less rank first, until the two parts at the border
        make a token themselves whose rank comes before what either would have to merge to change its part.
        """
        key = (a, b)
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) > self.most_pairs:
            self.pairs.clear()
        for token in key:
            if token not in self.parts:
                self.parts[token] = borders(self.token[token], self.ranks)
        lasts, firsts, i, j, rank = self.parts[a][1], self.parts[b][0], 0, 0, self.ranks.get
        while True:
            (left, until), (right, to) = lasts[i], firsts[j]
            r = rank(left + right)
            if r is not None and r < until and r <= to:
                out = False
                break
            if until == to == ENDED:
                out = True
                break
            if until <= to:
                i += 1
            else:
                j += 1
        self.pairs[key] = out
        return out

    def _run(self, held: State, data: Iterable[int]) -> tuple[State, list[int]]:
        """(state, tokens written) after a state has read bytes."""
        (written, threads), out = held, []
        step, ends, pairs = self.next.get, self.ends, self.pairs
        for byte in data:
            going, ended = [], []
            for node, tokens in threads:
                node = step(node << 8 | byte)
                if node is None:
                    continue
                if node < 0:
                    ended.append((-1 - node, tokens))
                else:
                    going.append((node, tokens))
                    if ends[node] >= 0:
                        ended.append((ends[node], tokens))
            # One of them is right; the longest is the likeliest.
            for token, tokens in reversed(ended):
                before = tokens[-1] if tokens else written
                if before < 0 or (pairs[before, token] if (before, token) in pairs else self.follows(before, token)):
                    whole = (*tokens, token)
                    break
            else:
                raise ValueError("the ranks are not those of merges: no token can be the last here")
            agreed = len(whole)
            for _, tokens in going:
                if len(tokens) < agreed:
                    agreed = len(tokens)
                while agreed and tokens[agreed - 1] != whole[agreed - 1]:
                    agreed -= 1
            if agreed:
                out += whole[:agreed]
                written = whole[agreed - 1]
                threads = [(0, whole[agreed:]), *[(node, tokens[agreed:]) for node, tokens in going]]
            else:
                threads = [(0, whole), *going]
        return (written, tuple(threads)), out

    def _move(self, state: int, byte: int) -> tuple[int, list[int]]:
        """The move from a numbered state by a byte: (next state's number, tokens written)."""
        new, out = self._run(self.states[state], (byte,))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        return number, out

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece.

        A move is kept when it is missed for the second time: rare pieces go through states that have no number and are
        forgotten, so the tables hold what comes again.
        """
        if len(self.moves) > self.most_moves or len(self.missed) > self.most_missed:
            self.clear()
        state, moves, missed, out = 0, self.moves, self.missed, []
        for at, byte in enumerate(data):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in missed or len(moves) > self.most_moves:
                    missed.add(key)
                    held, more = self._run(self.states[state], data[at:])
                    return [*out, *more, *held[1][0][1]]
                missed.remove(key)
                move = moves[key] = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return [*out, *self.states[state][1][0][1]]

    def ids_of(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers. Of pieces met lately the ids are kept."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > self.most_pieces:
                # What is met again while the next ones are gathered stays.
                self.earlier, self.pieces = self.pieces, {}
            ids = self.earlier.get(piece)
            if ids is None:
                ids = array("i", self.encode_piece(piece.encode())).tobytes()
            self.pieces[piece] = ids
        return ids


class TextEncoder(IdEncoder):
    """Whole texts by a transducer: each match of the pattern by itself. Text between matches has no ids, as in the library.

    As operator 5 does, a text is cut before white space that follows another character, and what a distinct stretch gives
    is kept. No match of a pattern may span such a place; with cut=False texts are matched whole.
    """

    most_kept = 450_000

    def __init__(self, machine: Transducer, pattern: str, cut: bool = True):
        import regex

        self.machine, self.match, self.cut, self.known, self.apart = machine, regex.compile(pattern), cut, {}, False

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.machine.ids_of, self.match.findall(text)))

    def _kept(self, pieces: list[str]) -> list[bytes]:
        return list(map(self._whole, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        return super().encode(texts) if self.cut else list(map(self._whole, texts))


#: The state machine of UTF-8: what may come next. 0 is between characters; 1, 2 and 3 wait for so many continuation
#: bytes; 4 to 7 are after E0, ED, F0 and F4, whose next byte is limited; 8 is an error, which nothing leaves.
WHOLE, ERROR = 0, 8


def _utf8_step(state: int, byte: int) -> int:
    if state == WHOLE:
        for first, last, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xE1, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
            if first <= byte <= last:
                return to
        return ERROR
    low, high, to = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, ERROR))
    return to if low <= byte <= high else ERROR


class Decoder:
    """Ids to text as they come: what is fed comes out up to the last whole character, the rest waits for more.

    Each token moves the state machine by all its bytes at once; most lead from a whole character to a whole one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {i: t for t, i in ranks.items()}
        self.table = [bytes(_utf8_step(s, b) for b in range(256)) for s in range(9)]
        self.over: dict[tuple[int, int], int] = {}
        # Tokens that lead from a whole character to a whole one.
        self.plain = np.zeros(max(self.token) + 1, bool)
        self.plain[[i for i, t in self.token.items() if self._run(WHOLE, t) == WHOLE]] = True

    def _run(self, state: int, data: bytes) -> int:
        for b in data:
            state = self.table[state][b]
        return state

    def step(self, state: int, token: int) -> int:
        key = (state, token)
        if key not in self.over:
            self.over[key] = self._run(state, self.token[token])
        return self.over[key]

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text for each chunk of ids. Bytes that are no UTF-8, or a character that never ends, fail."""
        state, held = WHOLE, b""
        for chunk in chunks:
            ids = chunk.tolist()
            try:
                data = held + b"".join(map(self.token.__getitem__, ids))
            except KeyError as unknown:
                raise ValueError(f"no token has the id {unknown}") from None
            if state != WHOLE or not self.plain[chunk].all():
                for token in ids:
                    if state != WHOLE or not self.plain[token]:
                        state = self.step(state, token)
            if state == ERROR:
                raise ValueError("ids of bytes that are not UTF-8")
            cut = len(data)
            if state != WHOLE:
                cut -= 1
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
            held = data[cut:]
            yield data[:cut].decode()
        if state != WHOLE:
            raise ValueError("the ids end inside a character")


def text_encoder(path: str, pattern: str) -> TextEncoder:
    return held_by_worker(("transducer", path, pattern), lambda: TextEncoder(Transducer(read_ranks(path)), pattern))


def _encoding(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        encoder = text_encoder(path, pattern)
        # The tables are very many tuples without cycles, which the collector would go through again and again.
        gc.disable()
        try:
            for batch in batches:
                yield from rows(batch, encoder)
        finally:
            gc.enable()

    def rows(batch: pa.RecordBatch, encoder: TextEncoder) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            texts.append(text.as_py() or "")
            doc_ids.append(doc_id)
            held += len(texts[-1])
            if held > TEXT_AT_ONCE:
                yield made(doc_ids, encoder.encode(texts))
                doc_ids, texts, held = [], [], 0
        if texts:
            yield made(doc_ids, encoder.encode(texts))

    def made(doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """ENCODED for each row of docs (doc_id, text; other columns are not read): the ids of its whole text.

    Each match of the pattern is encoded by itself, without special tokens. A null text counts as empty and has no ids;
    rows that repeat a doc_id or have none are rows of their own; an empty table gives none. Nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoding(ranks_path, pattern), ENCODED)


def _decoding(path: str, chunk: int = 1 << 16) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(read_ranks(path))  # small, so that it doesn't take the place of a worker's encoder
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                own = np.zeros(0, np.int32) if ids.values is None else ids.values.to_numpy(zero_copy_only=False)
                texts.append("".join(machine.stream(own[i : i + chunk] for i in range(0, len(own), chunk))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """ENCODED with `text`, decoded from the ids; null ids count as none. Ids that no token has, and bytes that are no
    UTF-8, fail."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(ranks_path), f"{ENCODED}, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """ENCODED with `text` decoded from the ids: encode() and decode() one after the other in one worker of a task."""
    encoding, decoding = _encoding(ranks_path, pattern), _decoding(ranks_path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: decoding(encoding(batches)), f"{ENCODED}, text string")
