"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Of a text read so far, the last token of the encoding of each prefix settles the whole encoding: it is the one token
that ends there and that the merges keep apart from the last token of the prefix before it. So a state needs, for each
place where a token that is still open could begin, the token that ends there and the place before it, back to where
all of these agree. What they agree on no later byte can change, and it is emitted: the lookahead is bounded by the
longest token. States and transitions are made when they are first met, and kept in a table.

Defined cases: null and empty texts have no token. Bytes that no merge reaches stay single-byte tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table, to_batch, utf8
from .pretokens import Remembering

#: States, and answers about pairs, after which their table starts anew.
TABLE_LIMIT = 250_000


class Vocabulary:
    """Ranks of byte strings; a string's rank is its id and the priority of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.open = {t[:k] for t in ranks for k in range(1, len(t))}
        self._apart: dict[tuple[bytes, bytes], bool] = {}

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)})

    def merge(self, raw: bytes) -> list[bytes]:
        """By definition: of all neighbours the pair of lowest rank is merged, the first of equals, until none is left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether the merges of left + right end with just these two tokens."""
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) >= TABLE_LIMIT:
                self._apart.clear()
            known = self._apart[left, right] = self.merge(left + right) == [left, right]
        return known


#: A state: the bytes since the last settled place, the places in them where an open token can begin (the last is
#: their end), the token that ends at each place on the way to these, and the token before the settled place where it matters.
State = tuple[bytes, tuple[int, ...], tuple[tuple[int, bytes], ...], bytes]
START: State = (b"", (0,), (), b"")


class Transducer:
    """Reads bytes, emits tokens. The deterministic states are made as texts need them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[State, int] = {START: 0}
        self.states: list[State] = [START]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def make(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The transition that the merges define: the next state, and the tokens settled by it."""
        v = self.vocabulary
        pending, places, ends, before = state
        pending += bytes((byte,))
        last = dict(ends)
        for at in places:
            token = pending[at:]
            if token in v.ranks:
                left = last[at] if at else before
                if not left or v.apart(left, token):
                    break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        last[len(pending)] = token
        places = [at for at in places if pending[at:] in v.open]
        places.append(len(pending))
        # where the ways back from all open places meet, all is settled
        ways, kept = set(places), []
        while len(ways) > 1:
            far = max(ways)
            ways.remove(far)
            kept.append(far)
            ways.add(far - len(last[far]))
        settled = at = ways.pop()
        out = []
        while at:
            out.append(v.ranks[last[at]])
            at -= len(last[at])
        if settled not in places:
            before = b""
        elif settled:
            before = last[settled]
        to = (pending[settled:], tuple(at - settled for at in places), tuple((at - settled, last[at]) for at in sorted(kept)), before)
        return to, tuple(reversed(out))

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        to, out = self.make(self.states[state], byte)
        number = self.numbers.get(to)
        if number is None:
            number = self.numbers[to] = len(self.states)
            self.states.append(to)
        self.moves[state << 8 | byte] = number, out
        return number, out

    def finish(self, state: int) -> tuple[int, ...]:
        """The tokens still open when the text ends."""
        pending, _, ends, _ = self.states[state]
        last, out, at = dict(ends), [], len(pending)
        while at:
            out.append(self.vocabulary.ranks[last[at]])
            at -= len(last[at])
        return tuple(reversed(out))

    def encode(self, raw: bytes) -> tuple[int, ...]:
        if len(self.states) >= TABLE_LIMIT:
            self.clear()
        state, out, moves = 0, [], self.moves
        for byte in raw:
            found = moves.get(state << 8 | byte) or self.move(state, byte)
            state = found[0]
            if found[1]:
                out.extend(found[1])
        out.extend(self.finish(state))
        return tuple(out)


def encoder(vocabulary: Vocabulary) -> Remembering:
    """Encodes documents: each match of the pattern goes through the transducer by itself, and is then remembered."""
    transducer = Transducer(vocabulary)

    def new(matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(transducer.encode, matches))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((i for own in ids for i in own), np.int32, int(sizes.sum()))

    return Remembering(new)


class Utf8Stream:
    """Incremental decoding of UTF-8: bytes of a character that is not complete wait for the next chunk. Wrong bytes
    become U+FFFD, by maximal subparts, as the Unicode standard recommends."""

    #: For a first byte: how many more follow, and the range of the second.
    FIRST = {
        **{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)},
        **{b: (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)},
        **{b: (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)},
    }

    def __init__(self) -> None:
        self.held = b""

    def _open(self, raw: bytes) -> int:
        """How many bytes at the end of raw begin a character that more bytes could complete."""
        for size in range(1, min(3, len(raw)) + 1):
            first = raw[-size]
            if first in self.FIRST:
                more, low, high = self.FIRST[first]
                second_fits = size == 1 or low <= raw[-size + 1] <= high
                return size if size <= more and second_fits else 0
            if not 0x80 <= first <= 0xBF:
                return 0
        return 0

    def feed(self, chunk: bytes) -> str:
        raw = self.held + chunk
        keep = self._open(raw)
        self.held = raw[len(raw) - keep :]
        return raw[: len(raw) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """Text as it becomes certain, token by token."""
    stream = Utf8Stream()
    for i in ids:
        if out := stream.feed(vocabulary.tokens[i]):
            yield out
    if out := stream.close():
        yield out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array<int> for each row of docs."""

    def run(batches):
        encode = encoder(Vocabulary.load(path)).encode
        for piece in pieces(batches, limit=2 << 20):
            ids, at = encode(*utf8(piece.column("text")))
            yield to_batch({"doc_id": piece.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes each text and decodes its ids: doc_id, n_tokens, and SHA-256 of the ids, of the decoded bytes and of the
    text that streaming decoding gives."""

    def run(batches):
        vocabulary = Vocabulary.load(path)
        encode = encoder(vocabulary).encode
        size = 1 + max(vocabulary.tokens)
        raw = [vocabulary.tokens.get(i, b"") for i in range(size)]
        names = list(map(str, range(size)))
        for piece in pieces(batches, limit=2 << 20):
            all_ids, at = encode(*utf8(piece.column("text")))
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = all_ids[a:b].tolist()
                decoded, stream, streamed = hashlib.sha256(), Utf8Stream(), hashlib.sha256()
                for k in range(0, len(ids), 4096):
                    chunk = b"".join(map(raw.__getitem__, ids[k : k + 4096]))
                    decoded.update(chunk)
                    streamed.update(stream.feed(chunk).encode())
                streamed.update(stream.close().encode())
                rows.append((len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), decoded.hexdigest(), streamed.hexdigest()))
            yield to_batch({"doc_id": piece.column("doc_id"), **dict(zip(("n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"), map(list, zip(*rows, strict=True)), strict=True))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
