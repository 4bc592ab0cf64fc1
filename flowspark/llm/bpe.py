"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds all tokens of a piece in one pass.  The
encoder tries the longest token at each place and goes back to shorter ones when it does not fit the token
before it.  Two tokens fit if the merges would leave them apart; that is decided from the pairs the tokens were
merged from and remembered for each pair of tokens.  A place that led nowhere is never entered again.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowspark.llm.base import batch, prepare, query, slices, table, texts_of

CHUNK = 4_000_000
PIECES = 200_000  # encoded pieces, and compatible pairs, that a task remembers before it starts anew


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[k] for k in range(len(ranks))]


class Encoder:
    """Encodes pieces as the merges by rank would; built once a task from the list of tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.finder = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            self.finder.add_word(t.decode("latin-1"), (len(t), k))
        self.finder.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens that a token is merged from; a single byte gives itself twice."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                ranked = [self.rank.get(parts[k] + parts[k + 1], token) for k in range(len(parts) - 1)]
                best = min(ranked)
                if best == token:
                    raise ValueError(f"Token {token} cannot be built by merges of smaller ranks.")
                k = ranked.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[-1]])
        return self.halves[token]

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        if token not in self.shorter:
            text = self.tokens[token]
            self.shorter[token] = next((self.rank[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.rank), -1)
        return self.shorter[token]

    def _fit(self, left: int, right: int) -> bool:
        """Would the merges leave these two tokens next to each other?

        Walks down the facing edges of both tokens, the one merged later first: at each step the two parts
        that face each other must not merge before the step that hides one of them.
        """
        if (left, right) in self.fits:
            return self.fits[left, right]
        if len(self.fits) >= PIECES:
            self.fits.clear()
        a, b, before, answer = left, right, len(self.tokens) + 1, None
        while answer is None:
            joined = self.rank.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < before:
                answer = False
            elif a > b:
                inner = self._split(a)[1]
                if inner != a:
                    before, a = a, inner
                else:
                    inner = self._split(b)[0]
                    answer, before, b = (True if inner == b else None), b + 1, inner
            else:
                inner = self._split(b)[0]
                if inner != b:
                    before, b = b + 1, inner
                else:
                    inner = self._split(a)[1]
                    answer, before, a = (True if inner == a else None), a, inner
        self.fits[left, right] = answer
        return answer

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.rank:
            return [self.rank[piece]]
        longest = [0] * len(piece)
        for end, (size, token) in self.finder.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = token  # later ends overwrite earlier ones
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + len(self.tokens[token])
            if not dead[end] and (not out or self._fit(out[-1], token)):
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
                continue
            token = self._prefix(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                token = self._prefix(token)


class _Packed(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        packed = np.array(self.encoder.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


_encoders: dict[str, Encoder] = {}


def _encode(shared, name: str, pattern: str, with_ids: bool):
    def run(batches):
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(shared.value)
        encoder = _encoders[name]
        pieces = regex.compile(pattern)
        packed = _Packed(encoder)
        for b in slices(batches, "text", CHUNK):
            count, ids_sum, text_sum, ids = [], [], [], []
            for text in texts_of(b.column(1)):
                raw = b"".join(map(packed.__getitem__, pieces.findall(text)))
                numbers = np.frombuffer(raw, "<u4")
                count.append(len(numbers))
                ids_sum.append(hashlib.sha256(raw).hexdigest())
                text_sum.append(hashlib.sha256(decode(numbers, encoder.tokens)).hexdigest())
                if with_ids:
                    ids.append(numbers.astype(np.int32))
            columns = dict(doc_id=b.column(0), n_tokens=pa.array(count, pa.int64()), ids_sha256=pa.array(ids_sum, pa.string()),
                           decoded_sha256=pa.array(text_sum, pa.string()))
            yield batch(**columns, **({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    return run


def encode_documents(documents: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode every text by the ranks in ``path``, each match of ``pattern`` by itself, and decode the ids again.

    ``documents``: ``doc_id``, ``text``; other columns are ignored.  One row a row: ``doc_id``, ``n_tokens``,
    ``ids_sha256`` (ids as little-endian 32-bit integers), ``decoded_sha256`` (decoded bytes) and ``ids``.
    A null text is the empty text, with no ids.  Ids and repeated rows are passed through as they are.  The
    vocabulary is read on the driver and sent to the tasks; its size is that of the file, whatever the input.
    """
    docs = prepare(documents, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.mapInArrow(_encode(shared, path, pattern, with_ids), kind)


@query("op9_bpe_round_trip")
def bpe_query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, with_ids=False)
