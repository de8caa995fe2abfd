"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that ends the prefix's encoding. It is found
among the tokens that are suffixes of the prefix: the one that may follow the last token of what is
left. Storing it for every prefix makes appends exact and cheap, and an edit re-encodes only until
the table agrees with the old one over the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import as_binary, decoded, small_batches, text_rows

#: Most pieces and token pairs that a process remembers; beyond it the memory is emptied and fills again.
REMEMBERED = 200_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Remembered(dict):
    """What `compute` gives for a key, remembered."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class BytePairEncoder:
    """Encodes pieces of bytes by merge ranks, as applying the lowest-ranked merge again and again would."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ranks.items()}
        most = max(self.bytes_of) + 1
        self._left, self._right = [*range(most)], [*range(most)]  # the two that a token was merged from; itself for a byte
        self._merged: dict[int, int] = {}  # left << 32 | right -> token
        self._edges: dict[int, int] = {}  # a trie of the tokens read backwards: node << 8 | byte -> node
        self._ends: list[int] = [-1]  # of each node: the token, or -1
        self._follows = _Remembered(self._may_follow)  # left << 32 | right -> bool
        in_order = sorted(ranks.items(), key=lambda x: x[1])
        for token, rank in in_order:
            if len(token) == 1:
                self._add(token, rank)
        for token, rank in in_order:
            if len(token) > 1 and len(parts := self._ids(token, self.fill(token, [-1]))) == 2:
                self._left[rank], self._right[rank] = parts
                pair = parts[0] << 32 | parts[1]
                self._merged[pair] = rank
                self._follows.pop(pair, None)  # of what is remembered, only this pair's answer changes: every deeper step asks for lower ranks
                self._add(token, rank)
            # a token that merges cannot build is met only as a whole piece

    def _add(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in reversed(token):
            key = node << 8 | byte
            if key not in self._edges:
                self._edges[key] = len(self._ends)
                self._ends.append(-1)
            node = self._edges[key]
        self._ends[node] = rank

    def _may_follow(self, pair: int) -> bool:
        """Whether no merge across the border of two neighbouring tokens would have come before those that built them."""
        lefts, rights, merged = self._left, self._right, self._merged
        a, b = pair >> 32, pair & 0xFFFFFFFF
        limit = 1 << 62
        while True:
            across = merged.get(a << 32 | b)
            if across is not None and across < limit:
                return False
            inner_a, inner_b = rights[a], lefts[b]
            # undo the later of the two merges; of equal ones, the left one was first
            if inner_a != a and (a > b or inner_b == b):
                limit, a = a, inner_a
            elif inner_b != b:
                limit, b = b + 1, inner_b
            else:
                return True

    def fill(self, data: bytes, last: list[int], until: int | None = None) -> list[int]:
        """Extend `last`, the last token of every prefix (-1 for the empty one), to the prefixes of up to `until` bytes."""
        edges, ends, follows = self._edges.get, self._ends, self._follows
        for end in range(len(last), (len(data) if until is None else until) + 1):
            node, at, found = 0, end, []
            while at:
                node = edges(node << 8 | data[at - 1])
                if node is None:
                    break
                at -= 1
                if ends[node] >= 0:
                    found.append((at, ends[node]))
            for at, token in reversed(found):
                if not at or follows[last[at] << 32 | token]:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte without a token")
        return last

    def prefixes(self, data: bytes) -> PrefixTable:
        return PrefixTable(self, data)

    def _ids(self, data: bytes, last: list[int]) -> list[int]:
        out, at, bytes_of = [], len(data), self.bytes_of
        while at:
            token = last[at]
            out.append(token)
            at -= len(bytes_of[token])
        return out[::-1]

    def _asked(self, data: bytes, end: int, last: list) -> int:
        """last[end], computed with no more of the shorter prefixes than it asks for."""
        edges, ends, follows = self._edges.get, self._ends, self._follows
        node, at, found = 0, end, []
        while at:
            node = edges(node << 8 | data[at - 1])
            if node is None:
                break
            at -= 1
            if ends[node] >= 0:
                found.append((at, ends[node]))
        for at, token in reversed(found):
            if not at:
                break
            before = last[at]
            if before is None:
                before = self._asked(data, at, last)
            if follows[before << 32 | token]:
                break
        else:
            raise ValueError("a byte without a token")
        last[end] = token
        return token

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece; a piece that is a token as a whole is that token.

        Short pieces fill only those entries of the prefix table that the last token depends on.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        if size > 200:
            return self._ids(piece, self.fill(piece, [-1]))
        last: list = [None] * (size + 1)
        out, bytes_of = [], self.bytes_of
        while size:
            token = last[size] if last[size] is not None else self._asked(piece, size, last)
            out.append(token)
            size -= len(bytes_of[token])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of a piece."""

    def __init__(self, encoder: BytePairEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.fill(self.data, self.last)

    def edit(self, start: int, stop: int, put: bytes) -> int:
        """Replace data[start:stop] by `put`; returns how many prefixes were computed again."""
        old, moved = self.last, len(put) - (stop - start)
        self.data = self.data[:start] + put + self.data[stop:]
        self.last = old[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.encoder.fill(self.data, self.last, end)
            beyond = end > start + len(put)
            same = same + 1 if beyond and old[end - moved] == self.last[end] else 0
            if same > self.encoder.longest:
                self.last += old[end - moved + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        """Read off the table; a piece that is a token as a whole is that token."""
        whole = self.encoder.ranks.get(self.data)
        return [whole] if whole is not None else self.encoder._ids(self.data, self.last)


#: For texts of Latin-1 letters alone and the public pattern, the same split by the faster engine of the standard library.
_LETTER, _NUMBER, _SPACE = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾", r"\t-\r\x20\x85\xa0"
_LATIN = re.compile(rf" ?[{_LETTER}]+| ?[{_NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class TextEncoder:
    """Splits a text by a pattern and encodes each match separately; ids as little-endian 32-bit bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        self._any = regex.compile(same_white_space(pattern)).findall
        self._latin = _LATIN if pattern == default_pattern() else None
        self.bpe = BytePairEncoder(read_ranks(ranks_path))
        self._packed = _Remembered(lambda piece: array("I", self.bpe.encode(piece.encode())).tobytes())
        self._bytes = [self.bpe.bytes_of.get(i, b"") for i in range(max(self.bpe.bytes_of) + 1)]

    def pieces(self, text: str) -> list[str]:
        return self._latin(text) if self._latin and _is_latin(text) else self._any(text)

    def packed(self, text: str) -> bytes:
        return b"".join(map(self._packed.__getitem__, self.pieces(text)))

    def unpacked(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, array("I", packed)))


def same_white_space(pattern: str) -> str:
    r"""The pattern with \s as Unicode's White_Space property, which the four information separators U+001C-U+001F lack."""
    space = r"\t-\r\x20\x85\xa0  -     　"
    out, inside = [], False
    at = 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in (r"\s", r"\S"):
            out.append(space if two == r"\s" and inside else f"[{'^' * (two == r'\S')}{space}]")
            at += 2
            continue
        if two[0] == "\\":
            out.append(two)
            at += 2
            continue
        inside = two[0] == "[" or inside and two[0] != "]"
        out.append(two[0])
        at += 1
    return "".join(out)


_encoders: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(ranks_path: str | None = None, pattern: str | None = None) -> TextEncoder:
    """One encoder for a vocabulary in a process: the tables take a second to build."""
    key = ranks_path or default_ranks(), pattern or default_pattern()
    if key not in _encoders:
        _encoders[key] = TextEncoder(*key)
    return _encoders[key]


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of docs(doc_id, text).

    ids are little-endian unsigned 32-bit integers in one binary; keep_ids = False leaves the column
    out. The digests are of the ids and of what decoding them gives, and are taken where both are
    made, so that decoded bytes never leave the worker. Null and empty texts have no ids. What is not
    UTF-8 in a text is encoded, and decodes, as replacement characters (U+FFFD). Repeated rows give repeated rows; a null doc_id is passed on. Nothing is shuffled; a task holds one small
    batch of texts, or one long text.
    """
    names = ["doc_id", "n_tokens", *["ids"] * keep_ids, "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks_path, pattern)
        sha = hashlib.sha256
        for batch in small_batches(batches, limit=1 << 20):
            ids = [encoder.packed(decoded(t)) for t in text_rows(batch)]
            back = [sha(encoder.unpacked(x)).hexdigest() for x in ids]
            kept = [pa.array(ids, pa.binary())] if keep_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *kept, pa.array([sha(x).hexdigest() for x in ids]), pa.array(back)], names)

    schema = "doc_id long, n_tokens long, " + "ids binary, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return as_binary(docs).mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encode_documents(docs, ranks_path, pattern, keep_ids=False)
