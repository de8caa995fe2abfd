"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

Tokenizer spans: a byte-level BPE (tokenizers library) tells each token's character offsets, and a
sentencepiece model the spans of its immutable proto (`return_type="proto"` in this release). Where an offset and a span end at the same
character, and the tokens after them begin there, is a coarse cut. Between two coarse cuts the tokens'
decoded bytes tell the rest: characters of several bytes may be cut within, as byte-level tokens and
byte-fallback pieces do. Places where both have a token's end cut the text into groups, and within a
group tokens whose byte ranges overlap are linked.

Neither tokenizer joins what stands before white space that follows something else, or before punctuation
that follows a letter, with what stands after: the byte-level pattern begins a match there, and no piece
of the other has both (which its vocabulary tells; characters that some piece has there are no cuts). So
the text is aligned chunk by chunk: white space and what follows it up to the next, cut also where
punctuation follows a letter. A block's distinct chunks are looked up once, and what was seen before is
not aligned again.

The counts of linked id pairs over the corpus come by one exchange: blocks of documents send each
distinct pair once, with how often they have it, and the totals go back to the blocks that asked.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary, give_back, partitions_for, save, small_batches, text_rows

#: Chunks that a process remembers; then those that were not met since the last time are forgotten.
REMEMBERED = 250_000
#: Characters of chunks that are encoded together.
TOGETHER = 1 << 15
#: Chunks of up to so many characters are remembered.
SHORT = 64
#: Bytes of text in a block of documents.
BLOCK_BYTES = 2 << 20

_SPACE = "▁"
#: A letter, or a number that is no digit.
_LETTER = re.compile(r"[^\W\d_]")
#: Put before a chunk that does not begin with a space: both tokenizers cut between the two, as they cut before the chunk in its text.
_BEFORE = " a"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library; strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_of = {i: bytes(map(letters.__getitem__, t)) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(map(letters.__contains__, t))}

    def spans(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and (begin, end) of each in characters."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return found.ids, np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)


class Pieces:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)}
        #: White space that some piece has after something else, and punctuation that some piece has after a letter.
        self.joined = {y for p in pieces for x, y in pairwise(p.replace(_SPACE, " ")) if y.isspace() and not x.isspace() or _LETTER.match(x) and not y.isalnum()}

    def spans(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and (begin, end) of each in characters of space + text. Of a character's byte-fallback pieces, the last has its span, and those before are empty."""
        found = self.processor.encode(text, return_type="proto").pieces
        ends = np.array([p.end for p in found], np.int64) + 1
        if not text.isascii():  # the proto counts bytes
            ends = np.searchsorted(_character_ends(" " + text), ends, "left") + 1
        return [p.id for p in found], np.stack([np.append(0, ends)[:-1], ends], 1)  # each piece begins where the last one ends


def _character_ends(text: str) -> np.ndarray:
    """Where each character ends, in bytes of UTF-8."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))


def boundaries(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, characters): how many tokens end, and the next begins, at a character; empty spans are part of what follows."""
    stops = np.append(spans[1:, 0] == spans[:-1, 1], True)
    at = np.flatnonzero(stops)
    ends, first = np.unique(spans[at, 1], return_index=True)
    return at[first] + 1, ends


def token_ends(sizes: np.ndarray, spans: np.ndarray, character_ends: np.ndarray | None) -> np.ndarray | None:
    """The byte at which each token ends: at a boundary by its span, inside a character by the bytes decoded since; None where the two disagree.

    character_ends is None for ASCII, where characters are bytes.
    """
    ends = np.cumsum(sizes)
    tokens, characters = boundaries(spans)
    coarse = characters if character_ends is None else character_ends[characters - 1]
    return ends if np.array_equal(ends[tokens - 1], coarse) else None


class Aligned(NamedTuple):
    """What two tokenizers make of a chunk: groups of ids that cover the same bytes, as text, and links of ids whose bytes overlap, packed."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    text: str
    links: bytes

    @property
    def groups(self) -> list[tuple[list[int], list[int]]]:
        return [tuple([*map(int, ids.split(","))] for ids in group.split("|")) for group in self.text.split(";")]


_HEAD = struct.Struct("<4I")


def _put(x: Aligned | None) -> bytes | None:
    """As one value, half the size of a tuple of strings: what hundreds of thousands of chunks are remembered as."""
    return x and _HEAD.pack(*x[:4]) + x.links + x.text.encode()


def _got(value: bytes | None) -> Aligned | None:
    if value is None:
        return None
    *counts, n_links = _HEAD.unpack_from(value)
    end = _HEAD.size + 8 * n_links
    return Aligned(*counts, n_links, value[end:].decode(), value[_HEAD.size : end])


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        with open(path_a, encoding="utf-8") as spec:
            level = json.load(spec)["pre_tokenizer"]
        kept = re.escape("".join(c for c in sorted(self.b.joined - {" "}) if c.isspace())) + r"\x1c-\x1f"
        marks = re.escape("".join(c for c in string.punctuation if c not in self.b.joined))
        mark = f"[{marks}]" if marks else "(?!)"
        space, other = rf"[^\S{kept}]\s*", rf"(?:[^\s{marks}]+|[{kept}]\s*)"
        parts = level["type"] == "ByteLevel" and level["use_regex"] and " " not in self.b.joined
        self._split = re.compile(rf"(?:{space}|{other}|{mark})(?:{other}|(?<!{_LETTER.pattern}){mark})*").findall if parts else None
        self._bytes = [[x.bytes_of.get(i, b"") for i in range(max(x.bytes_of) + 1)] for x in (self.a, self.b)]
        self._sizes = [np.array([*map(len, x)], np.int64) for x in self._bytes]
        #: Each id and what stands after it: in its group, and at its end.
        self._names = [[np.array([f"{i}{mark}" for i in range(len(x))], object) for mark in marks] for x, marks in zip(self._bytes, (",|", ",;"), strict=True)]
        self._new: dict[str, bytes | None] = {}
        self._old: dict[str, bytes | None] = {}
        self._long: list[str] = []

    def chunks(self, spaced: str) -> list[str]:
        return self._split(spaced) if self._split else [spaced]

    def align(self, chunks: list[str]) -> dict[str, Aligned | None]:
        """Of chunks of space + text; None for those where a tokenizer's tokens are not its bytes.

        Chunks that end in no white space stay apart when they are joined, so they are encoded together.
        """
        out: dict[str, Aligned | None] = {}
        part: list[str] = []
        size = 0
        for chunk in chunks:
            if self._split is None or chunk[-1].isspace() or _SPACE in chunk:
                out[chunk] = self._aligned([chunk] if self._split is None else [_BEFORE, chunk])[-1]
                continue
            if chunk[0] != " ":
                part.append(_BEFORE)
            part.append(chunk)
            size += len(chunk) + 2
            if size >= TOGETHER:
                out.update(zip(part, self._aligned(part), strict=True))
                part, size = [], 0
        out.update(zip(part, self._aligned(part), strict=True))
        return out

    def _aligned(self, chunks: list[str]) -> list[Aligned | None]:
        if not chunks:
            return []
        spaced = "".join(chunks)
        data = spaced.encode()
        ids_a, spans_a = self.a.spans(spaced)
        ids_b, spans_b = self.b.spans(spaced[1:])
        same = all(b"".join(map(x.__getitem__, ids)) == data for x, ids in zip(self._bytes, (ids_a, ids_b), strict=True))
        if not same:  # of one chunk at least: each by itself
            return [None] * len(chunks) if len(chunks) <= 2 else [self._aligned([_BEFORE, c])[-1] for c in chunks]
        characters = None if len(data) == len(spaced) else _character_ends(spaced)
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a = token_ends(self._sizes[0][a], spans_a, characters)
        ends_b = token_ends(self._sizes[1][b], spans_b, characters)
        if ends_a is None or ends_b is None:
            raise ValueError("spans and decoded bytes of a tokenizer disagree")
        # Two tokens overlap in one stretch; stretches end where a token of either does.
        stretches = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, stretches)] << 32 | b[np.searchsorted(ends_b, stretches)]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stop_a, stop_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        told = np.empty(len(a) + len(b), object)  # a group's a ids, then its b ids, then the next group's
        for names, ids, stop, before in zip(self._names, (a, b), (stop_a, stop_b), (np.append(0, stop_b), stop_a), strict=True):
            last = np.zeros(len(ids), bool)
            last[stop - 1] = True
            group = np.cumsum(last) - last
            told[np.arange(len(ids)) + before[group]] = np.where(last, names[1][ids], names[0][ids])
        pieces = told.tolist()
        own = np.cumsum([len(c) for c in chunks])
        own = own if characters is None else characters[own - 1]
        to = [(np.searchsorted(x, own) + 1).tolist() for x in (ends_a, ends_b, cuts, stretches)]
        packed = links.tobytes()
        i = j = k = m = 0
        out: list[Aligned | None] = []
        for i2, j2, k2, m2 in zip(*to, strict=True):
            out.append(Aligned(i2 - i, j2 - j, k2 - k, m2 - m, "".join(pieces[i + j : i2 + j2])[:-1], packed[8 * m : 8 * m2]))
            i, j, k, m = i2, j2, k2, m2
        return out

    def split(self, texts: list[bytes | None]) -> list[list[str]]:
        """The chunks of space + text of each text; none for null, empty and invalid texts."""
        out: list[list[str]] = []
        for text in texts:
            try:
                out.append(self.chunks(" " + text.decode()) if text else [])
            except UnicodeDecodeError:
                out.append([])
        return out

    def table(self, chunks: Iterable[str]) -> dict[str, bytes | None]:
        """A table that has each of the distinct chunks with what `align` makes of it, put as one value; it holds until the next call."""
        for c in self._long:
            del self._new[c]
        if len(self._new) >= REMEMBERED:
            self._new, self._old = {}, self._new
        new, old = self._new, self._old
        missing = set(chunks).difference(new)
        again = {c: old[c] for c in missing if c in old}
        fresh = {c: _put(x) for c, x in self.align([*missing.difference(again)]).items()}
        new.update(again)
        new.update(fresh)
        self._long = [c for c in fresh if len(c) > SHORT]
        return new

    def rest(self) -> None:
        """Between tasks a worker idles on beside the executor's heap: it remembers only what was met since some was forgotten."""
        for c in self._long:
            del self._new[c]
        self._long, self._old = [], {}
        give_back()

    def documents(self, texts: list[bytes | None]) -> list[list[Aligned]]:
        """The aligned chunks of each text; none where tokens are not the text's bytes."""
        split = self.split(texts)
        table = self.table(chain.from_iterable(split))
        found = ([_got(table[c]) for c in own] for own in split)
        return [[] if None in own else own for own in found]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str | None = None, path_b: str | None = None) -> Aligner:
    """One for a pair of vocabularies in a process."""
    key = path_a or default_paths()[0], path_b or default_paths()[1]
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def forget() -> None:
    """Let go of this process's aligners and what they remember; one is made again when it is asked for."""
    if _aligners:
        _aligners.clear()
        give_back()


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups) of every row of docs(doc_id, text): groups is `a1,a2|b1;a3|b2,b3`, ids in order.

    Null, empty and invalid texts, and those whose tokens are not the text's bytes, have zeros and ''.
    Repeated rows give repeated rows, a null doc_id is passed on, nothing is shuffled.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in small_batches(batches, limit=1 << 18):
            found = both.documents(text_rows(batch))
            counts = [pa.array([sum(getattr(x, c) for x in chunks) for chunks in found], pa.int64()) for c in names[1:5]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([";".join([x.text for x in chunks]) for chunks in found])], names)

    return as_binary(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


# ---------------------------------------------------------------- counts over the corpus

_BLOCK = (
    "blk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "n_chunks array<long>, chunks binary, sizes binary, places binary, pairs array<long>, times array<long>"
)


def _packed(numbers: np.ndarray) -> bytes:
    """int32 by planes of bytes, the upper ones mostly zeros: they compress well."""
    return np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view(np.int32)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of consecutive stretches of values, which may be empty."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return total[ends[1:]] - total[ends[:-1]]


def _block(number: int, ids: list[int | None], texts: list[bytes | None], both: Aligner) -> pa.RecordBatch:
    """Documents as numbers of the distinct chunks that they are made of; what is counted is counted once for a chunk."""
    split = both.split(texts)
    distinct = dict.fromkeys(chain.from_iterable(split))
    table = both.table(distinct)
    bad = {c for c in distinct if table[c] is None}
    if bad:  # a document of one such chunk has none
        split = [own if bad.isdisjoint(own) else [] for own in split]
        distinct = dict.fromkeys(chain.from_iterable(split))
    values = [*map(table.__getitem__, distinct)]
    counted = [*np.frombuffer(b"".join([v[: _HEAD.size] for v in values]), np.uint32).reshape(-1, 4).T.astype(np.int64)]
    ends = (_HEAD.size + 8 * counted[3]).tolist()
    links = b"".join([v[_HEAD.size : end] for v, end in zip(values, ends, strict=True)])
    told = [v[end:] for v, end in zip(values, ends, strict=True)]
    del values
    places = dict(zip(distinct, range(len(distinct)), strict=True))
    n_chunks = np.array([*map(len, split)], np.int64)
    flat = np.fromiter(map(places.__getitem__, chain.from_iterable(split)), np.int32, int(n_chunks.sum()))
    digests = []
    for own in np.split(flat, np.cumsum(n_chunks)[:-1]):
        digests.append(hashlib.sha256(b";".join(map(told.__getitem__, own.tolist()))).hexdigest() if len(own) else "")
    counts = [_sums(c[flat], n_chunks) for c in counted]
    sizes = counted[3]
    codes, place = np.unique(np.frombuffer(links, np.int64), return_inverse=True)
    times = np.bincount(place, np.repeat(np.bincount(flat, minlength=len(sizes)), sizes), len(codes)).astype(np.int64)
    by_use = np.argsort(-times, kind="stable")  # frequent pairs get small numbers
    rank = np.empty(len(codes), np.int32)
    rank[by_use] = np.arange(len(codes), dtype=np.int32)
    lists = [pa.array([c], pa.list_(pa.int64())) for c in (ids, *counts)]
    binaries = [pa.array([_packed(x)], pa.binary()) for x in (flat, sizes, rank[place])]
    columns = [pa.array([number], pa.int64()), *lists, pa.array([digests], pa.list_(pa.string())), pa.array([n_chunks], pa.list_(pa.int64())), *binaries]
    columns += [pa.array([c[by_use]], pa.list_(pa.int64())) for c in (codes, times)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(docs: DataFrame, path_a: str | None, path_b: str | None, block_bytes: int) -> DataFrame:
    """Aligned documents in blocks: the distinct pairs of a block with how often it has them, and its chunks' links as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        size = 0
        for batch in small_batches(batches, limit=1 << 18):
            for doc_id, text in zip(batch.column(0).to_pylist(), text_rows(batch), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or b"")
                if size >= block_bytes or len(ids) >= 100_000:
                    yield _block(number, ids, texts, both)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _block(number, ids, texts, both)
        del ids, texts
        both.rest()

    return as_binary(docs).mapInArrow(run, _BLOCK)


def pair_totals(asked: DataFrame) -> DataFrame:
    """(pair, total, best) of asked(pair, times): best where no other a is linked with pair's b more often, ties included."""
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    totals = save(asked.groupBy("pair").agg(F.sum("times").alias("total")), "pairs").withColumn("b", b)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


_STATISTICS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def link_statistics(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of every row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is how many links of the whole corpus have its two ids; n_best counts the links
    whose count is the highest of their b id, count_sum adds all counts. Texts as in `align`; those
    without tokens have zeros and '' for a digest. Repeated rows count and are told as often as they
    stand; an empty table gives no rows. A block sends a pair once, however often it has it, so that the
    most frequent pair is as many rows as there are blocks.
    """
    rows = as_binary(docs)
    parts = partitions_for(rows, 8 << 20)
    blocks = save(_blocks(rows, path_a, path_b, block_bytes), "blocks", rows_of=block_bytes)
    asked = blocks.select("blk", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("blk", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    told = asked.join(pair_totals(asked), "pair").select(F.col("blk").alias("asker"), "place", "total", "best").repartition(parts, "asker")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()  # all is aligned: this worker may be one of those that did it
        total = np.zeros(right.num_rows, np.int64)
        best = np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        total[place], best[place] = right.column("total").to_numpy(), right.column("best").to_numpy()
        (row,) = left.to_pylist()
        at, sizes, flat = (_unpacked(row[c]) for c in ("places", "sizes", "chunks"))
        n_best, count_sum = (_sums(_sums(x[at], sizes)[flat], np.array(row["n_chunks"], np.int64)) for x in (best, total))
        columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], n_best, count_sum, row["digests"]]
        return pa.table([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=[c.split()[0] for c in _STATISTICS.split(", ")])

    whole = blocks.drop("pairs", "times").repartition(parts, "blk").groupBy("blk")
    return whole.cogroup(told.groupBy("asker")).applyInArrow(finish, _STATISTICS)
