"""Language-model scoring by a weighted backoff automaton.

N-grams are smoothed by a Dirichlet prior: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), h' being h
without its first word. Every context is a state; an n-gram that training has is an arc; any other
word takes the state's failure arc, which costs log10(m / (c(h) + m)), and is tried from the shorter
context's state. One traversal from left to right carries the state and sums the weights up.

Counts are gathered without any table that a machine would have to hold. Documents fall into blocks
of bounded size, which are written as tokens once. A block sends its distinct n-grams, as hashes with
training counts, to ranges of the hash; a range adds up what all blocks sent and answers each with the
corpus counts of just those. So a word that everyone uses is one entry for each block, and ranges are
even whatever the text. What is gathered grows with the input; nothing is pruned. There are as many
ranges as the input asks for, and each has a shuffle partition to itself or shares it with few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, partitions_for, quoted, ready, save, small_batches

BLOCK_TOKENS = 1_250_000
#: Bits of an n-gram's hash: of 10**12 n-grams, one in a million shares its count with another.
GRAM_BITS = 60
PRIOR = 40.0
ORDER = 3
_U = np.uint64
#: No word holds white space, so these are no word's hashes but by chance.
END, START = (_U(xxhash.xxh64_intdigest(x)) for x in (b"\n</s>", b"\n<s>"))


# ---------------------------------------------------------------- the automaton


@dataclass
class Automaton:
    """States are numbers from 0, the root, which has an arc for every word.

    arcs are sorted: state * words + word; target and weight belong to them. fail and fail_weight
    belong to states.
    """

    words: int
    arcs: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    start: int

    def run(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum of weights of each sequence tokens[ends[i-1]:ends[i]], all traversed in step."""
        firsts = np.concatenate([[0], ends[:-1]])
        lengths = ends - firsts
        order = np.argsort(-lengths, kind="stable")
        at, left = firsts[order], lengths[order]
        total = np.zeros(len(ends))
        state = np.full(len(ends), self.start, np.int64)
        alive = len(ends)
        step = 0
        last = len(self.arcs) - 1
        while True:
            while alive and left[alive - 1] <= step:
                alive -= 1
            if not alive:
                break
            word = tokens[at[:alive] + step]
            now = state[:alive]
            key = now * self.words + word
            arc = np.minimum(np.searchsorted(self.arcs, key), last)
            found = self.arcs[arc] == key
            if not found.all():
                lost = np.flatnonzero(~found)
                while len(lost):
                    total[lost] += self.fail_weight[now[lost]]
                    now[lost] = self.fail[now[lost]]
                    key = now[lost] * self.words + word[lost]
                    arc[lost] = np.minimum(np.searchsorted(self.arcs, key), last)
                    lost = lost[self.arcs[arc[lost]] != key]
            total[:alive] += self.weight[arc]
            state[:alive] = self.target[arc]
            step += 1
        out = np.empty(len(ends))
        out[order] = total
        return out


def automaton(counts: dict[tuple[int, ...], int], words: int, root: np.ndarray, start: tuple[int, ...], order: int, prior: float = PRIOR) -> Automaton:
    """Of any order, from the counts of n-grams of 2 to `order` words (an n-gram may begin with the start word, whose id is words - 1).

    root has the root's probability of every word; a context's count is the sum of its n-grams'.
    """
    contexts: dict[tuple[int, ...], float] = {}
    for gram, c in counts.items():
        if 2 <= len(gram) <= order and c > 0:
            contexts[gram[:-1]] = contexts.get(gram[:-1], 0) + c
    states = {(): 0} | {h: i + 1 for i, h in enumerate(sorted(contexts, key=lambda h: (len(h), h)))}

    def longest(h: tuple[int, ...]) -> int:
        while h not in states:
            h = h[1:]
        return states[h]

    def p(h: tuple[int, ...], w: int) -> float:
        if not h:
            return float(root[w])
        below = p(h[1:], w)
        return (counts.get((*h, w), 0) + prior * below) / (contexts[h] + prior) if h in contexts else below

    arcs = {w: (longest((w,)), math.log10(root[w])) for w in range(words)}
    for gram, c in counts.items():
        if 2 <= len(gram) <= order and c > 0:
            arcs[states[gram[:-1]] * words + gram[-1]] = (longest(gram[-(order - 1) :]), math.log10(p(gram[:-1], gram[-1])))
    keys = np.array(sorted(arcs), np.int64)
    fail, cost = np.zeros(len(states), np.int64), np.zeros(len(states))
    for h, i in states.items():
        if h:
            fail[i], cost[i] = longest(h[1:]), math.log10(prior / (contexts[h] + prior))
    return Automaton(words, keys, np.array([arcs[k][0] for k in keys.tolist()], np.int64), np.array([arcs[k][1] for k in keys.tolist()]), fail, cost, longest(start))


# ---------------------------------------------------------------- blocks and their messages


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: small numbers take little room."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], size, codec="zstd", asbytes=True), np.uint8)
    item = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(item, -1).T).reshape(-1).view(dtype)


@dataclass
class Block:
    number: int
    doc_ids: list
    held_out: np.ndarray
    ends: np.ndarray  # of each document, in tokens
    words: np.ndarray  # distinct hashes, sorted
    tokens: np.ndarray  # places in words

    @property
    def firsts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 2 to `order` words: (distinct hashes, sorted; a token at which each ends; each token's place in them, or -1).

        A document's tokens follow a start word. A gram that would begin before it isn't one.
        """
        keys, known = np.empty(len(self.tokens), np.uint64), np.ones(len(self.tokens), bool)
        keys[1:] = self.words[self.tokens[:-1]]
        keys[self.firsts] = START
        for _ in range(2, order + 1):
            keys = _mix(keys * _U(0x9E3779B97F4A7C15) + self.words[self.tokens])
            at = np.flatnonzero(known)
            distinct, first, inverse = np.unique(keys[at] >> _U(64 - GRAM_BITS), return_index=True, return_inverse=True)
            place = np.full(len(keys), -1, np.int32)
            place[at] = inverse
            yield distinct, at[first], place
            keys[1:] = keys[:-1].copy()  # the gram that ends a token before, where there is one
            known[1:] &= known[:-1].copy()
            known[self.firsts] = False

    def training(self) -> np.ndarray:
        return np.repeat(~self.held_out, np.diff(self.ends, prepend=0))


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[Block]:
    """Tokenise (doc_id, text, held_out) rows; a block ends with the document that fills it."""
    base = TaskContext.get().partitionId() << 24 if TaskContext.get() else 0
    digest, end = xxhash.xxh64_digest, int(END).to_bytes(8, "big")
    hashes: list[bytes] = []
    ids: list = []
    held: list[bool] = []
    lengths: list[int] = []
    size = made = 0

    def block() -> Block:
        flat = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)
        words, tokens = np.unique(flat, return_inverse=True)
        return Block(base + made, list(ids), np.array(held, bool), np.cumsum(lengths), words, tokens.astype(np.int32))

    for batch in small_batches(batches):
        for doc_id, text, out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = (text or b"").translate(ASCII_LOWER).split()
            hashes += [*map(digest, found), end]
            ids.append(doc_id)
            held.append(out)
            lengths.append(len(found) + 1)
            size += len(found) + 1
            if size >= block_tokens:
                yield block()
                made, size = made + 1, 0
                hashes, ids, held, lengths = [], [], [], []
    if ids:
        yield block()


_TEXT = "blk long, doc_ids array<long>, held_out array<boolean>, ends binary, words binary, by_use binary, tokens binary"
_ASK = "blk long, r int, kind int, keys binary, counts binary"


def _token_blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, block_tokens):
            by_use = np.argsort(-np.bincount(b.tokens, minlength=len(b.words)), kind="stable").astype(np.int32)
            rank = np.empty_like(by_use)
            rank[by_use] = np.arange(len(by_use), dtype=np.int32)  # frequent words get small numbers, which pack well
            packed = (_pack(b.ends.astype("<i8")), _pack(np.diff(b.words, prepend=_U(0))), _pack(by_use), _pack(rank[b.tokens]))
            columns = [pa.array([b.number], pa.int64()), pa.array([b.doc_ids], pa.list_(pa.int64())), pa.array([b.held_out.tolist()], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in packed)]
            yield pa.RecordBatch.from_arrays(columns, ["blk", "doc_ids", "held_out", "ends", "words", "by_use", "tokens"])

    return docs.mapInArrow(run, _TEXT)


def _block_of(row: dict) -> Block:
    words = np.cumsum(_unpack(row["words"], np.uint64), dtype=np.uint64)
    tokens = _unpack(row["by_use"], np.int32)[_unpack(row["tokens"], np.int32)]
    return Block(row["blk"], row["doc_ids"], np.array(row["held_out"], bool), _unpack(row["ends"], "<i8"), words, tokens)


def _asked(blocks: DataFrame, bits: int, order: int) -> DataFrame:
    """What blocks ask the ranges: sorted distinct hashes (kind 0: words, 1: pairs, ...), as differences, with training counts."""

    def asked(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        weight = block.training().astype(np.float64)
        yield 0, block.words, np.bincount(block.tokens, weight, len(block.words))
        for kind, (keys, _, place) in enumerate(block.grams(order), 1):
            yield kind, keys, np.bincount(place[place >= 0], weight[place >= 0], len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block_of({c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)})
                for kind, values, counts in asked(block):
                    width = GRAM_BITS if kind else 64
                    cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << _U(width - bits)) if bits else np.zeros(0, np.int64)
                    parts = [(r, v, c) for r, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts.astype("<i8"), cuts), strict=True)) if len(v)]
                    numbers = [pa.array([block.number] * len(parts), pa.int64()), pa.array([r for r, _, _ in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32())]
                    packed = [pa.array([_pack(np.diff(v, prepend=_U(0))) for _, v, _ in parts], pa.binary()), pa.array([_pack(c) for _, _, c in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*numbers, *packed], ["blk", "r", "kind", "keys", "counts"])

    return blocks.mapInArrow(run, _ASK)


def _answer(group: pa.Table) -> pa.Table:
    """A range's answer to each block: the corpus counts of what it asked for, in its order; and, as block -1, the range's training tokens and distinct words."""
    blk, r, kind = (group.column(c).to_pylist() for c in ("blk", "r", "kind"))
    out: list[tuple] = []
    for k in sorted(set(kind)):
        mine = [i for i, x in enumerate(kind) if x == k]
        keys = [np.cumsum(_unpack(group.column("keys")[i].as_py(), np.uint64), dtype=np.uint64) for i in mine]
        counts = np.concatenate([_unpack(group.column("counts")[i].as_py(), "<i8") for i in mine])
        edges = np.cumsum([0, *map(len, keys)])
        keys = np.concatenate(keys)
        distinct, place = np.unique(keys, return_inverse=True)
        del keys
        total = np.bincount(place, counts, len(distinct)).astype("<i8")
        del distinct, counts
        if k == 0:
            out.append((-1, r[0], k, _pack(np.array([total.sum(), (total > 0).sum()], "<i8"))))
        out += [(blk[i], r[i], k, _pack(total[place[a:b]])) for i, a, b in zip(mine, edges[:-1], edges[1:], strict=True)]
    return pa.table({"blk": pa.array([x[0] for x in out], pa.int64()), "r": pa.array([x[1] for x in out], pa.int32()), "kind": pa.array([x[2] for x in out], pa.int32()), "counts": pa.array([x[3] for x in out], pa.binary())})


def block_automaton(block: Block, counts: list[np.ndarray], base: np.ndarray, documents: float, prior: float) -> Automaton:
    """The part of the corpus's automaton that a block can reach, from the corpus counts of its words, pairs, and so on.

    State 0 is the root, 1 + i the context of word i, and n + 1 the start; then come the longer
    contexts that training has, in the order of their hashes.
    """
    n, order, tokens = len(block.words), len(counts), block.tokens.astype(np.int64)
    is_first = np.zeros(len(tokens), bool)
    is_first[block.firsts] = True
    arcs, target, weight = [np.arange(n)], [np.arange(n) + 1], [np.log10(base)]
    # Of each token: its context's state and count at this level, and its probability one level below.
    source = np.where(is_first, n + 1, np.roll(tokens, 1) + 1)
    held = np.concatenate([[0], counts[0], [documents]])[source].astype(float)
    below = base[tokens]
    fail, cost = [np.zeros(n + 2, np.int64)], [np.concatenate([[0.0], np.log10(prior / (np.concatenate([counts[0], [documents]]) + prior))])]
    states = n + 2
    for level, (_, at, place) in enumerate(block.grams(order), 2):
        seen = counts[level - 1]
        now = np.append(seen, 0)[place]  # place -1: not a gram of this order, of which a block may have none
        p = (now + prior * below) / (held + prior)
        at, c = at[seen > 0], seen[seen > 0]
        state_of = np.full(len(seen) + 1, -1, np.int64)
        if level < order:
            state_of[:-1][seen > 0] = states + np.arange(len(at))
            states += len(at)
            # the longest context shorter than this one: at the first longer level the last word's, then the level's before
            fail.append(tokens[at] + 1 if level == 2 else shorter[at])
            cost.append(np.log10(prior / (c + prior)))
            reached = state_of[place]
        else:
            reached = tokens + 1 if level == 2 else shorter
        arcs.append(source[at] * n + tokens[at])
        weight.append(np.log10(p[at]))
        target.append(reached[at])
        if level < order:
            shorter = reached
            source = np.where(is_first, -1, np.roll(reached, 1))
            held = np.roll(now, 1).astype(float)
            below = p
    arcs, target, weight = np.concatenate(arcs), np.concatenate(target), np.concatenate(weight)
    by_arc = np.argsort(arcs, kind="stable")
    return Automaton(n, arcs[by_arc], target[by_arc], weight[by_arc], np.concatenate(fail), np.concatenate(cost), n + 1)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learnt from: crc32(doc_id as text) mod 10 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def score_documents(docs: DataFrame, prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS, order: int = ORDER) -> DataFrame:
    """One row for every row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end token. A row with a null doc_id is trained on and scored.
    Repeated rows count and are scored as often as they stand. With nothing to train on, all words
    are unknown; an empty table gives no rows. The model has n-grams of up to `order` (2 or more) words.
    """
    ready(docs.sparkSession)
    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("binary").alias("text"))
    marked = rows.withColumn("held_out", held_out())
    parts = partitions_for(rows, 8 << 20)
    bits = max(0, math.ceil(math.log2(parts)))
    blocks = save(_token_blocks(marked, block_tokens), "blocks")  # tokenised once: what is counted is what is scored
    asked = _asked(blocks, bits, order).repartitionById(1 << bits, F.col("r"))  # a task for each range
    answers = save(asked.groupBy("r").applyInArrow(_answer, "blk long, r int, kind int, counts binary"), "answers")
    n = v = 0
    for part in answers.where("blk = -1").select("counts").toLocalIterator():  # two numbers from each range
        more, distinct = _unpack(bytes(part["counts"]), "<i8").tolist()
        n, v = n + more, v + distinct
    end_count = blocks.select(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    scale = n + 0.1 * (v + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        for i in range(left.num_rows):
            block = _block_of({c: left.column(c)[i].as_py() for c in left.column_names})
            told = sorted(zip(right.column("kind").to_pylist(), right.column("r").to_pylist(), right.column("counts").to_pylist(), strict=True), key=lambda x: x[:2])
            counts = [np.concatenate([np.zeros(0, "<i8"), *(_unpack(c, "<i8") for k, _, c in told if k == kind)]) for kind in range(order)]
            base = (counts[0] + 0.1) / scale
            machine = block_automaton(block, counts, base, float(end_count), prior)
            known = np.add.reduceat((counts[0] > 0)[block.tokens].astype(np.int64), block.firsts)
            plain = np.add.reduceat(np.log10(base)[block.tokens], block.firsts)
            scores = machine.run(block.tokens.astype(np.int64), block.ends)
            for column, values in zip(out, (block.doc_ids, block.held_out.tolist(), np.diff(block.ends, prepend=0).tolist(), known.tolist(), [n] * len(block.ends), plain.tolist(), scores.tolist()), strict=True):
                column += values
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _SCORES.split(", ")])

    text = blocks.repartition(parts, "blk").groupBy("blk")
    return text.cogroup(answers.where("blk >= 0").repartition(parts, "blk").groupBy("blk")).applyInArrow(score, _SCORES)
