"""Language-model scores by a probabilistic suffix tree over tokens (operator 7).

Method: Ron, Singer and Tishby, "The Power of Amnesia" (1996). A context is a sequence of up to ``DEPTH`` tokens.
The tree grows level by level: a context whose suffix is a state becomes one if its next-symbol counts diverge
from those of the suffix, ``n * KL - kinds / 2 * ln(n) >= MIN_GAIN`` nats (the second term is what its own
parameters cost). A token is scored in the longest suffix of its context that is a state; next-symbol
distributions are smoothed from suffix to suffix (Witten-Bell), down to the root.

The root is the unigram distribution with absolute discounting; the discounted mass goes to the one unknown token,
so probabilities over the known tokens and the unknown one sum to one, as in the base score. Every trained token is a
symbol of its own, unless a share is named below which tokens form one class and share its probability in a context as
they do in the root.

1. Texts are cut into tokens once. A block keeps them as numbers of its own word list and sends that list, sorted and
   with training counts, by word hash.
2. Each bucket sums the counts of its words over all blocks, numbers them by falling count, and answers every block, in
   the block's word order, with counts and symbols. Words are needed no further; no table of them is gathered anywhere.
3. Blocks write their tokens as symbols, with what the counts alone give, and send their (context, symbol) keys of
   depth 1 with training counts, by context; buckets sum and test them and answer every block, also whether a key is in
   other blocks. Keys of depths 2 and 3 whose latest symbol is a state follow, by their latest two symbols, so that a
   bucket tests both depths. Where those two stand in one block only, no other block has a part in the counts, and the
   block tests them itself. Every context that passes is a state: no table of states is gathered anywhere.
4. Blocks add up their documents.

The number of buckets is that of shuffle partitions; a block is ``BLOCK_BYTES`` of text, so messages are as many as
blocks times partitions, whatever the texts hold.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .arrays import pack, unpack
from .grouping import partitions, sorted_groups
from .scratch import Phases

#: Longest context; nats a context must save; the share of all tokens below which tokens may form one class.
DEPTH, MIN_GAIN, SHARE = 3, 6.0, 1.6e-5
#: Symbols are 32-bit numbers, this one the class of tokens that are none.
_HALF, CLASS = np.uint64(32), 0xFFFFFFFF
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20
#: The end of a text, as a word that no text holds.
END = b"\n"


def held_out(doc_id: int | None) -> bool:
    """Every tenth id by CRC-32 of its text; rows without an id are never learned from."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class _Coder:
    """Tokens of a block as numbers of its word list."""

    def __init__(self, block: int) -> None:
        self.block, self.held = block, 0
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []

    def add(self, ids: list, buf: np.ndarray, offsets: np.ndarray) -> None:
        raw, get = buf.tobytes().lower(), self.number.__getitem__
        for doc_id, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = raw[a:b].split()
            words.append(END)
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.tokens.append(np.fromiter(map(get, words), np.uint32, len(words)))
        self.held += len(raw)

    def rows(self, n: int) -> pa.RecordBatch:
        """The tokens with bucket -1, and the word list of each bucket with training counts."""
        lists = _by_bucket(list(self.number), n)
        order = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64, len(self.number))
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        tokens = rank[np.concatenate(self.tokens)]
        lengths = np.array(self.lengths, np.uint32)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        trained = np.repeat([not held_out(i) for i in self.ids], lengths)
        counts = np.bincount(tokens, weights=trained, minlength=len(order)).astype(np.int64)
        out, at = [(-1, pack(tokens=tokens, lengths=lengths, known=known, ids=ids))], 0
        for b, words in enumerate(lists):
            if words:
                out.append((b, pack(words=b" ".join(words), counts=_narrow(counts[at : at + len(words)]))))
                at += len(words)
        return _rows(self.block, out)


def _by_bucket(words: list[bytes], n: int) -> list[list[bytes]]:
    """Sorted words of each bucket."""
    out: list[list[bytes]] = [[] for _ in range(n)]
    for b, w in zip(map(n.__rmod__, map(zlib.crc32, words)), words, strict=True):
        out[b].append(w)
    for x in out:
        x.sort()
    return out


def _code(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, coder, made = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            buf, offsets = textvec.string_buffer(batch.column(1))
            for a, b in textvec.pieces(offsets, PIECE_BYTES):
                if coder is None:
                    coder, made = _Coder(base + made), made + 1
                coder.add(ids[a:b], buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if coder.held >= BLOCK_BYTES:
                    yield coder.rows(n)
                    coder = None
        if coder is not None:
            yield coder.rows(n)

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket: summed counts of its words by falling count, the end first, and each block's words as numbers."""
    for (bucket,), table in sorted_groups(batches, ["bucket"]):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        lists, seen = [], []
        for data in table["data"].to_pylist():
            p = unpack(data)
            lists.append(np.fromiter(map(number.__getitem__, p["words"].split(b" ")), np.int64, len(p["counts"])))
            seen.append(p["counts"].astype(np.int64))
        total = _weigh(np.concatenate(lists), np.concatenate(seen), len(number))
        order = np.fromiter(map(number.__getitem__, sorted(number)), np.int64, len(number))
        order = order[np.argsort(-total[order], kind="stable")]
        if END in number:
            order = np.append(number[END], order[order != number[END]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        held, counts = [pack(at=_narrow(rank[x])) for x in lists], total[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([pack(counts=counts)], pa.binary()), pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())]), pa.array([table["block"].to_pylist()], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.binary()))],
            names=["bucket", "counts", "n_tokens", "n_distinct", "blocks", "held"],
        )


def _own(bucket: int, counts: np.ndarray, least: int, end: int) -> np.ndarray:
    """Which words of a bucket are symbols: the first ones, as they come by falling count."""
    own = counts >= least
    if bucket == end:
        own[0] = True
    return own


def _census(least: int, end: int):
    """Of each bucket: words counted once and twice, symbols, their counts' sum, symbols counted once and never."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = unpack(data)["counts"]
                symbols = counts[_own(bucket, counts, least, end)]
                figures = [counts == 1, counts == 2, np.ones(len(symbols)), symbols, symbols == 1, symbols == 0]
                yield pa.RecordBatch.from_arrays([pa.array([int(x.sum())]) for x in figures], names=["one", "two", "own", "own_n", "own_one", "own_none"])

    return run


@dataclass
class Root:
    """What the counts of all words give: a word is a symbol from ``least`` on, ``end`` is the end's number."""

    least: int
    end: int
    n_tokens: int
    n_distinct: int
    discount: float
    class_probability: float
    class_count: int

    def probability(self, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.where(names == CLASS, self.class_probability, np.maximum(counts - self.discount, 1e-9) / max(self.n_tokens, 1))


def plant(summed: DataFrame, n: int, share: float) -> Root:
    """Six sums over the buckets; the words stay where they are."""
    n_tokens, n_distinct = summed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    least, end = max(2, math.ceil(n_tokens * share)) if share else 1, zlib.crc32(END) % n
    names = ["one", "two", "own", "own_n", "own_one", "own_none"]
    census = summed.select("bucket", "counts").mapInArrow(_census(least, end), ", ".join(f"{x} long" for x in names))
    one, two, own, own_n, own_one, own_none = census.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in names)).first()
    discount = one / (one + 2 * two) if one else 0.0
    mass = own_n - own_one - discount * (own - own_one - own_none) + own_one * max(1 - discount, 1e-9) + own_none * 1e-9
    return Root(least, end, n_tokens, n_distinct, discount, max(1 - mass / max(n_tokens, 1), 1e-12), n_tokens - own_n)


def _answer(root: Root, n: int):
    """Counts and symbols of each block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data, blocks, held in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                counts = unpack(data)["counts"]
                own = _own(bucket, counts, root.least, root.end)
                if int(own.sum()) * n > CLASS:
                    raise OverflowError("more symbols than 32 bits can number")
                symbols = np.where(own, np.arange(len(own)) * n + bucket, CLASS)
                for block, at in zip(blocks, held, strict=True):
                    i = unpack(at)["at"]
                    yield _rows(block, [(bucket, pack(counts=_narrow(counts[i]), symbols=symbols[i].astype(np.uint32)))])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _steps(x: np.ndarray) -> np.ndarray:
    return _narrow(np.diff(x, prepend=x.dtype.type(0)))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << _HALF) | low.astype(np.uint64)


def _sorted(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Stable order of pairs of 32-bit numbers, the pairs in it as one number each, and the bits of its lower part.

    Where bits are left for the places, those are sorted along, which is several times faster."""
    bits, at = (int(low.max()).bit_length(), len(low).bit_length()) if len(low) else (0, 0)
    pairs = (high.astype(np.uint64) << np.uint64(bits)) | low.astype(np.uint64)
    if len(low) and int(high.max()).bit_length() + bits + at <= 64:
        pairs = (pairs << np.uint64(at)) | np.arange(len(pairs), dtype=np.uint64)
        pairs.sort()
        return (pairs & np.uint64((1 << at) - 1)).astype(np.int64), pairs >> np.uint64(at), bits
    order = np.argsort(pairs, kind="stable")
    return order, pairs[order], bits


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, as two columns, and the place of each pair among them."""
    order, pairs, bits = _sorted(high, low)
    new = np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]
    place = np.empty(len(pairs), np.int64)
    place[order] = np.cumsum(new) - 1
    own = pairs[new]
    return (own >> np.uint64(bits)).astype(np.int64), (own & np.uint64((1 << bits) - 1)).astype(np.int64), place


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _deal(x: np.ndarray, n: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


def _weigh(place: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(place, weights=n, minlength=size).astype(np.int64)


def _states(context: np.ndarray, n: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, ...]:
    """For keys sorted by context: count, context's total and context's kinds; 0 where the context isn't a state.

    ``parent``: the symbol's share in the context's suffix, 0 where that isn't a state."""
    if not len(n):
        return n, n, n
    first, size = _runs(context)
    total, kinds = np.add.reduceat(n, first), np.add.reduceat((n > 0).astype(np.int64), first)
    seen = (n > 0) & (parent > 0)
    each = np.zeros(len(n))
    each[seen] = n[seen] * np.log(n[seen] / np.repeat(total, size)[seen] / parent[seen])
    gain = np.add.reduceat(each, first) - kinds / 2 * np.log(np.maximum(total, 1))
    state = np.repeat((total > 0) & np.logical_or.reduceat(seen, first) & (gain >= MIN_GAIN), size)
    return n * state, np.repeat(total, size) * state, np.repeat(kinds, size) * state


def _deeper_states(context: np.ndarray, n: np.ndarray, parent: np.ndarray, two: np.ndarray, earliest: np.ndarray, n3: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """As ``_states`` for keys of depth 2, and for those of depth 3: places of their keys of depth 2, first symbols, counts."""
    found = _states(context, n, parent)
    deep = tuple(np.zeros(len(two), np.int64) for _ in range(3))
    at = np.flatnonzero(found[1][two] > 0)
    order, of, _ = _sorted(context[two[at]], earliest[at])
    at = at[order]
    for to, x in zip(deep, _states(of, n3[at], found[0][two[at]] / found[1][two[at]]), strict=True):
        to[at] = x
    return found, deep


def _rows(block: int, data: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(data), pa.int64()), pa.array([b for b, _ in data], pa.int32()), pa.array([x for _, x in data], pa.binary())], names=["block", "bucket", "data"])


_ROWS = "block long, bucket int, data binary"


@dataclass
class Deeper:
    """Tokens with keys of depths 2 and 3 (``three``: those of ``at`` that have three before them), and their places.

    A key of depth 2 is a pair's rank and the symbol, one of depth 3 the place of that key and its first symbol."""

    at: np.ndarray
    pair: np.ndarray
    symbol: np.ndarray
    place2: np.ndarray
    three: np.ndarray
    two: np.ndarray
    earliest: np.ndarray
    place3: np.ndarray

    def counts(self, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _weigh(self.place2, trained[self.at], len(self.pair)), _weigh(self.place3, trained[self.three], len(self.two))


class Block:
    """A block's tokens as numbers of its own symbols, and its keys.

    The keys of depth 1, which are the pairs of neighbours too, come by bucket, context and symbol."""

    def __init__(self, root: Root, tokens: dict, n: int) -> None:
        self.n, self.flat, self.lengths = n, tokens["flat"].astype(np.int64), tokens["lengths"].astype(np.int64)
        self.names, self.counts = np.cumsum(tokens["names"].astype(np.int64)), tokens["counts"].astype(np.int64)
        self.ids = [i if k else None for i, k in zip(tokens["ids"].tolist(), tokens["known"].tolist(), strict=True)]
        # tokens before each in its document, plus one: END stands before a text
        ends = np.cumsum(self.lengths)
        self.before = np.arange(1, len(self.flat) + 1) - np.repeat(ends - self.lengths, self.lengths)
        self.trained = np.repeat([not held_out(i) for i in self.ids], self.lengths)
        bucket = _deal(self.names, n)
        order = _sorted(bucket, np.zeros(len(bucket), np.int64))[0]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        latest = np.append(np.searchsorted(self.names, root.end), self.flat[:-1])
        context, self.symbol, self.place = _distinct(rank[latest], self.flat)
        self.context = order[context]
        self.bounds = np.searchsorted(bucket[self.context], np.arange(n + 1, dtype=np.uint64))

    def ask(self) -> Iterator[tuple[int, bytes]]:
        """Keys of depth 1 by bucket, with training counts and those of the symbol."""
        counts = _weigh(self.place, self.trained, len(self.symbol))
        for b, (i, j) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            if i < j:
                first, size = _runs(self.context[i:j])
                symbol = self.symbol[i:j]
                yield b, pack(context=_steps(self.names[self.context[i:j][first]]), more=_narrow(size), symbol=_narrow(self.names[symbol]), n=_narrow(counts[i:j]), above=_narrow(self.counts[symbol]))

    def hear(self, answers: dict[int, dict]) -> None:
        """Count, context's total and context's kinds of each key of depth 1; whether other blocks have it."""
        self.first = np.zeros((3, len(self.symbol)), np.int64)
        self.shared = np.zeros(len(self.symbol), bool)
        for b, x in answers.items():
            i, j = self.bounds[b], self.bounds[b + 1]
            for to, name in zip(self.first, "ntk", strict=True):
                to[i:j] = x[name]
            self.shared[i:j] = np.unpackbits(x["shared"], count=j - i)
        # pairs by bucket and latest symbol
        self.pair_bucket = _deal(_pair(self.names[self.symbol], self.names[self.context]), self.n)
        self.pairs = _sorted(self.pair_bucket, self.symbol)[0]
        self.rank = np.empty(len(self.pairs), np.int64)
        self.rank[self.pairs] = np.arange(len(self.pairs))

    def deeper(self, shared: bool) -> Deeper:
        """Of the tokens whose latest symbol is a state, after pairs that other blocks have or not."""
        at = np.flatnonzero((self.first[1][self.place] > 0) & (self.before >= 2))
        pair = self.place[at - 1]
        chosen = self.shared[pair] == shared
        at, pair = at[chosen], pair[chosen]
        long = self.before[at] >= DEPTH
        three = at[long]
        ranks, symbol, place2 = _distinct(self.rank[pair], self.flat[at])
        return Deeper(at, ranks, symbol, place2, three, *_distinct(place2[long], self.flat[three - DEPTH]))

    def suffix(self, keys: Deeper) -> np.ndarray:
        """The key of depth 1 that each key of depth 2 ends in: its count and total are those of the context's suffix."""
        out = np.empty(len(keys.pair), np.int64)
        out[keys.place2] = self.place[keys.at]
        return out

    def bounds2(self, keys: Deeper) -> tuple[np.ndarray, np.ndarray]:
        """Where the buckets' keys of depths 2 and 3 begin."""
        two = np.searchsorted(self.pair_bucket[self.pairs[keys.pair]], np.arange(self.n + 1, dtype=np.uint64))
        return two, np.searchsorted(keys.two, two)

    def ask_deeper(self) -> Iterator[tuple[int, bytes]]:
        """Keys of depths 2 and 3 by bucket: latest symbols, the ones before, the symbols, the first symbols."""
        keys = self.deeper(True)
        n2, n3 = keys.counts(self.trained)
        above, of = self.first[:2, self.suffix(keys)]
        pair, symbol, earliest = keys.pair, keys.symbol, keys.earliest
        more3 = np.bincount(keys.two, minlength=len(pair))
        for (i, j), (i3, j3) in zip(*(zip(x[:-1], x[1:], strict=True) for x in self.bounds2(keys)), strict=True):
            if i < j:
                first, size = _runs(pair[i:j])
                ends = self.pairs[pair[i:j][first]]
                latest, size1 = _runs(self.symbol[ends])
                yield (
                    int(self.pair_bucket[ends[0]]),
                    pack(
                        latest=_steps(self.names[self.symbol[ends[latest]]]), of=_narrow(of[i:j][first[latest]]), more1=_narrow(size1), earlier=_narrow(self.names[self.context[ends]]), more2=_narrow(size), symbol=_narrow(self.names[symbol[i:j]]),
                        n2=_narrow(n2[i:j]), above=_narrow(above[i:j]), more3=_narrow(more3[i:j]), earliest=_narrow(self.names[earliest[i3:j3]]), n3=_narrow(n3[i3:j3]),
                    ),
                )

    def scored(self, root: Root, answers: dict[int, dict]) -> np.ndarray:
        """Probabilities of the tokens, which are those of their longest keys."""
        one = _blend(root.probability(self.names, self.counts)[self.symbol], *self.first)
        p = one[self.place]
        for shared in (True, False):
            keys = self.deeper(shared)
            suffix = self.suffix(keys)
            if shared:
                found = [np.zeros((3, len(x)), np.int64) for x in (keys.pair, keys.two)]
                bounds = self.bounds2(keys)
                for b, x in answers.items():
                    for to, ends, depth in zip(found, bounds, (2, 3), strict=True):
                        for row, name in zip(to, "ntk", strict=True):
                            row[ends[b] : ends[b + 1]] = x[f"{name}{depth}"]
            else:
                above, of = self.first[:2, suffix]
                n2, n3 = keys.counts(self.trained)
                found = _deeper_states(keys.pair, n2, above / of, keys.two, keys.earliest, n3)
            two = _blend(one[suffix], *found[0])
            p[keys.at] = two[keys.place2]
            p[keys.three] = _blend(two[keys.two], *found[1])[keys.place3]
        return p


def _told(table: pa.Table, kind: int) -> dict[int, dict]:
    """Answers of one kind by bucket."""
    out = {}
    for i, k in enumerate(table["kind"].to_pylist()):
        if k == kind:
            out[table["bucket"][i].as_py()] = unpack(table["data"][i].as_py())
    return out


def _ask_first(root: Root, n: int):
    """A block's symbols with what its documents' counts give (bucket -1), and its keys of depth 1 by bucket."""
    floor = root.n_tokens + 0.1 * (root.n_distinct + 1)
    unknown = max(root.discount * root.n_distinct, 1e-9)

    def ask(table: pa.Table) -> list[tuple[int, bytes]]:
        tokens, told = _told(table, -1)[-1], _told(table, 0)
        c = np.concatenate([told[b]["counts"].astype(np.int64) for b in sorted(told)])
        symbol = np.concatenate([told[b]["symbols"] for b in sorted(told)]).astype(np.int64)
        # by word first, then by token
        share = np.where(c > 0, np.maximum(c - root.discount, 1e-9), unknown) / max(root.n_tokens, 1) / root.class_probability
        rare = np.where(symbol == CLASS, np.log10(share), 0.0)
        own, lengths = tokens["tokens"], tokens["lengths"].astype(np.int64)
        cut = np.cumsum(lengths) - lengths
        by_doc = lambda x: np.add.reduceat(x[own], cut)
        names, place = np.unique(symbol, return_inverse=True)
        counts = np.zeros(len(names), np.int64)
        counts[place] = np.where(symbol == CLASS, root.class_count, c)
        held = {"flat": _narrow(place[own]), "names": _steps(names), "counts": _narrow(counts), "lengths": tokens["lengths"], "ids": tokens["ids"], "known": tokens["known"], "n_known": by_doc((c > 0).astype(np.int64)), "base": by_doc(np.log10((c + 0.1) / floor)), "rare": by_doc(rare)}
        return [(-1, pack(**held)), *Block(root, held, n).ask()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), table in sorted_groups(batches, ["block"]):
            yield _rows(number, ask(table))

    return run


def _joined(parts: list[dict], name: str) -> np.ndarray:
    return np.concatenate([p[name].astype(np.int64) for p in parts])


def _ends(parts: list[dict], name: str) -> list[tuple[int, int]]:
    ends = np.cumsum([0, *(len(p[name]) for p in parts)]).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def _answer_first(root: Root):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), table in sorted_groups(batches, ["bucket"]):
            parts = [unpack(x) for x in table["data"].to_pylist()]
            context = _dense(np.concatenate([np.cumsum(p["context"].astype(np.int64)) for p in parts]))
            own, _, place = _distinct(np.repeat(context, _joined(parts, "more")), _joined(parts, "symbol"))
            above = np.zeros(len(own), np.int64)
            above[place] = _joined(parts, "above")
            found = _states(own, _weigh(place, _joined(parts, "n"), len(own)), above / max(root.n_tokens, 1))
            shared = np.bincount(place, minlength=len(own)) > 1
            for block, (i, j) in zip(table["block"].to_pylist(), _ends(parts, "symbol"), strict=True):
                yield _rows(block, [(bucket, pack(shared=np.packbits(shared[place[i:j]]), **{k: _narrow(x[place[i:j]]) for k, x in zip("ntk", found, strict=True)}))])

    return run


def _ask_deeper(root: Root, n: int):
    # a function of its own for a block, so that its arrays are gone before the next one's are made
    def ask(table: pa.Table) -> list[tuple[int, bytes]]:
        block = Block(root, _told(table, -1)[-1], n)
        block.hear(_told(table, 1))
        return list(block.ask_deeper())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), table in sorted_groups(batches, ["block"]):
            yield _rows(number, ask(table))

    return run


def _answer_deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket has all contexts that end in its pairs of symbols, so every state of depth 2 or more is found in it."""
    for (bucket,), table in sorted_groups(batches, ["bucket"]):
        parts = [unpack(x) for x in table["data"].to_pylist()]
        more1, more2 = _joined(parts, "more1"), _joined(parts, "more2")
        latest = _dense(np.concatenate([np.cumsum(p["latest"].astype(np.int64)) for p in parts]))
        of = np.repeat(np.repeat(_joined(parts, "of"), more1), more2)
        pair = _distinct(np.repeat(latest, more1), _joined(parts, "earlier"))[2]
        context, _, place2 = _distinct(np.repeat(pair, more2), _joined(parts, "symbol"))
        own3, earliest, place3 = _distinct(np.repeat(place2, _joined(parts, "more3")), _joined(parts, "earliest"))
        parent = np.zeros(len(context))
        parent[place2] = _joined(parts, "above") / of
        two, three = _deeper_states(context, _weigh(place2, _joined(parts, "n2"), len(context)), parent, own3, earliest, _weigh(place3, _joined(parts, "n3"), len(own3)))
        for block, (i, j), (i3, j3) in zip(table["block"].to_pylist(), _ends(parts, "symbol"), _ends(parts, "earliest"), strict=True):
            out = {f"{k}2": _narrow(x[place2[i:j]]) for k, x in zip("ntk", two, strict=True)} | {f"{k}3": _narrow(x[place3[i3:j3]]) for k, x in zip("ntk", three, strict=True)}
            yield _rows(block, [(bucket, pack(**out))])


def _score(root: Root, n: int):
    def score(table: pa.Table) -> pa.RecordBatch:
        held = _told(table, -1)[-1]
        block = Block(root, held, n)
        block.hear(_told(table, 1))
        p = block.scored(root, _told(table, 2))
        scores = np.add.reduceat(np.log10(p), np.cumsum(block.lengths) - block.lengths) + held["rare"]
        ids = block.ids
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(block.lengths), pa.array(held["n_known"]), pa.array(np.full(len(ids), root.n_tokens, np.int64)), pa.array(held["base"]), pa.array(scores)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in sorted_groups(batches, ["block"]):
            yield score(table)

    return run


def _blend(p: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Witten-Bell in the contexts that are states."""
    return np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from rows whose ``crc32(doc_id) % 10`` isn't 0. A text's tokens are its lower-cased words and one end,
    so a null or empty text has one token. Rows without a doc_id are held out; repeated rows count as often as
    they stand. An empty table gives an empty result.
    ``share``: tokens with a smaller share of the trained ones, and those counted once, form one class (a smaller
    model); 0: every trained token is a symbol with contexts of its own. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    phases = Phases(spark, "lm")
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    n = partitions(spark)
    dealt = lambda rows, key: rows.repartition(n, key).sortWithinPartitions(key)
    kinds = lambda rows, kind: rows.selectExpr("block", f"{kind} kind", "bucket", "data")
    own = F.col("bucket") < 0
    coded = phases.write(slim.mapInArrow(_code(n), _ROWS), opaque=True)
    summed = phases.write(dealt(coded.filter(~own), "bucket").mapInArrow(_sum, "bucket int, counts binary, n_tokens long, n_distinct long, blocks array<long>, held array<binary>"), opaque=True)
    phases.settle()
    root = plant(summed, n, share)
    answers = summed.select("bucket", "counts", "blocks", "held").mapInArrow(_answer(root, n), _ROWS)
    asked = dealt(kinds(coded.filter(own), -1).union(kinds(answers, 0)), "block").mapInArrow(_ask_first(root, n), _ROWS)
    asked = phases.write(asked.withColumn("own", own), opaque=True, by="own")
    phases.drop(coded, summed)
    phases.settle()
    tokens = kinds(asked.filter("own"), -1)
    first = phases.write(dealt(asked.filter("not own").select("block", "bucket", "data"), "bucket").mapInArrow(_answer_first(root), _ROWS), opaque=True)
    phases.drop(asked, part="own=false")
    phases.settle()
    deeper = dealt(tokens.union(kinds(first, 1)), "block").mapInArrow(_ask_deeper(root, n), _ROWS)
    deeper = phases.write(dealt(deeper, "bucket").mapInArrow(_answer_deeper, _ROWS), opaque=True)
    phases.settle()
    every = dealt(tokens.union(kinds(first, 1)).union(kinds(deeper, 2)), "block")
    out = phases.write(every.mapInArrow(_score(root, n), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    phases.drop(asked, first, deeper)
    return out
