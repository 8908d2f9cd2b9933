"""Benchmark decontamination by latent semantic retrieval (operator 8).

Method: Halko, Martinsson and Tropp's randomised range finder on the TF-IDF matrix of passages (``PASSAGE`` words,
every ``STRIDE``), then cosine search in the latent space, then a word-level longest common subsequence and an answer
check on each candidate's surroundings.

The benchmark is taken in blocks of items with at most ``BLOCK_ITEMS`` passages (a longer item is a block of its own),
whatever its size, and ``SHELF`` blocks are searched together; their terms, weights and latent bases are what is
broadcast. Document frequencies, the decomposition and the search cover all documents.

1. All texts are cut into words once a shelf and stored as the numbers of the shelf's words (-1: any other word), which
   is all that later steps need; document frequencies of the shelf's terms come from there.
2. Passages with at least ``LEAST_TERMS`` informative terms (rare ones, or among an item passage's rarest) as sparse
   rows; one is enough if it is of an item with fewer than ``SHORT`` words, which may have no other.
3. Basis of rank ``RANK`` by power iterations ``Z = orth(A'A Z)`` with the rows spread out; partial products are
   summed in a tree.
4. All stored texts: latent cosine of every such passage with every passage of every item, and with the
   whole item; from ``LEAST_COSINE`` on, the longest
   common subsequence of the item and the words around the passage decides: ``SURE`` of the item's words, or
   ``LIKELY`` of them together with the answer (the item's last sentence) word for word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import partitions
from .scratch import Phases

PASSAGE, STRIDE, BLOCK_ITEMS, SHELF, RANK, POWER = 48, 24, 256, 4, 384, 2
RARE, RAREST, LEAST_TERMS, LEAST_COSINE, SURE, LIKELY, SHORT = 0.002, 8, 2, 0.35, 0.8, 0.6, 8
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Item:
    item_id: int
    words: list[str]
    answer: list[str]


def items_of(rows: list[tuple[int, str | None]]) -> list[Item]:
    """Items with words; the answer is the last sentence of three words or more, if there are others."""
    out = []
    for item_id, text in rows:
        words = words_of(text)
        sentences = [s for s in (words_of(x) for x in re.split(r"[.!?\n]+", text or "")) if len(s) >= 3]
        if item_id is not None and words:
            out.append(Item(item_id, words, sentences[-1] if len(sentences) > 1 else []))
    return out


def n_passages(items: list[Item]) -> int:
    return sum(-(-len(item.words) // STRIDE) for item in items)


def blocks_of(items: list[Item]) -> list[list[Item]]:
    """Items in blocks of at most ``BLOCK_ITEMS`` passages, or of one item."""
    out: list[list[Item]] = []
    room = 0
    for item in items:
        n = n_passages([item])
        if not out or n > room:
            out.append([])
            room = BLOCK_ITEMS
        out[-1].append(item)
        room -= n
    return out


def common_subsequence(item: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``item``: the positions of each word as bits."""
    full = (1 << n) - 1
    row = full
    for w in words:
        match = item.get(w)
        if match:
            u = row & match
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def holds(words: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` stands in ``words`` in one piece; both int32."""
    whole, raw = words.tobytes(), part.tobytes()
    at = whole.find(raw)
    while at >= 0 and at % 4:
        at = whole.find(raw, at + 1)
    return at >= 0


@dataclass
class Query:
    """A block of items: word numbers, the informative terms among them with weights, and the latent basis."""

    items: list[Item]
    vocabulary: dict[str, int]
    term: np.ndarray
    idf: np.ndarray
    #: terms of items that may have no second one
    sole: np.ndarray
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    #: where each item's rows of ``latent`` begin
    first: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.words = [number_words(item.words, self.vocabulary) for item in self.items]
        self.answers = [number_words(item.answer, self.vocabulary) for item in self.items]
        self.bits = []
        for words in self.words:
            at: dict[int, int] = {}
            for i, w in enumerate(words.tolist()):
                at[w] = at.get(w, 0) | 1 << i
            self.bits.append(at)

    def rows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, offsets, terms, weights) of the passages with enough informative terms."""
        none = np.zeros(0, np.int64)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        # a last entry of -1: the term of words outside the block's
        term = np.append(self.term, -1)[np.concatenate(texts)] if texts else none
        at = np.flatnonzero(term >= 0)
        if not len(at):
            return none, none, np.zeros(1, np.int64), none, np.zeros(0)
        doc = np.searchsorted(ends, at, side="right")
        p = (at - np.concatenate([[0], ends])[doc]) // STRIDE
        term = term[at].astype(np.int64)
        again = p > 0
        doc, passage, term = np.concatenate([doc, doc[again]]), np.concatenate([p, p[again] - 1]), np.concatenate([term, term[again]])
        row = doc * (int(passage.max()) + 1) + passage
        cell, tf = np.unique(row * len(self.idf) + term, return_counts=True)
        row, term = np.divmod(cell, len(self.idf))
        rows, size = np.unique(row, return_counts=True)
        enough = size >= LEAST_TERMS
        if self.sole.any() and len(rows):
            enough |= np.logical_or.reduceat(self.sole[term], np.cumsum(size) - size)
        keep = np.repeat(enough, size)
        offsets = np.concatenate([[0], np.cumsum(size[enough])])
        weight = (1 + np.log(tf[keep])) * self.idf[term[keep]]
        norm = np.sqrt(np.add.reduceat(weight**2, offsets[:-1])) if len(offsets) > 1 else np.zeros(0)
        text, start = np.divmod(rows[enough], int(passage.max()) + 1)
        return text, start * STRIDE, offsets, term[keep], weight / np.repeat(norm, np.diff(offsets))


def number_words(words: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))


def numbered(cell) -> np.ndarray:
    """The stored word numbers of a text."""
    return np.frombuffer(cell.as_buffer(), np.int32)


def _project(offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros((0, basis.shape[1]))
    out = [np.add.reduceat(basis[terms[a:b]] * weights[a:b, None], offsets[i:j] - a, axis=0) for i, j, a, b in _steps(offsets)]
    return np.concatenate(out)


def _steps(offsets: np.ndarray, rows: int = 8192) -> Iterator[tuple[int, int, int, int]]:
    for i in range(0, len(offsets) - 1, rows):
        j = min(i + rows, len(offsets) - 1)
        yield i, j, int(offsets[i]), int(offsets[j])


def _number(vocabulary, text_at: int, kept: list[int], names: list[str]):
    """The kept columns and the text's word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [number_words(words_of(t.as_py()), own).tobytes() for t in part.column(text_at)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(texts, pa.binary())], names=names)

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        n = 0
        for batch in batches:
            for text in batch.column(0):
                count[np.unique(np.append(numbered(text), -1))[1:]] += 1
            n += batch.num_rows
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([n, *count[some].tolist()], pa.int64())], names=["term", "n"])

    return run


def _sparse(query):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                _, _, offsets, terms, weights = query.value.rows([numbered(t) for t in batch.column(0).slice(at, 500)])
                if len(offsets) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([offsets.astype(np.int32).tobytes()], [terms.astype(np.int32).tobytes()], [weights.astype(np.float32).tobytes()])], names=["offsets", "terms", "weights"])

    return run


def _product(basis, gram: bool):
    """Partial A'A Z, or (A Z)'(A Z), of a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = basis.value
        total = np.zeros((z.shape[1], z.shape[1]) if gram else z.shape)
        for batch in batches:
            for o, t, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                offsets, terms, weights = np.frombuffer(o, np.int32), np.frombuffer(t, np.int32), np.frombuffer(w, np.float32).astype(float)
                y = _project(offsets, terms, weights, z)
                if gram:
                    total += y.T @ y
                    continue
                order = np.argsort(terms, kind="stable")
                own, first = np.unique(terms[order], return_index=True)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[order]
                total[own] += np.add.reduceat(y[row] * weights[order][:, None], first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column(0).to_pylist():
            x = np.frombuffer(part, np.float32)
            total = x.astype(float) if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["part"])


def _tree_sum(parts: DataFrame, n: int, shape: tuple[int, int]) -> np.ndarray:
    """Sum of partial matrices, of which the driver gets about the square root of their number."""
    parts = parts.repartition(max(1, math.isqrt(n))).mapInArrow(_add, "part binary")
    return sum((np.frombuffer(r["part"], np.float32).astype(float) for r in parts.toLocalIterator()), np.zeros(shape[0] * shape[1])).reshape(shape)


def decompose(sparse: DataFrame, query: Query) -> np.ndarray:
    """Right singular vectors, by rank, of the passages' rows with the items' own rows added.

    The items' rows get as much weight as all passages together: else a large corpus of passages that share terms by
    chance would fill the basis, and items would leave the space they are searched in."""
    spark = sparse.sparkSession
    m = len(query.idf)
    own = query.rows([w[j : j + PASSAGE] for w in query.words for j in range(0, max(1, len(w) - STRIDE), STRIDE)])
    most = max(RANK, n_passages(query.items))
    rank = min(most + 16, m)
    z = np.linalg.qr(np.random.default_rng(8).standard_normal((m, rank)))[0]
    n = max(sparse.rdd.getNumPartitions(), 1)
    n_rows = sparse.agg(F.coalesce(F.sum(F.length("offsets") / 4 - 1), F.lit(0.0)).alias("n")).first()["n"]
    pull = max(1.0, n_rows / max(len(own[0]), 1))  # the items' rows weigh as much as all passages, whatever their number

    def item_part(z: np.ndarray) -> np.ndarray:
        y = _project(*own[2:], z)
        out = np.zeros_like(z)
        np.add.at(out, own[3], np.repeat(y, np.diff(own[2]), axis=0) * own[4][:, None])
        return out * pull

    for _ in range(POWER):
        shared = spark.sparkContext.broadcast(z.astype(np.float32))
        z = np.linalg.qr(_tree_sum(sparse.mapInArrow(_product(shared, False), "part binary"), n, z.shape) + item_part(z))[0]
    shared = spark.sparkContext.broadcast(z.astype(np.float32))
    y = _project(*own[2:], z)
    gram = _tree_sum(sparse.mapInArrow(_product(shared, True), "part binary"), n, (rank, rank)) + pull * (y.T @ y)
    values, vectors = np.linalg.eigh(gram)
    best = np.argsort(-values)[:most]
    return (z @ vectors[:, best]).astype(np.float32)


def matches(query: Query, texts: list[np.ndarray]) -> list[dict[int, float]]:
    """For each text, the items found in it with the share of their words."""
    found: list[dict[int, float]] = [{} for _ in texts]
    doc, start, offsets, terms, weights = query.rows(texts)
    for i, j, a, b in _steps(offsets):
        y = _project(offsets[i : j + 1] - a, terms[a:b], weights[a:b], query.basis)
        # the part outside the latent space counts in the norm: the rows have norm 1
        for p, q in zip(*np.nonzero(np.maximum.reduceat(y @ query.latent.T, query.first, axis=1) >= LEAST_COSINE), strict=True):
            d, item = int(doc[i + p]), query.items[q]
            n = len(item.words)
            if item.item_id in found[d] and found[d][item.item_id] >= 1:
                continue
            s = int(start[i + p])
            around = texts[d][max(0, s - n) : s + PASSAGE + n]
            if n < SHORT:
                share = float(holds(around, query.words[q]))
            else:
                share = common_subsequence(query.bits[q], n, around[around >= 0].tolist()) / n
                if share < SURE and not (share >= LIKELY and item.answer and holds(around, query.answers[q])):
                    share = 0.0
            if share > found[d].get(item.item_id, 0.0):
                found[d][item.item_id] = share
    return found


def _search(queries, words_at: int, names: list[str]):
    """All columns but the word numbers, the last, with what a shelf's items add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [numbered(t) for t in part.column(words_at)]
                found: list[dict[int, float]] = [{} for _ in texts]
                for query in queries:
                    for own, more in zip(found, matches(query.value, texts), strict=True):
                        for item, share in more.items():
                            own[item] = max(share, own.get(item, 0.0))
                lists = pa.array([sorted(f) for f in found], pa.list_(pa.int64()))
                shares = pa.array([max(f.values(), default=0.0) for f in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:words_at], lists, shares], names=names)

    return run


def frequencies(texts: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """In how many texts each word of the shelf is, and the number of texts."""
    seen = texts.mapInArrow(_frequencies(n_words), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = seen["term"].to_numpy(), seen["n"].to_numpy()
    df = np.zeros(n_words, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def prepare(texts: DataFrame, items: list[Item], vocabulary: dict[str, int], df: np.ndarray, n_docs: int, phases: Phases) -> Query:
    """Weights and latent basis of a block of items over all ``texts``, given as word numbers of the shelf."""
    spark = texts.sparkSession
    words = sorted({w for item in items for w in item.words})
    informative = {w for w in words if df[vocabulary[w]] <= RARE * n_docs}
    for item in items:
        for at in range(0, max(1, len(item.words) - STRIDE), STRIDE):
            informative.update(sorted(set(item.words[at : at + PASSAGE]), key=lambda w: (df[vocabulary[w]], w))[:RAREST])
    term = np.full(len(vocabulary), -1, np.int32)
    term[[vocabulary[w] for w in sorted(informative)]] = np.arange(len(informative))
    idf = np.array([math.log((n_docs + 1) / (df[vocabulary[w]] + 1)) + 1e-3 for w in sorted(informative)])
    short = {w for item in items if len(item.words) < SHORT for w in item.words}
    query = Query(items, {w: vocabulary[w] for w in words}, term, idf, np.array([w in short for w in sorted(informative)], bool))
    sparse = phases.write(texts.mapInArrow(_sparse(spark.sparkContext.broadcast(query)), "offsets binary, terms binary, weights binary"), opaque=True)
    basis = decompose(sparse, query)
    phases.drop(sparse)
    whole = np.zeros((len(items), basis.shape[1]), np.float32)
    for q, words in enumerate(query.words):
        terms = term[words]
        for t, tf in zip(*np.unique(terms[terms >= 0], return_counts=True), strict=True):
            whole[q] += (1 + math.log(tf)) * idf[t] * basis[t]
    own, _, *rows = query.rows(query.words)
    owner = np.concatenate([np.arange(len(items)), own])
    order = np.argsort(owner, kind="stable")
    latent = np.concatenate([whole, _project(*rows, basis)])[order].astype(np.float32)
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent /= np.where(norm > 0, norm, 1)
    query.first = np.searchsorted(owner[order], np.arange(len(items)))
    query.basis, query.latent = basis, latent
    return query


_ADDED = {"leaked_items": "array<bigint>", "leak_share": "double"}


def shelves(wanted: DataFrame) -> Iterator[tuple[list[list[Item]], bool]]:
    """(blocks of items to be searched together, whether they are the last); no more than a shelf is held at once."""
    n_parts = max(1, -(-wanted.count() // (SHELF * BLOCK_ITEMS)))
    held: list[list[Item]] = []
    for part in range(n_parts):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part) if n_parts > 1 else wanted
        held += blocks_of(items_of([(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").collect()]))
        while len(held) > SHELF:
            yield held[:SHELF], False
            held = held[SHELF:]
    yield held, True


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with leaked_items (sorted item ids found in the text) and leak_share (of
    the item's words, at most 1).

    Null or empty texts and items match nothing; repeated rows and items are judged alike, items of one id as one; an
    empty benchmark finds nothing and an empty table stays empty. Columns of ``docs`` named like an added one give way.
    """
    docs = docs.drop(*_ADDED)
    columns = [c for c in columns or docs.columns if c not in _ADDED]
    spark = docs.sparkSession
    phases = Phases(spark, "leaks")
    wanted = phases.write(benchmark.select(benchmark[item_id].cast("long").alias("item_id"), benchmark[item_text].alias("text")).filter("item_id is not null and text is not null").distinct())
    out = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_col])), F.expr("cast(array() as array<bigint>)").alias("leaked_items"), F.lit(0.0).alias("leak_share"))
    before = None
    for cut, last in shelves(wanted):
        kept = [*(columns if last else out.columns[:-2]), *_ADDED]
        number_col, more = _free("words", kept), [_free("more_items", kept), _free("more_share", kept)]
        fields = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in kept)
        vocabulary = {w: i for i, w in enumerate(sorted({w for some in cut for item in some for w in item.words}))}
        number = _number(spark.sparkContext.broadcast(vocabulary), out.columns.index(text_col), [out.columns.index(c) for c in kept], [*kept, number_col])
        stored = phases.write(out.mapInArrow(number, f"{fields}, `{number_col}` binary"))
        if before is not None:
            phases.drop(before)
        before, texts = stored, stored.select(number_col)
        df, n_docs = frequencies(texts, len(vocabulary))
        queries = [spark.sparkContext.broadcast(prepare(texts, some, vocabulary, df, n_docs, phases)) for some in cut]
        found = stored.mapInArrow(_search(queries, len(kept), [*kept, *more]), f"{fields}, `{more[0]}` array<bigint>, `{more[1]}` double")
        items = F.array_sort(F.array_union("leaked_items", F.col(more[0])))
        out = found.select(*(F.col(f"`{c}`") for c in kept[:-2]), items.alias("leaked_items"), F.greatest("leak_share", F.col(more[1])).alias("leak_share"))
    return out


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name
