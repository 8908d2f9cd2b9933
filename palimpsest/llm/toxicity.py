"""Toxicity scores from a lexicon matched through Levenshtein automata (operator 6).

* The lexicon is a trie of terms: a short seed list and what the labelled training rows teach, whole words and stems
  (``term*``) whose document frequencies differ significantly between the classes. The trie holds the seeds and the
  learned words of four or more letters; stems are looked up as prefixes.
* A word's Levenshtein automaton (one edit, swapped neighbours included) is intersected with the trie: its states are
  the letters of the word that are used up and whether an edit is left, and a branch of the trie is left once no state
  remains. Words that share no deletion variant with any term can't be within one edit and skip the walk.
* Every hit but those by a stem, which are only counted, is judged in a window of ``WINDOW`` words: quotation marks and reporting words make it a quotation,
  second-person words make it abuse.
* A logistic model over the hit counts gives the score, fitted by Newton's method with a Gaussian prior.

Lexicon and model are fitted on at most ``SAMPLE`` labelled rows, those of the smallest hash of doc_id; that is the
documented bound of the training sample. Scoring reads every text whole. Only the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Phases

SAMPLE, WINDOW = 20_000, 6
#: Distinct terms that a task counts before it hands them on; characters of tokens that a reader remembers.
COUNTED, REMEMBERED = 200_000, 32 << 20
#: A learned term is in so many toxic texts, with so many standard errors between the classes' log odds.
LEAST_TEXTS, LEAST_Z, LEAST_WEIGHT = 4, 4.0, 1.5
SEED = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "trash", "loser", "losers", "clown", "pathetic", "worthless", "disgusting", "dumbass", "bastard", "imbecile", "garbage", "vermin")
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes quoting reported reports word term phrase insult dit disait sagte schrieb nannte dijo llamó".split())
SECOND = frozenset("you your you're youre u ur yourself du dich dein deine tu toi ton vous votre usted tú".split())
QUOTES = frozenset("\"'“”„«»‘’‚‹›")
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›…–—¿¡"
LEET = str.maketrans("013457$@!|", "oieastsaii")
STEMS = (4, 5, 6, 7, 8)
KINDS = ("plain", "aimed", "quoted", "misspelled", "learned", "stems")
#: Prior means and precision of the weights: bias, log counts of each kind, strongest learned weight, stems a word, log length.
PRIOR = np.array([-4.0, 3.0, 3.5, 0.7, 1.5, 0.5, 0.2, 0.3, 0.2, 0.0])
PRECISION = np.array([0.05, 0.5, 1.0, 2.0, 1.0, 0.3, 0.3, 0.3, 0.3, 0.3])


def deletions(word: str) -> list[str]:
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Trie:
    """Terms as nested dicts; None marks an end."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = term

    def within_one(self, word: str) -> list[tuple[str, int]]:
        """Terms at an edit distance of at most one from the word: the trie walked under its automaton.

        The automaton's states without an edit follow the word itself down the trie; each of them leads, by every edit,
        to states that have none left and must follow the rest of the word."""
        found: dict[str, int] = {}
        node, n = self.root, len(word)
        for i in range(n + 1):
            for c, child in node.items():
                if c is None:
                    if i == n:
                        found[child] = 0
                    continue
                self._rest(child, word, i, found)  # a letter that the word lacks
                if i < n and c != word[i]:
                    self._rest(child, word, i + 1, found)  # another letter
            if i == n:
                break
            self._rest(node, word, i + 1, found)  # a letter too many
            if i + 1 < n and word[i + 1] in node:
                swapped = node[word[i + 1]].get(word[i])
                if swapped is not None:
                    self._rest(swapped, word, i + 2, found)
            if word[i] not in node:
                break
            node = node[word[i]]
        return list(found.items())

    @staticmethod
    def _rest(node: dict, word: str, i: int, found: dict[str, int]) -> None:
        for c in word[i:]:
            node = node.get(c)
            if node is None:
                return
        if None in node:
            found.setdefault(node[None], 1)


@dataclass
class Lexicon:
    """Seed terms, learned words and stems with their log-odds weights, and words that clean texts use."""

    words: dict[str, float]
    stems: dict[str, float]
    clean: frozenset[str]
    seeds: frozenset[str] = frozenset(SEED)
    trie: Trie = field(init=False)
    longest: int = field(init=False)
    near: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        fuzzy = sorted(t for t in self.seeds | self.words.keys() if len(t) >= 4)
        self.trie = Trie(fuzzy)
        self.longest = max(map(len, fuzzy), default=0) + 1
        self.near = frozenset(v for t in fuzzy for v in deletions(t))

    def look_up(self, raw: str) -> tuple[str, float] | None:
        """(kind, weight) of a lower-cased token as it stands between spaces, if it's a hit."""
        word = raw.strip(PUNCTUATION)
        if not word:
            return None
        if word in self.seeds:
            return "plain", 4.0
        if word in self.words:
            return "learned", self.words[word]
        stem = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n), default=0.0)
        if stem:
            return "stems", stem
        if 3 <= len(word) <= self.longest and word not in self.clean:
            folded = raw.strip(PUNCTUATION.replace("@", "").replace("$", "").replace("!", "")).translate(LEET)
            if folded != word and folded in self.seeds:
                return "misspelled", 3.0
            if self.close(word):
                return "misspelled", 3.0
        return None

    def close(self, word: str) -> bool:
        """Whether a word is within one edit of a term."""
        return len(word) <= self.longest and not self.near.isdisjoint(deletions(word)) and bool(self.trie.within_one(word))


class Reader:
    """Features of texts; remembers the tokens that it has judged, ``room`` characters of them (64 more for each)."""

    def __init__(self, lexicon: Lexicon, room: int = REMEMBERED) -> None:
        self.lexicon, self.room, self.held = lexicon, room, 0
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        own = set(words)
        if self.held > self.room:
            self.seen, self.hits, self.held = set(), {}, 0
        fresh = own - self.seen
        for w in fresh:
            hit = self.lexicon.look_up(w)
            if hit:
                self.hits[w] = hit
        self.seen |= fresh
        self.held += sum(map(len, fresh)) + 64 * len(fresh)
        count: Counter[str] = Counter()
        strongest = 0.0
        if not self.hits.keys().isdisjoint(own):
            strong = []
            for w in own & self.hits.keys():
                kind, weight = self.hits[w]
                if kind in ("learned", "stems"):
                    strongest = max(strongest, weight)
                if kind == "stems":
                    count[kind] += words.count(w)
                else:
                    strong.append(w)
            if strong:
                some = set(strong)
                for i, w in enumerate(words):
                    if w in some:
                        count[self.judge(words, i)] += 1
        n = len(words)
        return [1.0, *(np.log1p(count[k]) for k in KINDS), strongest, 100.0 * count["stems"] / (n + 20), np.log1p(n) / 5]

    def judge(self, words: list[str], i: int) -> str:
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        token = words[i]
        opened = any(w[0] in QUOTES for w in words[max(0, i - WINDOW) : i + 1])
        closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in words[i : i + WINDOW + 1])
        if (opened and closed) or not REPORTING.isdisjoint(w.strip(PUNCTUATION) for w in around):
            return "quoted"
        if self.hits[token][0] == "misspelled":
            return "misspelled"
        return "aimed" if not SECOND.isdisjoint(w.strip(PUNCTUATION) for w in around) else self.hits[token][0]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Maximum a posteriori weights of a logistic model."""
    beta = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - PRECISION * (beta - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(PRECISION)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


_TERMS = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic texts, clean texts), and the number of texts as the empty term; partial sums, handed on
    whenever ``COUNTED`` terms are held."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([k[0] for k in keys], [k[1] for k in keys], [counts[0][k] for k in keys], [counts[1][k] for k in keys]), _TERMS.types, strict=True)], schema=_TERMS)
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = {w.strip(PUNCTUATION) for w in (text.as_py() or "").lower().split()} - {""}
            to = counts[0 if toxic else 1]
            to.update((w, False) for w in words if len(w) >= 3)
            to.update({(w[:n], True) for w in words for n in STEMS if len(w) > n})
            to["", False] += 1
            if len(counts[0]) + len(counts[1]) >= COUNTED:
                yield flush()
    yield flush()


def _close(lexicon):
    """Terms, one a row, that are within one edit of the lexicon's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.value
        for batch in batches:
            yield batch.filter(pa.array([own.close(w) for w in batch.column(0).to_pylist()], pa.bool_()))

    return run


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled rows whose ``crc32(doc_id) % 5`` isn't 0. Without any, the seeds and the prior."""
    spark = docs.sparkSession
    phases = Phases(spark, "toxicity")
    known = labels.filter("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    known = known.groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.max("toxic").cast("int").alias("toxic_"))
    known = known.orderBy(F.xxhash64("id_"), "id_").limit(SAMPLE)
    texts = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].alias("text_"))
    sample = phases.write(texts.join(F.broadcast(known), "id_").select("text_", "toxic_"))
    terms = sample.mapInArrow(_terms, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    terms = phases.write(terms)
    total = terms.filter("term = ''").first()
    n_toxic, n_clean = (total["toxic"], total["clean"]) if total else (0, 0)
    odds = terms.filter(f"term <> '' and toxic >= {LEAST_TEXTS}").selectExpr(
        "term", "stem", "toxic",
        f"ln((toxic + 0.5) / ({n_toxic} - toxic + 0.5)) - ln((clean + 0.5) / ({n_clean} - clean + 0.5)) as weight",
        f"sqrt(1 / (toxic + 0.5) + 1 / ({n_toxic} - toxic + 0.5) + 1 / (clean + 0.5) + 1 / ({n_clean} - clean + 0.5)) as error",
    ).filter(f"weight >= {LEAST_WEIGHT} and weight >= {LEAST_Z} * error")
    # as many as the sample's toxic texts have in common, at most: the sample bounds them
    kept = odds.orderBy("term", "stem").collect()
    words, stems = ({r["term"]: r["weight"] for r in kept if r["stem"] == x} for x in (False, True))
    lexicon = Lexicon(words, stems, frozenset())
    # words of clean texts aren't misspellings; only those that could be taken for one matter
    own = terms.filter("not stem and clean >= 3 and length(term) >= 3").select("term")
    lexicon.clean = frozenset(r["term"] for r in own.mapInArrow(_close(spark.sparkContext.broadcast(lexicon)), "term string").collect())
    shared = spark.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader.features(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.mapInArrow(features, "x array<double>, y int").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(PRIOR))
    beta = fit(x, rows["y"].to_numpy().astype(float)) if len(x) else PRIOR
    phases.drop(sample, terms)
    return Model(lexicon, beta)


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 (higher: more likely toxic); a null or empty text has the score of no hits.

    Every row is scored by its own text, repeated rows alike; an empty table stays empty. A column of ``docs`` that is
    named like ``score_col`` gives way to the score.
    """
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, beta = Reader(shared.value.lexicon), shared.value.beta
        for batch in batches:
            x = np.array([reader.features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(PRIOR))
            scores = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{score_col}` double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, learned from ``labels`` (doc_id, toxic).

    Labels of held-out rows (``crc32(doc_id) % 5 = 0``) are never read; a null doc_id is held out.
    """
    model = learn(docs, labels)
    scored = score_toxicity(docs.select("doc_id", "text"), model, score_col="score")
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
