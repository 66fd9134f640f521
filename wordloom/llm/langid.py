"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, computed by a forward algorithm; a text's score for a language is the sum of its words' log
probabilities. The piece probabilities are fitted by expectation-maximisation (forward-backward expected counts) on the word
counts of a bounded sample of labelled documents: about ``per_language`` documents of each language, chosen by a hash. Prediction reads every whole
text in one pass; the forward algorithm runs over all new words of a batch at once, and words met before are looked up. Long words go
through the same recursion with rescaled or logarithmic probabilities, a stretch at a time, so no word is cut.

Defined cases: null text, or text without a letter, is ``und`` with score 0; ties go to the language first in order; words and texts may have any length;
equal texts get equal results, repeated rows too; without any labelled text (an empty table, say) the model knows no language and every text is
``und`` with score 0; an empty table gives no rows; other columns pass through, and those named as one of the results get underscores before their names.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import make_room, resident, slices

UNDETERMINED = "und"
MARK = "▁"  # word start, as in the vocabulary
#: Letters up to which probabilities are held as they are; beyond, they are rescaled, or held as logarithms.
PLAIN = 32
#: Letters of a long word that are looked up at a time.
STRETCH = 4096
#: Probability of a letter, or of a piece in a language, that was never seen.
FLOOR = 1e-8
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[str, ...]:
    """The lower-case pieces of letters of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower()
        body = p.removeprefix(MARK)
        if body.isalpha() or p == MARK:
            out.add(p)
    return tuple(sorted(out))


class Trie:
    """Pieces as sorted (node, letter) keys, walked for many words at once."""

    def __init__(self, pieces: tuple[str, ...]):
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        self.depth = max(map(len, pieces), default=1)
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            ends[at] = i
        keys = np.array([a << 21 | c for a, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, dtype=np.int64)
        self.piece[list(ends)] = list(ends.values())

    def spans(self, words: list[str]) -> np.ndarray:
        """Piece of each (word, start, length - 1), or -1; words have one length."""
        n, width = len(words), len(words[0])
        letters = np.array([list(map(ord, w)) for w in words], dtype=np.int64)
        depth = min(width, self.depth)
        out = np.full((n, width, depth), -1, dtype=np.int32)
        row, start = np.divmod(np.arange(n * width), width)
        node = np.zeros(n * width, dtype=np.int64)
        for k in range(depth):
            inside = start + k < width
            row, start, node = row[inside], start[inside], node[inside]
            key = node << 21 | letters[row, start + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            row, start, node = row[found], start[found], self.to[at[found]]
            out[row, start, k] = self.piece[node]
        return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def forward(spans: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]. ``p``: (pieces + 1, languages), its last row for no piece: 0.

    A letter that is no piece can stand alone with probability FLOOR.
    """
    n, width, depth = spans.shape
    alpha = np.zeros((width + 1, n, p.shape[1]))
    alpha[0] = 1
    for end in range(1, width + 1):
        for k in range(min(depth, end)):
            q = p[spans[:, end - k - 1, k]]
            if k == 0:
                q = np.maximum(q, FLOOR)
            alpha[end] += alpha[end - k - 1] * q
    return alpha


def log_long(trie: Trie, word: str, p: np.ndarray) -> np.ndarray:
    """log P(word) in each language for a word of any length: the same recursion, rescaled at each letter, a stretch of letters at a time."""
    depth, scale = trie.depth, np.zeros(p.shape[1])
    held = np.zeros((depth, p.shape[1]))  # the last alphas, the latest first
    held[0] = 1
    recent = np.full((depth, depth), -1)  # pieces that start at the last letters, the latest first
    each = np.arange(depth)
    for first in range(0, len(word), STRETCH):
        spans = trie.spans([word[first : first + STRETCH + depth - 1]])[0]
        for row in spans[: min(STRETCH, len(word) - first)]:
            recent[1:] = recent[:-1]
            recent[0, : len(row)], recent[0, len(row) :] = row, -1
            q = p[recent[each, each]]
            q[0] = np.maximum(q[0], FLOOR)
            alpha = (held * q).sum(axis=0)
            held[1:] = held[:-1]
            held[0] = alpha
            held /= alpha
            scale += np.log(alpha)
    return scale


def expected_long(spans: np.ndarray, p: np.ndarray, weight: float) -> np.ndarray:
    """``expected`` for one long word, with logarithms."""
    width, depth = spans.shape
    with np.errstate(divide="ignore"):
        logs = np.log(p[spans, 0])
    steps = logs.copy()
    steps[:, 0] = np.maximum(steps[:, 0], np.log(FLOOR))
    alpha, beta = np.full(width + 1, -np.inf), np.full(width + 1, -np.inf)
    alpha[0] = beta[width] = 0
    for end in range(1, width + 1):
        k = np.arange(min(depth, end))
        alpha[end] = np.logaddexp.reduce(alpha[end - k - 1] + steps[end - k - 1, k])
    for start in range(width - 1, -1, -1):
        k = np.arange(min(depth, width - start))
        beta[start] = np.logaddexp.reduce(beta[start + k + 1] + steps[start, k])
    counts = np.zeros(len(p))
    for start in range(width):
        k = np.arange(min(depth, width - start))
        np.add.at(counts, spans[start, k], weight * np.exp(alpha[start] + logs[start, k] + beta[start + k + 1] - alpha[width]))
    counts[-1] = 0
    return counts


def expected(spans: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of pieces under one language's ``p`` (pieces + 1, 1)."""
    n, width, depth = spans.shape
    alpha = forward(spans, p)[..., 0]
    beta = np.zeros((width + 1, n))
    beta[width] = 1
    for start in range(width - 1, -1, -1):
        for k in range(min(depth, width - start)):
            q = p[spans[:, start, k], 0]
            beta[start] += beta[start + k + 1] * (np.maximum(q, FLOOR) if k == 0 else q)
    counts = np.zeros(len(p))
    for start in range(width):
        for k in range(min(depth, width - start)):
            s = spans[:, start, k]
            counts += np.bincount(s % len(p), weights=weight * alpha[start] * p[s, 0] * beta[start + k + 1] / alpha[width], minlength=len(p))
    counts[-1] = 0
    return counts


@dataclass
class Model:
    languages: list[str]
    pieces: tuple[str, ...]
    p: np.ndarray
    _trie: Trie | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "p": self.p, "_trie": None}

    @property
    def trie(self) -> Trie:
        if self._trie is None:
            self._trie = Trie(self.pieces)
        return self._trie

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language) of each word."""
        units, logs = [MARK + w for w in words], np.zeros((len(words), len(self.languages)))
        for width, own in by_length(units).items():
            if width > PLAIN:
                for i in own:
                    logs[i] = log_long(self.trie, units[i], self.p)
                continue
            for k in range(0, len(own), 2048):
                some = own[k : k + 2048]
                logs[some] = np.log(forward(self.trie.spans([units[i] for i in some]), self.p)[-1])
        return logs


def fit_counts(counts: dict[str, dict[str, int]], pieces: tuple[str, ...], rounds: int = 3) -> Model:
    """A model from word counts of each language."""
    trie, languages = Trie(pieces), sorted(counts)
    columns = [np.zeros((len(pieces) + 1, 0))]
    for language in languages:
        words = sorted(counts[language])
        units, weight = [MARK + w for w in words], np.array([counts[language][w] for w in words], dtype=float)
        # Some thousand words at a time, looked up anew in each round: memory stays small.
        groups = [np.array(own[k : k + 2048]) for width, own in by_length(units).items() if width <= PLAIN for k in range(0, len(own), 2048)]
        long = [i for i, u in enumerate(units) if len(u) > PLAIN]
        p = np.full((len(pieces) + 1, 1), 1.0 / len(pieces))
        p[-1] = 0
        for _ in range(rounds):
            c = np.zeros(len(p))
            for own in groups:
                c += expected(trie.spans([units[i] for i in own]), p, weight[own])
            for i in long:
                c += expected_long(trie.spans([units[i]])[0], p, weight[i])
            p = np.maximum(c / max(c.sum(), 1e-300), FLOOR)[:, None]
            p[-1] = 0
        columns.append(p)
    return Model(languages, pieces, np.concatenate(columns, axis=1))


def fit(df: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 500) -> Model:
    """Fits a model on about ``per_language`` labelled rows of each language, chosen by a hash of ``key``; their words, counted, go to the driver."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language, as the model has
    if not sizes:
        return fit_counts({}, pieces_of(vocabulary))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.where(F.col("h") < share[F.col("lang")] * (1 << 20))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    found = words.groupBy("lang", "word").agg(F.count("*").alias("n")).orderBy("lang", "word").toArrow()  # bounded by the sample
    counts: dict[str, dict[str, int]] = {}
    for lang_, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(lang_, {})[word] = n
    return fit_counts(counts, pieces_of(vocabulary))


class Scorer:
    """Scores texts with one model; remembers words."""

    def __init__(self, model: Model, limit: int = 120_000):
        self.model, self.limit = model, limit
        self.at: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > self.limit:
            self.at.clear()
        new = sorted(words - self.at.keys())
        while len(self.at) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if new:
            first = len(self.at)
            self.table[first : first + len(new)] = self.model.log_words(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) if self.model.languages else [] for t in texts]
        self.learn({w for ws in split for w in ws})
        langs, scores = [], []
        for ws in split:
            if not ws:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(self.at.__getitem__, ws), dtype=np.int64, count=len(ws))].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def predict(df: DataFrame, model: Model, text: str = "text", rows: int = 512) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the language's posterior probability)."""
    df, moved = make_room(df, "lang_pred", "score")
    text, spark = moved.get(text, text), df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary

    token = uuid.uuid4().hex

    def run(batches):
        scorer = resident(("scorer", token), lambda: Scorer(shared.value))
        for b in slices(batches, rows):
            langs, scores = scorer.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
