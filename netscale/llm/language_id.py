"""Language identification by unigram pieces, with the likelihood of a word summed over all its segmentations.

The vocabulary is fixed: the pieces of a public sentencepiece model. Each language has its own probability of each piece, learnt by
expectation-maximisation over the words of a bounded sample of labelled texts. A text's likelihood is the product of its words', and a
word's, however long, is the sum over all its segmentations, by the forward algorithm over the pieces that stand in it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netscale.llm.common import blocks, extended, frugal, text_of, written

#: Probability of a character that isn't a piece; words whose likelihoods a worker remembers, characters that are scored together, and bytes of
#: texts that are split at a time.
UNKNOWN, CACHED, TOGETHER, TEXTS = 1e-7, 100_000, 100_000, 500_000
#: Positions after which forward sums are brought back to 1, and log2 of the slots of the piece table.
SCALED, SLOTS = 16, 20
#: Buckets of a language's hashes: the task that ranks a language reads at most so many times the texts that are learnt from.
BUCKETS = 64
#: A score tells of a stretch of so many characters; a text is atypical of its language this many deviations below the mean likelihood.
STRETCH, ATYPICAL = 20, 12.0
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary, and where its pieces stand in words."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)))
        self.names = sorted({s for i in normal if (s := p.id_to_piece(i))})
        self.size, self.longest = len(self.names), max(map(len, self.names), default=0)
        number = {s: i for i, s in enumerate(self.names)}
        starts = sorted({s[:n] for s in self.names for n in range(1, len(s) + 1)})  # a piece or the beginning of one
        self.piece = np.array([number.get(s, self.size) for s in starts] + [self.size], np.int64)
        self.hashed = np.array([self._hash(s) for s in starts], np.uint64)
        # two tables of slots; what collides in the first goes to the second, and the few that collide there too are looked up by bisection
        none = len(starts)
        self.slots = np.full((2, 1 << SLOTS), none, np.int32)
        left = np.arange(none)
        for way in range(2):
            slot = self._slot(self.hashed[left], way)
            self.slots[way][slot[::-1]] = left[::-1]
            left = left[self.slots[way][slot] != left]
        self.rest = left[np.argsort(self.hashed[left])]
        self.hashed = np.r_[self.hashed, np.uint64(0)]

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    @staticmethod
    def _slot(h: np.ndarray, way: int) -> np.ndarray:
        return ((h * np.uint64((0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)[way])) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash among the beginnings of pieces, or their count."""
        none = len(self.piece) - 1
        out = np.full(len(h), none, np.int64)
        for way in range(2):
            at = self.slots[way][self._slot(h, way)]
            out = np.where((out == none) & (self.hashed[at] == h) & (at < none), at, out)
        if len(self.rest):
            at = self.rest[np.minimum(np.searchsorted(self.hashed[self.rest], h), len(self.rest) - 1)]
            out = np.where((out == none) & (self.hashed[at] == h), at, out)
        return out

    def spots(self, words: list[str]) -> Spots:
        """Where pieces stand in words, from each word's mark on."""
        marked = [f"▁{w}" for w in words]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        width = np.array([len(w) for w in marked], np.int64)
        base = np.r_[0, np.cumsum(width)]
        end = np.repeat(base[1:], width)
        active, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        found = []
        for n in range(1, self.longest + 1):
            inside = active + n <= end[active]
            active, h = active[inside], h[inside]
            if not len(active):
                break
            h = h * _BASE + code[active + n - 1]
            begins = self._find(h)
            piece = self.piece[begins]
            if n == 1:
                found.append((active, n, piece))  # each character is a step, a piece or not
            else:
                some = piece < self.size
                found.append((active[some], n, piece[some]))
            goes = begins < len(self.piece) - 1
            active, h = active[goes], h[goes]
        start = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        length = np.concatenate([np.full(len(f[0]), f[1]) for f in found]) if found else np.zeros(0, np.int64)
        piece = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), width)
        return Spots(base, width, word, start, length, piece)


@dataclass
class Spots:
    """Pieces (start, length, piece) in words that lie end to end: word i is characters base[i] to base[i + 1]. A sum of word i up to its
    position j has the place base[i] + i + j."""

    base: np.ndarray
    width: np.ndarray
    word: np.ndarray
    start: np.ndarray
    length: np.ndarray
    piece: np.ndarray

    def groups(self, key: np.ndarray) -> Iterator[np.ndarray]:
        """Spots of equal key and length, by ascending key; so no two of them lead to the same place."""
        both = key * (int(self.length.max(initial=0)) + 1) + self.length
        order = np.argsort(both, kind="stable")
        ends = np.flatnonzero(np.diff(both[order])) + 1
        yield from (own for own in np.split(order, ends) if len(own))

    def forward(self, p: np.ndarray, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """[place, language] sums over all segmentations up to each place, and the log of what they were divided by at the end of each word.

        p: [piece, language], with a row of zeros for no piece. shift: [place, language] zeros, which become the log of what the sum of each
        place was divided by.
        """
        n, languages = len(self.width), p.shape[1]
        first = self.base[:-1] + np.arange(n)
        total, logs = np.zeros((int(self.base[-1]) + n, languages)), np.zeros((n, languages))
        total[first] = 1
        word = self.word[self.start]
        source = self.start + word
        upto = self.start - self.base[word] + self.length
        long = np.flatnonzero(self.width > SCALED)
        now = 0
        for own in self.groups(upto):
            j, k = int(upto[own[0]]), int(self.length[own[0]])
            if j > now and j > 1 and (j - 1) % SCALED == 0 and len(long):  # all sums up to j - 1 are whole
                long = self._rescale(total, logs, first, long, j - 1, shift)
            now = j
            step = p[self.piece[own]]
            if k == 1:
                step = np.maximum(step, UNKNOWN)
            total[source[own] + k] += total[source[own]] * step
        if shift is not None:  # what comes after the last division
            place = np.arange(len(total)) - np.repeat(first, self.width + 1)
            last = np.repeat(np.maximum(self.width - 1, 0) // SCALED * SCALED, self.width + 1)
            late = place > last
            shift[late] = np.repeat(logs, self.width + 1, axis=0)[late]
        return total, logs

    def _rescale(self, total: np.ndarray, logs: np.ndarray, first: np.ndarray, long: np.ndarray, j: int, shift: np.ndarray | None = None) -> np.ndarray:
        """Brings the sums of words that go on beyond position j back to 1; later steps reach back less than j places of these."""
        long = long[self.width[long] > j]
        if len(long):
            back = int(self.length.max())
            at = first[long][:, None] + np.maximum(j - np.arange(back), 0)
            most = total[at].max(axis=1)
            low = np.unique(at)
            owner = np.searchsorted(first[long], low, "right") - 1
            total[low] /= most[owner]
            if shift is not None:
                shift[first[long][:, None] + j - np.arange(SCALED)] = logs[long][:, None]
            logs[long] += np.log(most)
            if shift is not None:
                shift[low] = logs[long[owner]]
        return long

    def likelihoods(self, p: np.ndarray) -> np.ndarray:
        """[word, language]: log of the sum over all segmentations of the word."""
        total, logs = self.forward(p)
        return np.log(total[self.base[1:] + np.arange(len(self.width))]) + logs

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words, of any length, that are seen `counts` times. p: [piece, 1]."""
        shift = np.zeros((int(self.base[-1]) + len(self.width), 1))
        total, _ = self.forward(p, shift)
        last = self.base[1:] + np.arange(len(self.width))
        # sums from each place on, over the word's whole sum and times what the place's forward sum was divided by
        after = np.zeros_like(total)
        after[last] = 1 / total[last]
        word = self.word[self.start]
        source = self.start + word
        for own in self.groups(self.width[word] - (self.start - self.base[word])):
            k = int(self.length[own[0]])
            step = p[self.piece[own]]
            if k == 1:
                step = np.maximum(step, UNKNOWN)
            a = source[own]
            after[a] += after[a + k] * step * np.exp(shift[a] - shift[a + k])
        b = source + self.length
        whole = p[self.piece, 0] * total[source, 0] * after[b, 0] * np.exp(shift[source, 0] - shift[b, 0]) * counts[word]
        return np.bincount(self.piece, whole, len(p))


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces(path)


def in_parts(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words of like lengths, about TOGETHER characters at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    i = 0
    while i < len(order):
        j = i + max(1, TOGETHER // (len(words[order[i]]) + 1))
        yield order[i:j]
        i = j


def fit_pieces(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Piece probabilities of a language by expectation-maximisation from uniform ones over whole words; the last one, of no piece, is 0."""
    p = np.r_[np.full(pieces.size, 1 / pieces.size), 0.0][:, None]
    for _ in range(rounds):
        seen = np.zeros(len(p))
        for part in in_parts(words):
            seen += pieces.spots([words[i] for i in part]).expected(p, counts[part].astype(float))
        seen = seen[: pieces.size]
        p[: pieces.size, 0] = (seen + 0.05) / (seen.sum() + 0.05 * pieces.size)
    return p[:, 0]


@dataclass
class Model:
    """Languages; [piece, language] probabilities; and of each language's likelihood a character its mean, its variance between texts, and
    its variance within texts times their characters."""

    languages: list[str]
    p: np.ndarray
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray


class Scorer:
    """Log-likelihoods of words and texts in all languages."""

    def __init__(self, path: str, p: np.ndarray):
        self.pieces, self.p = pieces_of(path), p
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, p.shape[1]))

    def of_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.p.shape[1]))
        for part in in_parts(words):
            out[part] = self.pieces.spots([words[i] for i in part]).likelihoods(self.p)
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language], and each text's characters with a mark for each word."""
        if len(self.row) > CACHED:
            self.row.clear()
            self.scores = self.scores[:0]
        split = [t.split() for t in texts]
        if new := sorted({w for words in split for w in words if w not in self.row}):
            self.row.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.of_words(new)])
        get, out = self.row.__getitem__, np.zeros((len(texts), self.p.shape[1]))
        for i, words in enumerate(split):
            out[i] = self.scores[list(map(get, words))].sum(axis=0)
        return out, np.array([sum(map(len, words)) + len(words) for words in split])


def certainty(model: Model, score: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each text, and how certain it is, from likelihoods [text, language] and lengths: its probability by a stretch of at
    most STRETCH characters, against the other languages and against none of them, which is as likely as an atypical text of the best one."""
    best = score.argmax(axis=1)
    own = score[np.arange(len(score)), best]
    least = n * (model.mean[best] - ATYPICAL * np.sqrt(model.between[best] + model.within[best] / n))
    share = np.minimum(1.0, STRETCH / n)
    return best, 1 / (np.exp((score - own[:, None]) * share[:, None]).sum(axis=1) + np.exp(np.minimum((least - own) * share, 700)))


def stretches(text: str, most_bytes: int) -> Iterator[str]:
    """The words of a text in stretches of at most most_bytes bytes; a longer word is one of its own."""
    held, size = [], 0
    for word in text.split():
        n = len(word.encode()) + 1
        if held and size + n > most_bytes + 1:
            yield " ".join(held)
            held, size = [], 0
        held.append(word)
        size += n
    if held:
        yield " ".join(held)


def _stretched(rows: int, most_bytes: int):
    """(lang, part, text): the first `rows` stretches of each text."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part, stretch in enumerate(itertools.islice(stretches(text, most_bytes), rows)):
                    yield pa.record_batch([pa.array([lang]), pa.array([part], pa.int32()), pa.array([stretch])], ["lang", "part", "text"])

    return run


def fit(docs: DataFrame, vocabulary: str, held_in: Column, text: str = "text", lang: str = "lang", rows: int = 100, most_bytes: int = 200_000) -> Model:
    """What is learnt from at most `rows` distinct labelled texts a language, those of the smallest hashes.

    held_in: a condition on rows that may be learnt from (null: not). Rows with a null language or text don't count; rows that repeat count
    once, so that copies of one text leave room for others. A text of more than most_bytes comes in stretches of whole words, of at most so
    many bytes (or one longer word); the second ones count after the first ones of all texts, and so on. So each language with labelled
    words is learnt. A task fits one language, of at most rows * most_bytes; the driver gets its piece probabilities and moments. An empty
    table gives a model without languages.
    """
    plain = docs.where(held_in & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    long = F.octet_length("text") > most_bytes
    stretched = written(plain.where(long).mapInArrow(_stretched(rows, most_bytes), "lang string, part int, text string"), "stretches")
    parts = plain.where(~long).select("lang", F.lit(0).alias("part"), "text").unionByName(stretched).where(F.col("text").rlike(r"\S"))
    parts = parts.withColumn("h", F.xxhash64("text"))
    chosen = parts.select("lang", "part", "h").distinct()  # no texts
    for some in ([F.pmod("h", F.lit(BUCKETS))], []):  # a language's first ones are among the first ones of its buckets
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("lang", *some).orderBy("part", "h"))).where(F.col("n") <= rows)
    ranked = parts.join(F.broadcast(chosen), ["lang", "part", "h"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    learnt = ranked.groupBy("lang").applyInPandas(_fitted(vocabulary), "lang string, p binary, mean double, between double, within double")
    found = sorted(learnt.collect())
    p = np.stack([np.frombuffer(r.p) for r in found], 1) if found else np.zeros((pieces_of(vocabulary).size + 1, 0))
    return Model([r.lang for r in found], p, *(np.array([r[c] for r in found], float) for c in ("mean", "between", "within")))


def _fitted(vocabulary: str):
    """What the rows of one language teach; no row without words."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        split = [words for text in frame.sort_values("n")["text"] if (words := text.split())]
        if not split:
            return pd.DataFrame({c: [] for c in ("lang", "p", "mean", "between", "within")})
        pieces = pieces_of(vocabulary)
        words, number = np.unique(np.array([w for x in split for w in x], object), return_inverse=True)
        p = fit_pieces(pieces, words.tolist(), np.bincount(number))
        score = Scorer(vocabulary, p[:, None]).of_words(words.tolist())[number, 0]
        size = np.array([len(w) + 1 for x in split for w in x])
        of = np.repeat(np.arange(len(split)), [len(x) for x in split])
        total, n = np.bincount(of, score), np.bincount(of, size)
        mean = score.sum() / size.sum()
        between = np.average((total / n - mean) ** 2, weights=n)
        within = ((score - mean * size) ** 2).sum() / size.sum()
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "p": [p.tobytes()], "mean": mean, "between": between, "within": within})

    return run


def identify(docs: DataFrame, vocabulary: str, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (how certain it is, 0 to 1; see certainty()), which replace columns of these names.

    Prediction reads the whole text and nothing else. A null text, a text without a letter, and any text if no language was learnt get
    `und` and 0.0. Ties go to the language that sorts first. Rows that repeat get the same answer; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: the vocabulary times the languages
    schema = extended(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    names = schema.names

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scorer = Scorer(vocabulary, model.p)
        for batch in batches:
            for block in blocks(batch, text, TEXTS):
                texts = [t or "" for t in block.column(text).to_pylist()]
                said, sure = ["und"] * len(texts), np.zeros(len(texts))
                some = [i for i, t in enumerate(texts) if model.languages and any(map(str.isalpha, t))]
                if some:
                    best, certain = certainty(model, *scorer.of([texts[i] for i in some]))
                    for i, k, s in zip(some, best.tolist(), certain.tolist(), strict=True):
                        said[i], sure[i] = model.languages[k], s
                values = {f: block.column(f) for f in names if f in block.schema.names} | {"lang_pred": pa.array(said), "score": pa.array(sure)}
                yield pa.record_batch([values[f] for f in names], names)

    return docs.mapInArrow(run, schema)
