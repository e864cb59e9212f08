"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary; a word's probability is the sum over
all its segmentations into pieces, by the forward algorithm, and a text's the product over its words. The piece
probabilities are learned by expectation maximisation over the words of a bounded sample of texts; the vocabulary is
read from a file of byte pieces with ranks (every byte is one, so every word has a segmentation) and never copied.

Words are runs of letters (Unicode category L) and of marks (M) after them, lower-cased, with a leading space, of any length. Pieces are found by
one automaton over many words at a time. Texts that are null or have no letter are ``und`` with score 0. Rows with
equal ids are rows of their own; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from functools import cached_property, partial
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import Batches, settle, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SAMPLE = 1500  # texts of each language that are learned from, at most about
ROUNDS = 3
CELLS = 200_000  # positions of the words of a block
CACHE = 300_000
FLOOR = 1e-9  # of a piece's probability, against words of other scripts

_WORD = re.compile(r"[^\W\d_]+")


def _marks() -> str:
    """A pattern's ranges of all characters of category M."""
    found = [c for c in (*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c))[0] == "M"]
    ends = [k for k, c in enumerate(found) if k + 1 == len(found) or found[k + 1] != c + 1]
    return "".join(f"{chr(found[a])}-{chr(found[b])}" for a, b in zip([0, *(k + 1 for k in ends)], ends, strict=False))


_MARK = re.compile(f"[{_marks()}]")
_MARKED = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """piece -> rank, without pieces that no word can hold; lower-cased words need no upper-case ASCII either."""
    out: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            if len(piece) == 1 or piece == piece.lower() and b" " not in piece[1:] and not re.search(rb"[\x00-\x1f!-@\[-`{-\x7f]", piece):
                out[piece] = len(out)
    return out


class Pieces(dict):
    """piece -> number, with an automaton that finds all of them; it is built where it is needed and not sent."""

    @cached_property
    def scan(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, k in self.items():
            out.add_word(piece.decode("latin-1"), k << 16 | len(piece))
        out.make_automaton()
        return out

    def __reduce__(self):
        return Pieces, (dict(self),)


class Lattice:
    """All pieces of all positions of some words, a block of words of like length at a time."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(self.size.max(initial=0))
        starts = np.concatenate([[0], np.cumsum(self.size + 1)])  # words are parted by a sign that no piece holds
        found = np.fromiter(chain.from_iterable(pieces.scan.iter("\u0100".join(w.decode("latin-1") for w in words))), np.int64).reshape(-1, 2)
        row = np.searchsorted(starts, found[:, 0], "right") - 1
        end, length, piece = found[:, 0] + 1 - starts[row], found[:, 1] & 0xFFFF, found[:, 1] >> 16
        order = np.argsort((end * (int(length.max(initial=0)) + 1) + length) * len(words) + row)
        row, end, length, piece = row[order], end[order], length[order], piece[order]
        cuts = [0, *(np.flatnonzero((np.diff(end) != 0) | (np.diff(length) != 0)) + 1).tolist(), len(end)] if len(end) else [0]
        self.steps = [(int(end[a]), int(length[a]), row[a:b], piece[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # by end

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha (word, position, language), each position divided by a scale, and the logs of the scales summed."""
        alpha = np.zeros((len(self.size), self.width + 1, p.shape[1]))
        alpha[:, 0] = 1
        scale = np.zeros((len(self.size), self.width + 1, p.shape[1]))
        last = 0
        for end, length, rows, ids in self.steps:
            if end != last:
                self._rescale(alpha, scale, last)
                last = end
                scale[:, end] = scale[:, end - 1]
            alpha[rows, end] += alpha[rows, end - length] * np.exp(scale[rows, end - length] - scale[rows, end]) * p[ids]
        self._rescale(alpha, scale, last)
        return alpha, scale

    @staticmethod
    def _rescale(alpha, scale, at: int) -> None:
        if at:
            some = alpha[:, at] > 0
            scale[:, at] += np.log(np.where(some, alpha[:, at], 1))
            alpha[:, at] = some

    def log_p(self, p: np.ndarray) -> np.ndarray:
        """log probability of each word in each language."""
        if not len(self.size):
            return np.zeros((0, p.shape[1]))
        _, scale = self.forward(p)
        return scale[np.arange(len(self.size)), self.size]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, for words that occur ``counts`` (word, language) times."""
        alpha, scale = self.forward(p)
        whole = scale[np.arange(len(self.size)), self.size]
        beta = np.zeros_like(alpha)  # scaled so that alpha-scale + log(beta) is the log of all segmentations over whole
        beta[np.arange(len(self.size)), self.size] = 1
        out = np.zeros_like(p)
        for end, length, rows, ids in reversed(self.steps):
            share = np.exp(scale[rows, end - length] - scale[rows, end]) * p[ids] * beta[rows, end]
            beta[rows, end - length] += share
            np.add.at(out, ids, share * counts[rows])
        del whole
        return out


def _blocks(words: list[bytes]):
    """Indexes of the words, those of like length together, in blocks of about CELLS positions."""
    order, block, widest = sorted(range(len(words)), key=lambda i: len(words[i])), [], 0
    for i in order:
        widest = len(words[i]) + 1
        if block and (len(block) + 1) * widest > CELLS:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return _WORD.findall(text)
    marked = _MARK.search(text)
    found = (_MARKED if marked else _WORD).findall(text)
    if not all(map(str.isalpha, found)):  # signs such as "\u00b2" count as digits or letters by the pattern alone
        kept = (lambda c: c.isalpha() or _MARK.match(c)) if marked else str.isalpha
        found = [w for run in found for w in "".join(c if kept(c) else " " for c in run).split()]
    return found


def _counted(batches: Batches) -> Batches:
    for batch in batches:
        count = Counter()
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                count[word, lang] += n
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in count], pa.string()), pa.array([k for _, k in count], pa.string()), pa.array(count.values(), pa.int64())], ["word", "lang", "n"])


def _expected(batches: Batches, model) -> Batches:
    """Rows (piece, lang, n) of expected uses, summed for each batch."""
    pieces, p, langs = model.value.pieces, model.value.p, model.value.langs
    at = {x: k for k, x in enumerate(langs)}
    for batch in batches:
        rows: dict[bytes, np.ndarray] = {}
        for word, lang, n in zip(*(batch.column(c).to_pylist() for c in ("word", "lang", "n")), strict=True):
            rows.setdefault(b" " + word.encode(), np.zeros(len(langs)))[at[lang]] += n
        words, total = list(rows), np.zeros_like(p)
        for block in _blocks(words):
            some = [words[i] for i in block]
            total += Lattice(pieces, some).expected(p, np.stack([rows[w] for w in some]))
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])


class Model:
    def __init__(self, pieces: Pieces, langs: list[str], p: np.ndarray):
        self.pieces, self.langs, self.p = pieces, langs, p


def learn(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each value of lang in ``docs`` (doc_id, text, lang); rows without lang are left out.

    Each round is a job over the sample's word counts; the driver only gets sums by piece and language.
    """
    pieces = Pieces(read_vocabulary(vocabulary))
    sizes = {r.lang: r.n for r in docs.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    rate = F.lit(0.0)
    for lang in langs:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, most / sizes[lang]))).otherwise(rate)
    chosen = docs.where(F.col("lang").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < rate * 1_000_000)).select("text", "lang")
    counts = settle(chosen.mapInArrow(_counted, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    length = np.zeros((len(pieces), 1))
    for piece, k in pieces.items():
        length[k] = len(piece)
    p = np.repeat(np.exp(length - length.max()) / np.exp(length - length.max()).sum(), len(langs), 1)
    for _ in range(rounds if langs else 0):
        sent = docs.sparkSession.sparkContext.broadcast(Model(pieces, langs, p))
        got = counts.mapInArrow(partial(_expected, model=sent), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        sent.unpersist()
        uses = np.zeros_like(p)
        uses[got["piece"], got["lang"]] = got["n"]
        p = (uses + 0.01) / (uses + 0.01).sum(0)
        p = np.maximum(p, FLOOR)
    return Model(pieces, langs, p)


def _predicted(batches: Batches, model) -> Batches:
    model = model.value
    cache: dict[str, int] = {}
    known = np.zeros((0, len(model.langs)))
    for batch in slices(batches):
        texts = [words_of(t) for t in batch.column("text").to_pylist()]
        if len(cache) > CACHE:
            cache, known = {}, known[:0]
        new = list({w for t in texts for w in t} - cache.keys())
        if new and model.langs:
            raw = [b" " + w.encode() for w in new]
            rows = np.zeros((len(new), len(model.langs)))
            for block in _blocks(raw):
                rows[block] = Lattice(model.pieces, [raw[i] for i in block]).log_p(model.p)
            cache.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            known = np.concatenate([known, rows])
        langs, scores = [], []
        for t in texts:
            if not t or not model.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = known[np.fromiter(map(cache.__getitem__, t), np.int64, len(t))].sum(0)
            best = int(total.argmax())
            langs.append(model.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (posterior of that language, languages equally likely before) for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary times the languages
    return docs.select("doc_id", "text").mapInArrow(partial(_predicted, model=sent), f"doc_id {kind}, lang_pred string, score double")
