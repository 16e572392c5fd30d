"""Operator 5: toxicity by compression distance between two zstandard dictionaries.

Both dictionaries are trained by zstandard on labelled text: the ordinary one on all
windows of ordinary texts, the toxic one on what toxic texts have of their own, which
are their words whose share of the toxic texts is OWN_RATIO times their share of the
ordinary ones or more. Whole toxic texts in its place give a dictionary of ordinary
syllables, as zstandard picks by frequency (figures in the README). The toxic dictionary
goes before the ordinary one, so a window's two compressed lengths differ only where
toxic content is there to be matched.

Text is spelled out before it is compressed: every word is written at least SPELL letters
long, over and over, and each letter with its place in the word mixed in, so that
zstandard, whose matches begin at whole words then, can save more than a match costs on
a word of five letters. Every window of a text is compressed with both; how often and how
much the toxic dictionary saves goes through a logistic calibration, fitted on training
rows that the dictionaries haven't seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .quality_model import labelled_sample

#: Words in a window.
WINDOW = 16
#: Letters that a word is written with at least.
SPELL = 12
PARAMETERS = {"window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 4, "min_match": 7, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY}
#: Bytes of the dictionaries that zstandard trains; of each the content counts, without the entropy tables before it.
ORDINARY_BYTES = 32_768
TOXIC_BYTES = 8_192
CONTENT = 0.75
#: Labelled rows of each class that the fit may gather on the driver, and bytes of text of each class.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 24_000_000
#: A word is toxic texts' own if its share of them is so many times its share of ordinary texts (half a text added), and it stands in at least OWN_SHARE of them or in OWN_TEXTS.
OWN_RATIO = 30.0
OWN_SHARE = 0.02
OWN_TEXTS = 22
#: Savings of a window, in bytes, whose shares of the windows are measured; from the second on they add up.
STEPS = (2, 4, 6, 8, 10, 12, 16)
#: Ridge of the calibration.
RIDGE = 0.1
#: Score of every text where the labels don't allow a model.
UNTOLD = 0.25
#: Spelled words that a task remembers; forgetting changes no result.
REMEMBERED = 120_000


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries, and weights of the calibration, the bias first."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _compressors(model: Model) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    out = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **PARAMETERS)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
    return out[0], out[1]


def spelled(word: bytes) -> bytes:
    """The word over and over up to SPELL letters (a longer one once), each byte mixed with its place and the word's length."""
    n = len(word)
    size = max(SPELL, n)
    letters = np.frombuffer((word * (size // n + 1))[:size], np.uint8)
    return (letters ^ (np.arange(size) * 37 + n * 11).astype(np.uint8)).tobytes()


class Speller:
    """Windows of spelled words; remembers words."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}

    def word(self, w: bytes) -> bytes:
        found = self.known.get(w)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known = {}
            found = self.known[w] = spelled(w)
        return found

    def windows(self, raw: bytes) -> Iterator[bytes]:
        """All words of the text, A-Z lower-cased, in windows of WINDOW words."""
        words = C.alnum_words(raw)
        for i in range(0, len(words), WINDOW):
            yield b"".join(map(self.word, words[i : i + WINDOW]))


def features(windows: Iterator[bytes], plain: Callable, toxic: Callable) -> np.ndarray:
    """Shares of the windows that save STEPS bytes, the mean and the largest saving, and the sum of those from the second step on."""
    saved = np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows), np.int64)
    if not len(saved):
        return np.zeros(len(STEPS) + 3)
    shares = [(saved >= s).mean() for s in STEPS]
    return np.array([*shares, saved.mean(), saved.max(), math.log1p(saved[saved >= STEPS[1]].sum())])


def own_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> frozenset[bytes]:
    """Words that mark the toxic texts, see OWN_RATIO, OWN_SHARE and OWN_TEXTS."""
    held = [Counter(w for words in texts for w in set(words)) for texts in (toxic, ordinary)]
    least = min(OWN_SHARE * len(toxic), OWN_TEXTS)
    return frozenset(w for w, k in held[0].items() if k >= least and k * max(1, len(ordinary)) >= OWN_RATIO * (held[1][w] + 0.5) * len(toxic))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains; of too few samples to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-int(size * CONTENT) :]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-int(size * CONTENT) :]


def dictionaries(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary of labelled rows."""
    speller = Speller()
    cut = [[C.alnum_words(t) for t, y in rows if y == k] for k in (0, 1)]
    own = own_words(cut[1], cut[0])
    ordinary = _dictionary([w for t, y in rows if y == 0 for w in speller.windows(t)], ORDINARY_BYTES)
    toxic = [b"".join(speller.word(w) for w in words if w in own) for words in cut[1]]
    return ordinary or spelled(b"\0"), _dictionary([x for x in toxic if x], TOXIC_BYTES)


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Dictionaries from every other row of each class, calibration from the rest, so that it meets unseen texts.

    Without rows of both classes in the second half nothing can be told apart: every text has the score UNTOLD and none is rejected.
    """
    own, other = [[x for k in (0, 1) for x in [r for r in rows if r[1] == k][half::2]] for half in (0, 1)]
    plain, toxic = dictionaries(own)
    size = len(STEPS) + 3
    a, b = _compressors(Model(plain, toxic, ()))
    speller = Speller()
    x = np.array([features(speller.windows(t), a, b) for t, _ in other]).reshape(-1, size)
    y = np.array([k for _, k in other], float)
    if not len(y) or y.min() == y.max():
        return Model(plain, toxic, (math.log(UNTOLD / (1 - UNTOLD)), *[0.0] * size))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(size + 1)
    for _ in range(60):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(size + 1)
        step = np.linalg.solve(h, x.T @ (y - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(plain, toxic, (float(w[0] - (w[1:] / scale) @ mean), *(w[1:] / scale).tolist()))


def _scorer(model: Model, threshold: float) -> Callable[[], Callable[[list[bytes]], list[list]]]:
    def make() -> Callable[[list[bytes]], list[list]]:
        a, b = _compressors(model)
        bias, w, speller = model.weights[0], np.array(model.weights[1:]), Speller()

        def texts_of(texts: list[bytes]) -> list[list]:
            raw = [bias + float(features(speller.windows(t), a, b) @ w) for t in texts]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, r)))) for r in raw]
            return [scores, [int(s >= threshold) for s in scores]]

        return texts_of

    return make


def score(docs: DataFrame, model: Model, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier), predicted.

    A null text is empty and gets the score of no window. A text of any length is
    scored whole, window by window. Repeated rows give repeated results, an empty
    table none; other columns are not read.
    """
    fields = [C.double("score"), T.StructField("predicted", T.IntegerType())]
    return C.map_texts(C.text_rows(docs, id_col, text_col), _scorer(model, threshold), fields)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows of docs, at most SAMPLE_ROWS and SAMPLE_BYTES of each class."""
    return fit(labelled_sample(docs, labels, "toxic", rows=SAMPLE_ROWS, max_bytes=SAMPLE_BYTES))


def clean(docs: DataFrame, model: Model, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score ``threshold`` or more; columns unchanged, whatever their names.

    Null and empty texts have the score of no window; repeated rows stay or go together.
    """
    plain, _, back = C.shielded(docs, text_col)
    scored = C.map_texts(plain, _scorer(model, threshold), [C.double("score"), T.StructField("predicted", T.IntegerType())], tuple(plain.columns))
    return back(scored.filter("predicted = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = score(docs, trained(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (C.id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
