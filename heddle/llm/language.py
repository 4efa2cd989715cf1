"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams (1- to
3-grams of the whole text) predicts that bit: the log odds of the languages whose codeword
has the bit against the others.  It is linear in n-gram frequencies, so all it needs are sums
over the labelled texts of each language, which Spark adds up over all of them.

Decoding takes the codeword of least loss, bits weighted by how far apart their classifiers
hold the languages, and flags texts whose two nearest codewords are close.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.bytewords import LOWER, slices, utf8
from heddle.llm.shared import small_batches

BUCKETS = 4096
BITS = 31
CLOSE = 0.05
MOST_LANGUAGES = 1000
#: A text whose choice is ambiguous is rejected below this score.
LEAST_SCORE = 0.5
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text: the frequencies of its hashed n-grams.  A long text is read in pieces,
    which take bounded memory."""
    raw, at = utf8(texts)
    out = np.zeros((len(at) - 1, BUCKETS), np.float32)
    for d in range(len(at) - 1):
        b = LOWER[raw[at[d] : at[d + 1]]]
        if not len(b):
            continue
        b = np.concatenate(([32], b, [32])).astype(np.uint8)
        count = np.zeros(BUCKETS, np.int64)
        for a in range(0, len(b), _PIECE):
            # the next piece's first two bytes belong to n-grams that begin in this one
            piece = b[a : a + _PIECE + 2].astype(np.uint32)
            own = min(_PIECE, len(b) - a)
            for n in (1, 2, 3):
                h = np.zeros(max(0, min(own, len(piece) - n + 1)), np.uint32)
                for i in range(n):
                    h ^= piece[i : i + len(h)] * _ODD[n - 1][i]
                count += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        out[d] = count / count.sum()
    return out


_PIECE = 1 << 18
_ODD = [np.array(x, np.uint32) for x in ((0x2545F491,), (0x27D4EB2F, 0x165667B1), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))]


def has_letter(texts: pa.Array) -> np.ndarray:
    raw, at = utf8(texts)
    seen = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    out = seen[at[1:]] > seen[at[:-1]]
    for d in np.flatnonzero(~out & (np.diff(at) > 0)):
        text = raw[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")
        out[d] = any(unicodedata.category(c)[0] == "L" for c in text)
    return out


@dataclass
class Model:
    names: list[str]  #: languages
    codes: np.ndarray  #: languages x bits, of -1 and 1
    weights: np.ndarray  #: buckets + 1 x bits; the last is the bias
    trust: np.ndarray  #: of each bit, adding up to 1

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, its probability, and whether the choice is ambiguous."""
        agree = margins[:, None, :] * self.codes[None]
        loss = (np.maximum(0, 1 - agree) * self.trust).sum(2)
        best = loss.argmin(1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        top = np.sort(loss, 1)
        unsure = top[:, 1] - top[:, 0] < CLOSE if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, p[np.arange(len(p)), best], unsure


def codewords(n: int, bits: int = BITS, seed: int = 3) -> np.ndarray:
    """``n`` codewords, all different and far apart: one after the other the best of many random
    ones, and without constant bits where there are two or more.  More bits than ``bits`` are
    taken if so many languages need them."""
    bits = max(bits, 3 * int(np.ceil(np.log2(max(n, 2)))) + 7)
    rng = np.random.default_rng(seed)
    out = rng.choice(np.array([-1.0, 1.0]), (1, bits))
    while len(out) < n:
        some = rng.choice(np.array([-1.0, 1.0]), (256, bits))
        far = ((bits - some @ out.T) / 2).min(1)
        if len(out) == 1:
            far = -np.abs(far - bits / 2)  # two words that differ everywhere say everything twice
            some = np.vstack([some, -out])
            far = np.append(far, 1 if n == 2 else -bits)
        best = int(far.argmax())
        if not (out == some[best]).all(1).any():
            out = np.vstack([out, some[best]])
    flat = np.flatnonzero(np.abs(out.sum(0)) == n) if n > 1 else []
    for i, bit in enumerate(flat):
        out[i % n, bit] *= -1
    if len(np.unique(out, axis=0)) < n:
        return codewords(n, bits + 2, seed + 1)
    return out


def fit(sums: np.ndarray, texts: np.ndarray, names: list[str]) -> Model:
    """``sums``: for each language the sum of its texts' frequencies, ``texts`` their number."""
    held = (sums / texts[:, None] + 1e-6) / (1 + 1e-6 * BUCKETS)
    codes = codewords(len(names))
    up, down = (codes > 0).astype(float), (codes < 0).astype(float)
    mean = lambda side: (held.T @ side + 1e-9) / (side.sum(0) + 1e-9 * BUCKETS)
    weights = np.log(mean(up) / mean(down)) if len(names) > 1 else held.T @ codes
    own = held @ weights
    # half way between the two sides is zero; a language's own margin is about one
    top = np.where(codes > 0, own, np.inf).min(0)
    low = np.where(codes < 0, own, -np.inf).max(0)
    bias = np.where(np.isfinite(top) & np.isfinite(low), -(top + low) / 2, 0.0)
    scale = np.maximum(np.abs(own + bias).mean(0), 1e-9)
    trust = np.maximum(((own + bias) * codes / scale).min(0), 1e-3)
    return Model(names, codes, (np.vstack([weights, bias]) / scale).astype(np.float32), trust / trust.sum())


def train(labelled: DataFrame) -> Model | None:
    """Fit on all of ``labelled`` (text, lang), whole texts, each of equal weight in its language.
    Null languages, null texts and texts without letters teach nothing; without rows there is
    no model.  The driver gets one number for each language and bucket, so more than
    ``MOST_LANGUAGES`` labels are an error."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels: are they languages?")
    parts = rows.mapInArrow(_sums, "lang string, bucket int, held double, texts long")
    got = parts.groupBy("lang", "bucket").agg(F.sum("held").alias("held"), F.sum("texts").alias("texts")).toPandas()
    names = sorted(got["lang"].unique())
    if not names:
        return None
    at = {n: i for i, n in enumerate(names)}
    sums, texts = np.zeros((len(names), BUCKETS)), np.zeros(len(names))
    row = got["lang"].map(at).to_numpy()
    told = got["bucket"].to_numpy() < 0
    sums[row[~told], got["bucket"].to_numpy()[~told]] = got["held"].to_numpy()[~told]
    texts[row[told]] = got["texts"].to_numpy()[told]
    # sums depend on the order of their parts in the last digits
    return fit(np.round(sums / texts[:, None], 9), np.ones(len(names)), names)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums; bucket -1 holds the number of texts."""
    held: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            part = part.filter(pa.array(has_letter(part.column("text"))))
            for a in range(0, part.num_rows, _ROWS):
                some = part.slice(a, _ROWS)
                x, lang = features(some.column("text")), np.array(some.column("lang").to_pylist(), object)
                for n in set(lang.tolist()):
                    held[n] = held.get(n, 0) + x[lang == n].sum(0, dtype=np.float64)
                    texts[n] = texts.get(n, 0) + int((lang == n).sum())
    for n, x in held.items():
        at = np.flatnonzero(x)
        none = np.zeros(len(at) + 1, np.int64)
        none[-1] = texts[n]
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(none), pa.string()), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(x[at], 0.0)), pa.array(none)], ["lang", "bucket", "held", "texts"])


#: Texts whose features are held at once.
_ROWS = 256


def _predict(sent, names: list[str], made: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value) if sent.value else None
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                lang, score, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                letter = has_letter(part.column("text"))
                known = np.flatnonzero(letter) if model else np.zeros(0, np.int64)
                for some in np.array_split(known, max(1, -(-len(known) // _ROWS))):
                    if len(some):
                        best, p, close = model.decode(model.margins(features(part.column("text").take(pa.array(some)))))
                        score[some], unsure[some] = p, close
                        for i, b in zip(some.tolist(), best.tolist(), strict=True):
                            lang[i] = model.names[b]
                rest = [part.column(c) for c in names]
                told = [pa.array(lang), pa.array(score), pa.array(unsure), pa.array(letter)][: len(made)]
                yield pa.RecordBatch.from_arrays([*rest, *told], [*names, *made])

    return run


def identify(docs: DataFrame, model: Model | None, keep: list[str], made: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"), letter: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those named in ``made``: the language, a score (0 to
    1) and whether it is ambiguous, from the text alone; ``letter`` names a further column: whether
    the text has a letter.  Null texts and texts without a letter are ``und`` with score 0, and
    so is everything if there is no model.  Very long texts are read in pieces."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.codes, model.weights, model.trust) if model else None)
    read = docs.select(*keep, *([] if "text" in keep else ["text"]))
    names = [*made, *([letter] if letter else [])]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    more = "".join(f", {n} {k}" for n, k in zip(names[1:], ("double", "boolean", "boolean"), strict=False))
    return read.mapInArrow(_predict(sent, keep, names), f"{kinds}{names[0]} string{more}")


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: rows that nothing is learned from."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    return docs.withColumn("held_out", fold == 2)


def predict_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous."""
    split = held_out(docs)
    model = train(split.filter(~F.col("held_out")).select("text", "lang"))
    return identify(split.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, in its columns, whose text is in a language, with the predicted one
    as ``lang``.

    Texts that are null or have no letter go, and those whose choice is ambiguous with a score
    below ``least_score``.  Where there is no labelled row to learn from, nothing can be told,
    and rows with a letter stay as they are."""
    model = train(held_out(docs).filter(~F.col("held_out")).select("text", "lang"))
    made = tuple(_free(docs, n) for n in ("_lang_pred", "_score", "_ambiguous", "_letter"))
    named = identify(docs, model, docs.columns, made[:3], letter=made[3])
    lang, score, unsure, letter = (F.col(m) for m in made)
    told = letter & ~(unsure & (score < least_score)) if model else letter
    kept = named.filter(told)
    return kept.select(*[(lang if model else F.col(c)).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
