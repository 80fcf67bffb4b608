"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over them, the strongest answer of each filter in a window is kept
(max pooling), and a softmax over these names the language. The network is trained in numpy, by Adam on cross-entropy, on
windows of a bounded sample of labelled texts. It is applied to all windows of all texts: a text of n bytes is covered by
windows of ``WINDOW`` bytes that overlap by one byte less than the widest filter, so that no run of bytes that a filter can see is cut. The
windows' distributions are averaged by the bytes that each adds.

Defined results: a text that is null or has no letter gets ``und`` and the score 0, as does every text if nothing is learned
(no labelled text with a letter). Copies of a labelled text count once. A to Z are lower-cased, digits count alike, ASCII controls as spaces. Only text is read for a
prediction. Repeated rows are predicted each. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.frames import crc_bucket, join_groups, materialize, slices, text_bytes

WINDOW = 192
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 24, 6
#: Labelled rows that the network is fitted on, and windows of each; both bound what reaches the driver.
FIT_ROWS, FIT_WINDOWS = 20_000, 3
EPOCHS, BATCH, RATE = 4, 64, 4e-3
UNKNOWN = "und"

_WIDEST = max(WIDTHS)
_STRIDE = WINDOW - _WIDEST + 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x30:0x3A] = 0x30
_FOLD[:0x20] = _FOLD[0x7F] = 0x20


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of all texts begin (byte positions), and the text of each."""
    size = np.diff(at)
    count = np.where(size > 0, np.maximum(-(-(size - _WIDEST + 1) // _STRIDE), 1), 0)
    row = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return at[:-1][row] + inner * _STRIDE, row


def cut_windows(data: np.ndarray, at: np.ndarray, begin: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The folded bytes of windows; what lies beyond a text's end is filled with spaces."""
    place = begin[:, None] + np.arange(WINDOW)
    inside = place < at[1:][row][:, None]
    return np.where(inside, _FOLD[data[np.minimum(place, max(len(data) - 1, 0))]], np.uint8(0x20))


@dataclass
class Network:
    """Embedding (256, e), filters over runs of the widest width as one matrix (widest * e, f), and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def _runs(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, widest * e): the embedded bytes from each place on; beyond the end stand spaces."""
        padded = np.concatenate((x, np.full((len(x), _WIDEST - 1), 0x20, np.uint8)), 1)
        looked = self.embedding[padded]
        return np.concatenate([looked[:, k : k + WINDOW] for k in range(_WIDEST)], 2)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's strongest answer in each window, and all answers."""
        runs = self._runs(x)
        answers = (runs.reshape(-1, runs.shape[2]) @ self.filters).reshape(len(x), WINDOW, -1)
        return np.maximum(answers.max(1) + self.bias, 0), answers

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Distributions over the languages for windows (n, WINDOW)."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), 64):  # so few windows at a time stay in cache
            out[i : i + 64] = softmax(self.pooled(x[i : i + 64])[0] @ self.weights + self.offset)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _mask() -> np.ndarray:
    """Which entries of the filter matrix are used: a filter of width w sees w bytes."""
    seen = np.repeat(np.array(WIDTHS), FILTERS)
    return (np.repeat(np.arange(_WIDEST), EMBEDDING)[:, None] < seen).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 11) -> Network:
    """The network for windows ``x`` (n, WINDOW) of languages ``y``; rarer languages' windows weigh more, so that all count alike."""
    rng = np.random.default_rng(seed)
    f, mask = FILTERS * len(WIDTHS), _mask()
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(f, np.float32),
        rng.normal(0, 0.1, (f, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    share = np.bincount(y, minlength=len(languages)) / max(len(y), 1)
    weight = (1 / np.maximum(share, 1e-9) ** 0.5)[y].astype(np.float32)
    weight /= weight.mean() if len(weight) else 1
    names = ("embedding", "filters", "bias", "weights", "offset")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    epochs = max(EPOCHS, min(40, -(-1500 * BATCH // max(len(x), 1))))  # small samples are gone through more often
    total, step = epochs * -(-len(x) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            on = order[i : i + BATCH]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for n, g in zip(names, _gradients(net, x[on], y[on], weight[on], mask), strict=True):
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                getattr(net, n)[...] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(x)
    pooled, answers = net.pooled(x)
    slope = softmax(pooled @ net.weights + net.offset)
    slope[np.arange(n), y] -= 1
    slope *= weight[:, None] / n
    back = (slope @ net.weights.T) * (pooled > 0)
    at = answers.argmax(1)  # only a filter's strongest place learns
    padded = np.concatenate((x, np.full((n, _WIDEST - 1), 0x20, np.uint8)), 1)
    seen = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(_WIDEST)]  # (n, f, widest)
    runs = net.embedding[seen].reshape(n, -1, _WIDEST * EMBEDDING)
    filters = np.einsum("nfe,nf->ef", runs, back, optimize=True) * mask
    slopes = (back[:, :, None] * net.filters.T).reshape(-1, EMBEDDING)
    embedding = np.stack([np.bincount(seen.ravel(), slopes[:, k], 256) for k in range(EMBEDDING)], 1).astype(np.float32)
    return embedding, filters, back.sum(0), pooled.T @ slope, slope.sum(0)


def _sampled_windows(seed: int):
    """Labelled texts -> FIT_WINDOWS windows of each, at places drawn from the text itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                data, at = text_bytes(piece.column("text"))
                row = np.repeat(np.arange(piece.num_rows), FIT_WINDOWS)
                spare = np.maximum(np.diff(at) - WINDOW, 0)[row]
                salt = np.tile(np.arange(FIT_WINDOWS, dtype=np.uint64), piece.num_rows)
                draw = (np.asarray(piece.column("key")).astype(np.int64).view(np.uint64)[row] ^ salt * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(33)
                begin = at[:-1][row] + (draw.astype(np.int64) % (spare + 1))
                fresh = np.append(True, (begin[1:] != begin[:-1]) | (row[1:] != row[:-1])) if len(row) else np.empty(0, bool)
                begin, row = begin[fresh], row[fresh]
                x = cut_windows(data, at, begin, row)
                yield pa.RecordBatch.from_arrays([piece.column("lang").take(pa.array(row)), pa.array([w.tobytes() for w in x], pa.binary())], names=["lang", "window"])

    return cut


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Network | None:
    """A network trained on up to ``fit_rows`` of ``labelled`` (text, lang): of each language an equal share, the least text hashes.

    None without a labelled text that has a letter.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("text", "lang", F.xxhash64("text").alias("key"))
    texts = materialize(rows.groupBy("lang", "key").agg(F.count("*").alias("n")).select("lang", "key"))  # copies count once
    sizes = materialize(texts.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("rows")))
    kinds = sizes.count()
    if not kinds:
        return None
    # A language's texts are drawn by hash, so that about its share of the sample stays; rare languages stay whole. Only hashes are dealt.
    placed = join_groups(texts, sizes, F.col("lang") == F.col("name"), "rows", texts.count())
    drawn = placed.where(f"pmod(xxhash64(key), 1000003) < 1000003 * {2.0 * fit_rows / kinds} / rows")
    chosen = materialize(drawn.orderBy(F.xxhash64("key"), "key", "lang").limit(fit_rows).select("lang", "key"))
    chosen = rows.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.any_value("text").alias("text"))  # ``fit_rows`` rows at most
    sample = chosen.select("text", "lang", "key").mapInArrow(_sampled_windows(0), "lang string, window binary").toArrow().sort_by([("window", "ascending"), ("lang", "ascending")])
    languages = sorted(set(sample.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    x = np.frombuffer(b"".join(sample.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([number[name] for name in sample.column("lang").to_pylist()]), languages)


def _predictor(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                data, at = text_bytes(piece.column("text"))
                begin, row = windows_of(data, at)
                total = np.zeros((piece.num_rows, len(net.languages)))
                for i in range(0, len(begin), 4096):
                    b, r = begin[i : i + 4096], row[i : i + 4096]
                    adds = np.minimum(at[1:][r] - b, WINDOW)
                    np.add.at(total, r, net.predict(cut_windows(data, at, b, r)) * adds[:, None])
                whole = total.sum(1)
                best = total.argmax(1)
                score = np.minimum(total[np.arange(len(best)), best] / np.maximum(whole, 1e-9), 1.0)
                known = np.asarray(piece.column("letters")) & (whole > 0)
                names = pa.array([net.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), names, pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, net: Network | None, held_out=None) -> DataFrame:
    """doc_id, held_out (false unless given), lang_pred and score of every row of ``documents`` (doc_id, text)."""
    held_out = F.lit(False) if held_out is None else held_out
    rows = documents.select("doc_id", held_out.alias("held_out"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predictor(net), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def held_out_languages(documents: DataFrame) -> DataFrame:
    """Predictions for all rows by a network trained on those whose crc32(doc_id) mod 4 is not 2."""
    held_out = crc_bucket("doc_id", 4) == 2
    return identify(documents, fit(documents.where(~held_out)), held_out)
