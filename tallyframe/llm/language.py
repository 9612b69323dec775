"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of several widths slide over windows of fixed length,
each filter's highest value goes through a rectifier to a softmax layer. Trained in
numpy on a bounded sample of labelled texts; applied to all windows of a text,
whose probabilities are averaged by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.roles import quoted
from .common import give_back, ship

#: Bytes in a window, in an embedding, filter widths and filters of each.
WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: Labelled rows that the network learns from, over all languages together, and windows taken from each.
TRAINING_ROWS, WINDOWS_EACH = 4000, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 4e-3, 11
#: Batches that a network that tells noise sees at least, however few its windows are.
NOISE_STEPS = 600
#: Windows that go through the filters at once.
AT_ONCE = 64
UNKNOWN = "und"
#: Noise is told from text where it is the likelier, and likelier than in this share of the beginnings, of these lengths,
#: of the windows learned from: a short text shows less of its language.
CLEAN_SHARE, BEGINNINGS = 0.999, (128, 64, 32, 16)
#: Where the letters of some scripts begin; noise holds letters of those that no window learned from has.
SCRIPTS = [0x370, 0x410, 0x531, 0x5D0, 0x621, 0x905, 0x985, 0xE01, 0x10D0, 0x3041, 0x4E00, 0x6000, 0x7000, 0xAC00, 0xB800]
LETTERS = 48


class Network:
    """Weights, training and application. ``labels`` are in order of the outputs; with ``noise`` one more output tells it.

    A text is noise where that output's mean is above ``limit``.
    """

    def __init__(self, labels: list[str], seed: int = SEED, noise: bool = False) -> None:
        draw = np.random.default_rng(seed)
        self.labels, self.noise, self.limit = labels, noise, 1.0
        outputs = len(labels) + noise
        self.w = {"emb": draw.normal(0, 0.5, (256, DIM)).astype(np.float32)}
        for k in WIDTHS:
            self.w[f"conv{k}"] = draw.normal(0, (2 / (k * DIM)) ** 0.5, (k * DIM, FILTERS)).astype(np.float32)
            self.w[f"bias{k}"] = np.zeros(FILTERS, np.float32)
        self.w["out"] = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), outputs)).astype(np.float32)
        self.w["out_bias"] = np.zeros(outputs, np.float32)

    def _forward(self, x: np.ndarray):
        e = self.w["emb"][x]
        pooled, at = [], []
        for k in WIDTHS:
            seen = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), k * DIM, axis=1)[:, ::DIM]
            value = seen.reshape(-1, k * DIM) @ self.w[f"conv{k}"]
            value = value.reshape(len(x), -1, FILTERS)
            best = value.argmax(axis=1)
            at.append(best)
            pooled.append(np.take_along_axis(value, best[:, None], 1)[:, 0] + self.w[f"bias{k}"])
        pooled = np.concatenate(pooled, axis=1)
        return e, at, pooled, softmax(np.maximum(pooled, 0) @ self.w["out"] + self.w["out_bias"])

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, at, pooled, p = self._forward(x)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        active = np.maximum(pooled, 0)
        g = {"out": active.T @ p, "out_bias": p.sum(axis=0), "emb": np.zeros_like(self.w["emb"])}
        back = (p @ self.w["out"].T) * (pooled > 0)
        rows = np.arange(len(x))[:, None, None]
        for i, k in enumerate(WIDTHS):
            b = back[:, i * FILTERS : (i + 1) * FILTERS]
            spots = at[i][:, :, None] + np.arange(k)  # the bytes under each filter's best place
            under = e[rows, spots].reshape(len(x), FILTERS, k * DIM)
            g[f"conv{k}"] = np.einsum("bf,bfd->df", b, under)
            g[f"bias{k}"] = b.sum(axis=0)
            to_bytes = b[:, :, None] * self.w[f"conv{k}"].T[None]
            np.add.at(g["emb"], x[rows, spots].ravel(), to_bytes.reshape(-1, DIM))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        """Adam on cross-entropy; the same windows in the same order give the same weights."""
        draw, step = np.random.default_rng(seed), 0
        mean = {n: np.zeros_like(v) for n, v in self.w.items()}
        square = {n: np.zeros_like(v) for n, v in self.w.items()}
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for i in range(0, len(x), BATCH):
                some = order[i : i + BATCH]
                step += 1
                for n, g in self._gradients(x[some], y[some]).items():
                    mean[n] += 0.1 * (g - mean[n])
                    square[n] += 0.001 * (g * g - square[n])
                    self.w[n] -= RATE * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> list[np.ndarray]:
        """What each pair of neighbouring bytes adds to the filters, for each place of the pair in them."""
        result = []
        for j in range(0, max(WIDTHS), 2):
            wide = [k for k in WIDTHS if k > j]
            first, second = (
                np.concatenate([
                    self.w["emb"] @ self.w[f"conv{k}"][(j + d) * DIM : (j + d + 1) * DIM] if k > j + d else np.zeros((256, FILTERS), np.float32)
                    for k in wide
                ], axis=1)
                for d in (0, 1)
            )
            result.append((first[:, None] + second[None, :]).reshape(1 << 16, -1))
        return result

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """For windows of bytes, by table look-up instead of products."""
        # Filters of all widths start together at every place where the widest fits, the narrower ones at the few last places by themselves.
        n, widest = x.shape[1] - max(WIDTHS) + 1, max(WIDTHS)
        bias = np.concatenate([self.w[f"bias{k}"] for k in WIDTHS])
        result = np.empty((len(x), len(self.w["out_bias"])), np.float32)
        for i in range(0, len(x), AT_ONCE):
            some = x[i : i + AT_ONCE].astype(np.intp)
            pairs = (some[:, :-1] << 8) | some[:, 1:]
            value = tables[0].take(pairs[:, :n], axis=0)
            for j in range(2, widest, 2):
                more = tables[j // 2].take(pairs[:, j : j + n], axis=0)
                value[:, :, -more.shape[2] :] += more
            best, ends = value.max(axis=1), self.w["emb"][some[:, n:]].reshape(len(some), -1)
            for j, k in enumerate(WIDTHS):
                for last in range(widest - k):
                    own = best[:, j * FILTERS : (j + 1) * FILTERS]
                    np.maximum(own, ends[:, last * DIM : (last + k) * DIM] @ self.w[f"conv{k}"], out=own)
            pooled = np.maximum(best + bias, 0)
            result[i : i + AT_ONCE] = softmax(pooled @ self.w["out"] + self.w["out_bias"])
        return result


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each filled up with null bytes; whose they are, and their bytes."""
    counts = [max(1, -(-len(t) // WINDOW)) for t in texts]
    x = np.frombuffer(b"".join([t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts)]), np.uint8).reshape(-1, WINDOW)
    whose = np.repeat(np.arange(len(texts)), counts)
    size = np.full(len(x), WINDOW)
    size[np.cumsum(counts) - 1] = [max(1, len(t) - (n - 1) * WINDOW) for t, n in zip(texts, counts)]
    return x, whose, size


def is_held_out(ident: Column) -> Column:
    """A third of the ids, by checksum; these rows are never learned from. No id is false, but isn't learned from either."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels and windows from about ``rows`` labelled texts in equal parts by language, chosen by a hash of id and text.

    Windows that are alike count once, so copies bring no more than one text does; at most twice the windows
    of ``rows`` texts come to the driver, those of the least hashes.
    """
    ident, lang = quoted(id_col), quoted(lang_col).cast("string")
    known = docs.select(ident.alias("_id"), lang.alias("_lang"), quoted(text_col).cast("string").alias("_text"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & ~is_held_out(F.col("_id")))
    # One language among very many would not be learned from a bounded sample anyway.
    sizes = known.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(rows).collect()
    if not sizes:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, int)
    each, spread = max(1, rows // len(sizes)), 1 << 30
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["_lang"], int(min(1.0, each / r["n"]) * spread) + 1)])
    chosen = known.filter(F.pmod(F.xxhash64("_id", "_text", F.lit("sample")), F.lit(spread)) < F.coalesce(share[F.col("_lang")], F.lit(0)))
    starts = [F.greatest(F.floor(F.length("_text") * i / WINDOWS_EACH), F.lit(0)).cast("int") + 1 for i in range(WINDOWS_EACH)]
    parts = chosen.filter("_text is not null").select("_lang", F.explode(F.array_distinct(F.array(*[F.substring(F.col("_text"), s, F.lit(WINDOW)) for s in starts]))).alias("t"))
    few = parts.filter("t != ''").distinct().orderBy(F.xxhash64("_lang", "t"), "_lang", "t").limit(2 * rows * WINDOWS_EACH)
    found = sorted((r["_lang"], r["t"]) for r in few.collect())
    labels = sorted({lang for lang, _ in found})
    x, whose, _ = windows([t.encode("utf-8", "surrogatepass")[:WINDOW] for _, t in found]) if found else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), None)
    return labels, x, np.array([labels.index(found[i][0]) for i in whose], int)


def noise_windows(x: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` windows as long as some of ``x``: in turn their bytes shuffled, any bytes, printable ones, letters of scripts that ``x`` lacks."""
    draw = np.random.default_rng(seed)
    seen = {c for row in x for c in row.tobytes().decode("utf-8", "ignore")}
    scripts = [at for at in SCRIPTS if not any(chr(c) in seen for c in range(at, at + LETTERS))]
    result = np.zeros((count, WINDOW), np.uint8)
    for i, row in enumerate(x[draw.integers(0, len(x), count)]):
        size = max(1, int((row != 0).sum()))
        if i % 4 == 0:
            made = draw.permutation(row[row != 0])
        elif i % 4 == 1:
            made = draw.integers(0, 256, size).astype(np.uint8)
        elif i % 4 == 2 or not scripts:
            made = draw.integers(32, 127, size).astype(np.uint8)
        else:
            letters = draw.choice(scripts) + draw.integers(0, LETTERS, size)
            letters[draw.random(size) < 0.15] = 32
            made = np.frombuffer("".join(map(chr, letters)).encode()[:size], np.uint8)
        result[i, : len(made)] = made
    return result


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAINING_ROWS, noise: bool = False
) -> Network:
    """A network of the languages of ``docs``; with ``noise`` also of what is no text of theirs, made from as many windows as a language has."""
    labels, x, y = training_windows(docs, id_col, text_col, lang_col, rows)
    if not noise or not labels:
        return Network(labels).train(x, y)
    made = noise_windows(x, -(-len(x) // len(labels)))
    network = Network(labels, noise=True)
    epochs = max(EPOCHS, -(-NOISE_STEPS * BATCH // (len(x) + len(made))))
    network.train(np.concatenate([x, made]), np.concatenate([y, np.full(len(made), len(labels))]), epochs)
    tables = network.tables()
    found = [network.probabilities(np.where(np.arange(WINDOW) < n, x, 0).astype(np.uint8), tables)[:, -1] for n in BEGINNINGS]
    network.limit = max(0.5, float(np.quantile(np.concatenate(found), CLEAN_SHARE)))
    return network


def predicted(texts: Column, network: Network) -> Column:
    """A struct of lang_pred and score: ``und`` with 0 for a missing text, one without a letter, noise, or nothing learned."""
    ship(SparkSession.active())

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = network.tables()
        for batch in batches:
            names, scores = [], []
            texts, first = batch.array, 0
            while first < len(texts):
                data, size = [], 0
                while first < len(texts) and size < 1 << 20:
                    data.append((texts[first] or "").encode("utf-8", "surrogatepass"))
                    size += len(data[-1])
                    first += 1
                x, whose, weight = windows(data)
                total = np.zeros((len(data), len(network.w["out_bias"])))
                np.add.at(total, whose, network.probabilities(x, tables) * weight[:, None])
                total /= total.sum(axis=1, keepdims=True)
                best = total[:, : len(network.labels)].argmax(axis=1)
                known = total[:, -1] <= network.limit if network.noise else np.full(len(best), True)
                names += [network.labels[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores += np.where(known, total[np.arange(len(best)), best].clip(0, 1), 0.0).tolist()
            del batch, texts
            give_back()
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not network.labels:
        return unknown
    return F.when(F.coalesce(texts.rlike(r"\p{L}"), F.lit(False)), of(texts)).otherwise(unknown)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", network: Network | None = None
) -> DataFrame:
    """``docs`` with held_out, lang_pred and score (0 to 1); learns from ``docs`` unless a network is given.

    Only ids, labels and texts of rows that aren't held out are learned from, and only
    the text goes into a prediction. All windows of a text count, by their bytes, however long it is. Rows
    that repeat are told alike; an empty table stays empty. Columns of ``docs`` with the names that are added give way.
    """
    network = network or fit(docs, id_col, text_col, lang_col)
    kept = [quoted(c) for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    told = docs.select(*kept, is_held_out(quoted(id_col)).alias("held_out"), predicted(quoted(text_col).cast("string"), network).alias("_told"))
    return told.withColumns({"lang_pred": F.col("_told.lang_pred"), "score": F.col("_told.score")}).drop("_told")
