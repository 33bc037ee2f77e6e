"""Language identification: a convolutional network over bytes, trained in numpy and applied window by window.

Filters of several widths slide over the bytes of a window, the largest response of each filter is kept, and a softmax layer turns them into
languages. As a filter's response is a sum of one number per byte, the trained filters are folded into tables over bytes and byte pairs; a window then takes a few
look-ups a byte. A text is cut into windows of ``WINDOW`` bytes from its first to its last byte, and the log-probabilities of its windows are averaged by
their bytes.

Training takes at most ``max_rows`` documents, those with the smallest hash of the id, and ``WINDOWS_EACH`` windows of each. A text that is null or has
no letter is ``und`` with score 0, and so is every text when nothing can be learned; repeated rows get the same answer; an empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import held_out, map_batches

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
WINDOWS_EACH, EPOCHS, RATE, BATCH = 3, 6, 0.01, 128
PAD = 0x20
#: Bytes that are looked up at once.
BLOCK_BYTES = 1 << 18


@dataclass
class Network:
    """Embedding, filters by width, and the output layer."""

    languages: list[str]
    parts: dict[str, np.ndarray]

    def responses(self, windows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each width the pooled responses and where they lie; the filters see single windows."""
        embedded = self.parts["embedding"][windows]
        pooled, places = [], []
        for w in WIDTHS:
            n = windows.shape[1] - w + 1
            seen = np.concatenate([embedded[:, j : j + n] for j in range(w)], axis=2)
            out = seen @ self.parts[f"filter{w}"] + self.parts[f"bias{w}"]
            place = out.argmax(axis=1)
            places.append(place)
            pooled.append(np.take_along_axis(out, place[:, None], axis=1)[:, 0])
        return pooled, places

    def tables(self) -> dict[str, np.ndarray]:
        """Responses by byte and by byte pair."""
        single = {(w, j): self.parts["embedding"] @ self.parts[f"filter{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)
        return {
            "2": pair(single[2, 0], single[2, 1]), "3a": pair(single[3, 0], single[3, 1]), "3b": single[3, 2].astype(np.float32),
            "4a": pair(single[4, 0], single[4, 1]), "4b": pair(single[4, 2], single[4, 3]),
        }


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, marks: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on cross-entropy; the gradient of a pooled response reaches only the bytes it came from."""
    rng = np.random.default_rng(seed)
    parts = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
    for w in WIDTHS:
        parts[f"filter{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32)
        parts[f"bias{w}"] = np.zeros(FILTERS, np.float32)
    parts["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
    parts["out_bias"] = np.zeros(len(languages), np.float32)
    net = Network(languages, parts)
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = windows[rows]
            pooled, places = net.responses(x)
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            p = softmax(hidden @ parts["out"] + parts["out_bias"])
            p[np.arange(len(rows)), marks[rows]] -= 1
            p /= len(rows)
            grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0), "embedding": np.zeros_like(parts["embedding"])}
            back = (p @ parts["out"].T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                seen = x[np.arange(len(rows))[:, None, None], places[k][:, :, None] + np.arange(w)]  # rows, filters, w
                vectors = parts["embedding"][seen].reshape(len(rows), FILTERS, w * EMBEDDING)
                grads[f"filter{w}"] = np.einsum("bf,bfk->kf", g, vectors)
                grads[f"bias{w}"] = g.sum(axis=0)
                own = (g[:, :, None] * parts[f"filter{w}"].T[None]).reshape(len(rows), FILTERS, w, EMBEDDING)
                np.add.at(grads["embedding"], seen, own)
            step += 1
            for key, grad in grads.items():
                first[key] = 0.9 * first[key] + 0.1 * grad
                second[key] = 0.999 * second[key] + 0.001 * grad**2
                parts[key] -= (RATE * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def padded(data: bytes) -> np.ndarray:
    """Bytes of a text, lower-cased in ASCII and filled up to whole windows."""
    raw = np.frombuffer(data.lower(), np.uint8)
    out = np.full(max(1, -(-len(raw) // WINDOW)) * WINDOW, PAD, np.uint8)
    out[: len(raw)] = raw
    return out


def log_probabilities(net: Network, tables: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """For every window of ``data`` (whole windows) the log-probabilities of the languages."""
    out = []
    reach = max(WIDTHS) - 1
    for at in range(0, len(data), BLOCK_BYTES):
        block = np.append(data[at : at + BLOCK_BYTES], np.full(reach, PAD, np.uint8))
        n = len(block) - reach
        pair = block[:-1].astype(np.uint16) << 8 | block[1:]
        two = tables["2"][pair[:n]]
        three = tables["3a"][pair[:n]]
        three += tables["3b"][block[2 : n + 2]]
        four = tables["4a"][pair[:n]]
        four += tables["4b"][pair[2 : n + 2]]
        pooled = []
        for w, values in zip(WIDTHS, (two, three, four)):
            inside = values.reshape(-1, WINDOW, FILTERS)[:, : WINDOW - w + 1]
            pooled.append(inside.max(axis=1) + net.parts[f"bias{w}"])
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        out.append(np.log(softmax(hidden @ net.parts["out"] + net.parts["out_bias"]) + 1e-9))
    return np.concatenate(out)


def fit(docs: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network learned from at most ``max_rows`` documents with a language whose id is not held out; ``None`` without any."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = own.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id"), 3, 1))
    ids = known.select(F.xxhash64("id").alias("h"), F.col("id").alias("chosen")).distinct().orderBy("h", "chosen").limit(max_rows)
    # At most max_rows rows of two numbers, whatever the input; of each text a few windows.
    rows = known.join(F.broadcast(ids), F.col("id") == F.col("chosen"))

    def cut(batch: pa.RecordBatch) -> dict:
        windows = []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            data = padded(text.encode("utf-8", "surrogatepass")).reshape(-1, WINDOW)
            rng = np.random.default_rng(h % (1 << 32))
            chosen = data[rng.choice(len(data), min(len(data), WINDOWS_EACH), replace=False)].copy()
            for k, length in enumerate(rng.integers(24, WINDOW, len(chosen))):
                if k and rng.random() < 0.5:  # short texts are seen as well
                    chosen[k, length:] = PAD
            windows.append([w.tobytes() for w in chosen])
        return {"h": batch.column(0), "lang": batch.column(1), "windows": pa.array(windows, pa.list_(pa.binary()))}

    got = map_batches(rows.select("h", "lang", "text"), cut, "h bigint, lang string, windows array<binary>").orderBy("h", "lang", "windows").limit(max_rows).collect()
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    data = np.frombuffer(b"".join(bytes(w) for r in got for w in r.windows), np.uint8).reshape(-1, WINDOW)
    marks = np.array([languages.index(r.lang) for r in got for _ in r.windows])
    return train(data, marks, languages)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every document."""
    tables: list[dict[str, np.ndarray]] = []

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        if net is not None and not tables:
            tables.append(net.tables())
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if net is not None and t and any(map(str.isalpha, t))]
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for k, i in enumerate(lettered):
            data = padded(texts[i].encode("utf-8", "surrogatepass"))
            group.append((i, data))
            size += len(data)
            if size < BLOCK_BYTES and k < len(lettered) - 1:
                continue
            logs = log_probabilities(net, tables[0], np.concatenate([d for _, d in group]))
            weights = np.concatenate([_weights(len(texts[j].encode("utf-8", "surrogatepass")), len(d)) for j, d in group])
            cuts = np.append(0, np.cumsum([len(d) // WINDOW for _, d in group])[:-1])
            mean = np.add.reduceat(logs * weights[:, None], cuts) / np.add.reduceat(weights, cuts)[:, None]
            chance = softmax(mean)
            for (j, _), row in zip(group, chance):
                best = int(row.argmax())
                names[j], scores[j] = net.languages[best], float(row[best])
            group, size = [], 0
        return {"id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, lang_pred string, score double")


def _weights(n_bytes: int, n_padded: int) -> np.ndarray:
    """Bytes of the text in each of its windows."""
    ends = np.arange(WINDOW, n_padded + 1, WINDOW)
    return np.maximum(1, np.minimum(WINDOW, n_bytes - (ends - WINDOW))).astype(float)
