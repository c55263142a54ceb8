"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into segments of SEGMENT bytes; in each, one network runs
forwards and one backwards, and their joint state labels every position with
probabilities of the languages. A document's probabilities are pooled over all
positions of all its segments. The network is trained here, by backpropagation
through time, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import release, row_steps, text_buffers

SEGMENT = 128
HIDDEN = 8
#: Bound of the training sample: rows of a language, rows in all (of many languages each gets fewer), and segments of a row.
TRAIN_ROWS = 300
TRAIN_ROWS_IN_ALL = 20_000
TRAIN_SEGMENTS = 4
EPOCHS = 5
BATCH = 128
RATE = 0.02
UNKNOWN = "und"
#: Segments that run through the network together.
LANES = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Parameters by name; arrays are float32. ``w`` has a row for each byte: the input's share of the three gates."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.h = list(languages), hidden
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {f"{k}{d}": small(*s) for d in "fb" for k, s in (("w", (256, 3 * hidden)), ("u", (hidden, 3 * hidden)))}
        self.p |= {"o": small(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, lane, hidden) of one direction, and what its gradient needs. Past a lane's end the state is zero."""
        w, u, h = self.p[f"w{d}"], self.p[f"u{d}"], self.h
        steps, lanes = x.shape
        state, states, trace = np.zeros((lanes, h), np.float32), np.empty((steps, lanes, h), np.float32), []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            a, b = w[x[t]], state @ u
            gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            trace.append((t, state, z, r, new, b[:, 2 * h :]))
            state = (state + z * (new - state)) * mask[t][:, None]
            states[t] = state
        return states, trace

    def _scores(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.p["o"] + self.p["c"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(-1, keepdims=True)

    def positions(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time, language, lane) of bytes (time, lane): both directions at once, lanes side by side."""
        h, (steps, lanes) = self.h, x.shape
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)  # sigmoid by tanh
        w = [np.ascontiguousarray((self.p[f"w{d}"] * half).T) for d in "fb"]
        u = np.stack([(self.p[f"u{d}"] * half).T for d in "fb"])
        a, b = np.empty((2, 3 * h, lanes), np.float32), np.empty((2, 3 * h, lanes), np.float32)
        state, states = np.zeros((2, h, lanes), np.float32), np.empty((steps, 2, h, lanes), np.float32)
        gate, new, share = a[:, : 2 * h], a[:, 2 * h :], b[:, 2 * h :]
        for t in range(steps):
            back = steps - 1 - t
            np.take(w[0], x[t], axis=1, out=a[0], mode="clip")
            np.take(w[1], x[back], axis=1, out=a[1], mode="clip")
            np.matmul(u, state, out=b)
            gate += b[:, : 2 * h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            share *= gate[:, h:]
            new += share
            np.tanh(new, out=new)
            new -= state
            new *= gate[:, :h]
            state += new
            if mask is not None:
                state[1] *= mask[back]
            states[t, 0], states[back, 1] = state[0], state[1]
        logits = np.matmul(np.ascontiguousarray(self.p["o"].T), states.reshape(steps, 2 * h, lanes)) + self.p["c"][:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradient(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions that count, and its gradient through time."""
        h, grads = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self._run(d, x, mask) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], -1)
        prob = self._scores(both)
        weight = mask / max(1.0, mask.sum())
        right = np.take_along_axis(prob, label[None, :, None], -1)[..., 0]
        loss = float(-(weight * np.log(right + 1e-9)).sum())
        d_logit = prob * weight[..., None]
        np.put_along_axis(d_logit, label[None, :, None], (right - 1)[..., None] * weight[..., None], -1)
        flat = d_logit.reshape(-1, d_logit.shape[-1])
        grads["o"], grads["c"] = both.reshape(-1, 2 * h).T @ flat, flat.sum(0)
        d_both = d_logit @ self.p["o"].T
        for k, d in enumerate("fb"):
            u, back = self.p[f"u{d}"], np.zeros(x.shape[1:] + (h,), np.float32)
            for t, before, z, r, new, bn in reversed(runs[d][1]):
                g = (back + d_both[t, :, k * h : (k + 1) * h]) * mask[t][:, None]
                d_new = g * z * (1 - new * new)
                d_gate = np.concatenate([g * (new - before) * z * (1 - z), d_new * bn * r * (1 - r)], 1)
                d_a = np.concatenate([d_gate, d_new], 1)
                d_b = np.concatenate([d_gate, d_new * r], 1)
                np.add.at(grads[f"w{d}"], x[t], d_a)
                grads[f"u{d}"] += before.T @ d_b
                back = g * (1 - z) + d_b @ u.T
        return loss, grads

    def train(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> float:
        """Adam over shuffled batches of segments; the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        step, loss = 0, 0.0
        total = epochs * -(-len(label) // batch)
        for _ in range(epochs):
            losses = []
            order = rng.permutation(len(label))
            for i in range(0, len(order), batch):
                lanes = order[i : i + batch]
                loss, grads = self.gradient(x[:, lanes], mask[:, lanes], label[lanes])
                losses.append(loss)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= np.float32(rate * (1 - 0.9 * step / total)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            loss = float(np.mean(losses))
        return loss

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (row, language) over all positions of each row's bytes; even ones for a row without."""
        n, k = len(offsets) - 1, len(self.languages)
        sizes = np.diff(offsets)
        count = -(-sizes // SEGMENT)
        row = np.repeat(np.arange(n), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[:-1][row] + nth * SEGMENT
        length = np.minimum(SEGMENT, offsets[1:][row] - begin)
        total = np.zeros((n, k), np.float64)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), LANES):
            lanes = order[i : i + LANES]
            steps = int(length[lanes].max())
            at = begin[lanes][None, :] + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < length[lanes][None, :]
            x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
            if inside.all():
                part = self.positions(x).sum(0, dtype=np.float64).T
            else:
                part = (self.positions(x, inside.astype(np.float32)) * inside[:, None]).sum(0, dtype=np.float64).T
            np.add.at(total, row[lanes], part)
        return np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], 1.0 / k)


def segments_of(texts: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (time, lane), mask and labels of training segments."""
    x, mask = np.zeros((SEGMENT, len(texts)), np.int64), np.zeros((SEGMENT, len(texts)), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode()[:SEGMENT], np.uint8)
        x[: len(raw), i], mask[: len(raw), i] = raw, 1
    return x, mask, np.array(labels, np.int64)


def training_sample(docs: DataFrame, text_col: str, lang_col: str, key: Column, rows: int = TRAIN_ROWS, segments: int = TRAIN_SEGMENTS) -> list:
    """(lang, part) rows: of each language at most ``rows`` documents with the lowest hashes, and of those
    ``segments`` stretches spread over the whole text. Of more languages than share TRAIN_ROWS_IN_ALL at
    that number, each has fewer rows, but one at least.

    A first pass counts the languages; the second keeps about twice the rows
    wanted by their hashes alone, and cuts these to the bound.
    """
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = [(r[0], r[1]) for r in learn.groupBy(lang_col).count().orderBy(lang_col).collect()]
    if not sizes:
        return []
    rows = max(1, min(rows, TRAIN_ROWS_IN_ALL // len(sizes)))
    share = F.create_map(*[x for lang, n in sizes for x in (F.lit(lang), F.lit(min(1.0, (2.0 * rows + 50) / n)))])
    hashed = learn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key.cast("string"), F.lit(17)).alias("h"))
    few = hashed.where((F.col("h").cast("double") / 2.0**64 + 0.5) < F.try_element_at(share, F.col("lang")))
    size = F.length("text")
    cut = lambda k: F.substring(F.col("text"), (F.lit(1) + F.floor((size - SEGMENT) * k / max(1, segments - 1))).cast("int"), F.lit(SEGMENT))
    parts = F.when(size > SEGMENT * segments, F.array(*(cut(k) for k in range(segments)))).otherwise(F.filter(F.array(*(F.substring(F.col("text"), 1 + k * SEGMENT, SEGMENT) for k in range(segments))), lambda p: F.length(p) > 0))
    few = few.select("lang", "h", parts.alias("parts"))
    wanted = few.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "parts"))), 1, rows).alias("rows"))
    return wanted.select("lang", F.explode("rows").alias("r")).select("lang", F.explode("r.parts").alias("part")).orderBy("lang", "part").collect()


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, hidden: int = HIDDEN, epochs: int = EPOCHS) -> ByteGru | None:
    """A network for the languages of the labelled rows; None without any."""
    sample = training_sample(docs, text_col, lang_col, F.col("doc_id") if key is None else key)
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    model = ByteGru(languages, hidden)
    if len(languages) > 1:
        at = {lang: i for i, lang in enumerate(languages)}
        model.train(*segments_of([r["part"] for r in sample], [at[r["lang"]] for r in sample]), epochs=epochs)
    return model


def predict(docs: DataFrame, model: ByteGru | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all unless given) with lang_pred and score, the pooled probability of that language.

    'und' with score 0 where the text is null or has no letter, or if no
    language was learned. Columns of these names are replaced. Every byte of
    every text is labelled; memory follows an Arrow batch. Rows pass through
    Python whole: a scalar function would have Spark keep them on disk meanwhile.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    flag_name = max([*docs.columns, ""], key=len) + "_"  # none of the columns
    text = F.col(text_col).cast("string")
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    usable = F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), text)
    sent = docs.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), (usable if text_col not in names else F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).alias(flag_name))
    schema = T.StructType(sent.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            flag = batch.column(batch.num_columns - 1)
            texts = flag if text_col not in names else pc.if_else(flag, batch.column(names.index(text_col)).cast(pa.large_string()), None)
            data, offsets = text_buffers(texts)
            known = texts.is_valid().to_numpy(zero_copy_only=False)
            parts = [net.pooled(data, offsets[a : b + 1]) for a, b in row_steps(offsets, 4 * LANES * SEGMENT)]
            prob = np.concatenate(parts) if parts else np.zeros((0, len(net.languages)))
            best = prob.argmax(1) if len(prob) else np.zeros(0, int)
            label = [net.languages[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
            score = np.where(known, np.round(np.minimum(prob[np.arange(len(best)), best], 1.0), 6), 0.0)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
        release()

    return sent.mapInArrow(run, schema)
