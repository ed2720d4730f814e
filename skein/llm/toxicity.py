"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are hashed twice into embedding tables (their sum is the word's vector, so a clash in one table
alone stays weak). Filters of several widths run over a text's words; each filter's largest response
feeds a logistic output. The embeddings start from smoothed log-odds of the training rows and are
then trained together with filters and output by Adagrad.

Training rows: all labelled texts, whole, but for those whose crc32(key) mod 5 is 0. Of the rest, remainder
1 is kept for calibration: the score is shifted so that 0.5 is the best cut over all languages, and each
language gets its own cut besides. Training is spread: rows fall into shards of about ``SHARD`` by a hash of
their key, and log-odds are counted over all. In each epoch every shard goes on from the shared weights;
then the changes are averaged, those of a table's row over the shards that hold its words. Cuts come from
counts of all calibration logits in steps of ``1 / GRID``. One shard is plain training; nothing depends on the
order of rows or on partitions. Scores depend on the text alone. Null and empty texts are scored as a text
without words. Rows that repeat are scored alike; conflicting labels of a key all count.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bitmaps import filter_of, split
from skein.llm.common import cut

SHARD, GRID, ROWS = 8000, 4096, 256  # labelled rows of a shard; steps of a logit; rows of a table that are sent together
TABLE_BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 6, 256, 0.08
BLOCK = 1 << 16
CUT_PRIOR = 20
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def token_ids(text: str | None) -> np.ndarray:
    """Two table rows per word, shape (n, 2). Words are runs of letters and digits in lower case."""
    tokens = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    h = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    mixed = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
    return np.stack([h & np.uint32((1 << TABLE_BITS) - 1), mixed.astype(np.uint32)], axis=1).astype(np.int32)


@dataclass
class Model:
    """Weights; ``shift`` moves the logit so that 0.5 is the calibrated cut; ``cuts``: language -> cut."""

    tables: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    shift: float = 0.0
    cuts: dict = field(default_factory=dict)

    @classmethod
    def start(cls, rng: np.random.Generator) -> Model:
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[0, 0, :2] += 1.0
        return cls(rng.normal(0, 0.01, (2, 1 << TABLE_BITS, DIM)).astype(np.float32), filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return self.tables[0][ids[:, 0]] + self.tables[1][ids[:, 1]]

    def responses(self, x: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Filter responses per word; ``last`` is the number of words from here to the text's end."""
        out = []
        for f, b in zip(self.filters, self.biases, strict=True):
            z = x @ f[0] + b
            for k in range(1, len(f)):
                more = np.zeros_like(z)
                more[:-k] = x[k:] @ f[k] if len(x) > k else 0
                more[last <= k] = 0
                z += more
            out.append(z)
        return out

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Largest responses of one text, at least 0; long texts go block by block."""
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        over = max(WIDTHS) - 1
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK + over]
            last = np.arange(len(part), 0, -1)
            z = np.concatenate(self.responses(self.vectors(part), last), axis=1)[:BLOCK]
            best = np.maximum(best, z.max(axis=0))
        return best

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.out + self.bias)

    def score(self, text: str | None) -> float:
        z = self.logit(token_ids(text)) - self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.int32).reshape(-1, 2)


def add_log_odds(model: Model, seen: np.ndarray, pos: int, neg: int) -> None:
    """First embedding dimension: how much more often a word's row occurs in positive texts; ``seen`` by table, label, row."""
    for t, own in enumerate(seen.astype(np.float32)):
        odds = np.log((own[1] + 0.5) / (max(1, pos) + 1)) - np.log((own[0] + 0.5) / (max(1, neg) + 1))
        sure = (own[0] + own[1]) / (own[0] + own[1] + 4)
        model.tables[t, :, 0] += (0.4 * np.clip(odds, -3, 5) * sure).astype(np.float32)


@dataclass
class State:
    """What training goes on from: weights and Adagrad's sums of squares, those of the tables apart."""

    model: Model
    squares: np.ndarray
    rest: list[np.ndarray]
    bias: float = 0.1

    @classmethod
    def start(cls, model: Model) -> State:
        return cls(model, np.full_like(model.tables, 0.1), [np.full_like(p, 0.1) for p in (*model.filters, *model.biases, model.out)])

    def parts(self) -> list[np.ndarray]:
        """Everything but the tables, in place."""
        return [*self.model.filters, *self.model.biases, self.model.out, *self.rest]

    def dense(self) -> np.ndarray:
        return np.concatenate([*[p.ravel() for p in self.parts()], [self.model.bias, self.bias]]).astype(np.float64)

    def take(self, dense: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = dense[at : at + p.size].reshape(p.shape)
            at += p.size
        self.model.bias, self.bias = float(dense[-2]), float(dense[-1])


def epoch(state: State, packed: list[bytes], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of Adagrad over the texts; changes ``state``."""
    model = state.model
    params = [*model.filters, *model.biases, model.out]
    nf, wn = FILTERS, len(WIDTHS)
    order = rng.permutation(len(labels))
    for at in range(0, len(order), BATCH):
        chosen, texts = [], []
        for i in order[at : at + BATCH]:
            t = unpacked(packed[i])
            if len(t):
                chosen.append(i)
                texts.append(t)
        if not chosen:
            continue
        lens = np.array([len(t) for t in texts])
        ids = np.concatenate(texts)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        last = np.repeat(starts + lens, lens) - np.arange(len(ids))
        x = model.vectors(ids)
        z = np.concatenate(model.responses(x, last), axis=1)
        top = np.maximum.reduceat(z, starts, axis=0)
        hit = z == np.repeat(top, lens, axis=0)
        place = np.where(hit, np.arange(len(ids))[:, None], len(ids))
        where = np.minimum.reduceat(place, starts, axis=0)
        pooled = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
        g = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
        grads = [np.zeros_like(q) for q in params]
        grads[-1] = pooled.T @ g
        back = (g[:, None] * model.out[None, :]) * (top > 0)
        rows, vecs = [], []
        for wi, w in enumerate(WIDTHS):
            cols = slice(wi * nf, (wi + 1) * nf)
            gz, pos = back[:, cols], where[:, cols]
            grads[wn + wi] = gz.sum(axis=0)
            for k in range(w):
                at_k = np.minimum(pos + k, len(ids) - 1)
                inside = (last[pos] > k) * gz
                grads[wi][k] = np.einsum("bfd,bf->df", x[at_k], inside)
                rows.append(at_k.ravel())
                vecs.append((inside[:, :, None] * model.filters[wi][k].T[None]).reshape(-1, DIM))
        rows, vecs = np.concatenate(rows), np.concatenate(vecs)
        for t in range(2):
            uniq, inv = np.unique(ids[rows, t], return_inverse=True)
            acc = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(acc, inv, vecs)
            state.squares[t][uniq] += acc**2
            model.tables[t][uniq] -= RATE * acc / np.sqrt(state.squares[t][uniq])
        for q, sq, grad in zip(params, state.rest, grads, strict=True):
            sq += grad**2
            q -= RATE * grad / np.sqrt(sq)
        gb = float(g.sum())
        state.bias += gb**2
        model.bias -= RATE * gb / np.sqrt(state.bias)


def best_cut(z: np.ndarray, n: np.ndarray, pos: np.ndarray) -> float:
    """The logit with the best F1, in the middle between the neighbours; 0 without both classes. ``n`` rows, ``pos`` of them positive, have logit ``z``."""
    if pos.sum() in (0, n.sum()):
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, n, pos = z[order], n[order], pos[order]
    f1 = 2 * np.cumsum(pos) / (np.cumsum(n) + pos.sum())
    i = int(np.argmax(f1))
    return float(z[i] + z[i + 1]) / 2 if i + 1 < len(z) else float(z[i]) - 1.0


def usable(labels: DataFrame) -> DataFrame:
    """``key, label, fold`` of all rows that labels may be learned from, of ``key, label``."""
    fold = F.crc32(F.col("key").cast("string").cast("binary")) % 5
    return labels.filter(F.col("label").isin(0, 1) & F.col("key").isNotNull()).distinct().withColumn("fold", fold.cast("int")).filter("fold <> 0")


def labelled(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> DataFrame:
    """``shard, ids, lang, label, tune`` of all usable labels that have a document, written by shard.

    Texts without a label stay where they are, but for some that the filter of fixed size lets pass. Of documents
    that repeat a key, the smallest text counts.
    """
    kind = docs.schema["key"].dataType
    chosen = cut(usable(labels).select(F.col("key").cast(kind).alias("k2"), F.col("label").cast("int").alias("label"), "fold"))
    shards = -(-chosen.count() // shard) or 1
    asked, _ = split(docs.filter("key is not null"), "key", filter_of(chosen, "k2"))
    met = asked.join(chosen, F.col("key") == F.col("k2"))
    one = met.groupBy("key", "label", "fold").agg(F.min(F.struct("text", "lang")).alias("t"))
    own = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.record_batch([b["shard"], pa.array([pack(token_ids(t.as_py()).tobytes()) for t in b["text"]], pa.binary()), b["lang"], b["label"], b["tune"]], names=["shard", "ids", "lang", "label", "tune"])

    rows = one.select(own.alias("shard"), "t.text", F.coalesce("t.lang", F.lit("")).alias("lang"), "label", (F.col("fold") == 1).alias("tune"))
    encoded = rows.mapInArrow(encode, "shard int, ids binary, lang string, label int, tune boolean")
    return cut(encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "ids", "lang", "label"))


def by_shard(batches: Iterator[pa.RecordBatch], tune: bool) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(shard, packed texts, labels) of the rows with ``tune``; rows come by shard."""
    now, texts, labels = -1, [], []
    for b in batches:
        for k, x, y, t in zip(b["shard"].to_pylist(), b["ids"], b["label"].to_pylist(), b["tune"].to_pylist(), strict=True):
            if t != tune:
                continue
            if k != now:
                if texts:
                    yield now, texts, np.array(labels, np.float32)
                now, texts, labels = k, [], []
            texts.append(x.as_py())
            labels.append(y)
    if texts:
        yield now, texts, np.array(labels, np.float32)


def word_counts(rows: DataFrame) -> np.ndarray:
    """In how many texts each table row occurs, by table, label, row; over all training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2, 1 << TABLE_BITS), np.int64)
        for _, texts, labels in by_shard(batches, False):
            for x, y in zip(texts, labels, strict=True):
                ids = unpacked(x)
                for t in range(2):
                    seen[t, int(y), np.unique(ids[:, t])] += 1
        some = np.nonzero(seen.ravel())[0]
        yield pa.record_batch([pa.array(some), pa.array(seen.ravel()[some])], names=["at", "n"])

    out = np.zeros(4 << TABLE_BITS, np.int64)
    found = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row per table row and label
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(2, 2, -1)


def spread_epoch(rows: DataFrame, state: State, pos: int, neg: int, seed: tuple[int, int]) -> None:
    """One epoch of all shards from ``state``, which takes their mean. The driver gets as much as the tables have."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(state))  # 8 MB

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts, y in by_shard(batches, False):
            own: State = pickle.loads(shared.value)
            tables, squares = own.model.tables.copy(), own.squares.copy()
            weight = np.where(y == 1, 0.5 / max(1, pos), 0.5 / max(1, neg)) * (pos + neg)
            epoch(own, texts, y, weight, np.random.default_rng((*seed, shard)))
            change = np.concatenate([own.model.tables - tables, own.squares - squares], axis=2).reshape(-1, 2 * DIM)
            some = np.nonzero(change.any(axis=1))[0]
            cuts = np.split(some, np.nonzero(np.diff(some // ROWS))[0] + 1) if len(some) else []
            blocks, at, values = [int(c[0]) // ROWS for c in cuts], [c.astype(np.int32).tobytes() for c in cuts], [change[c].tobytes() for c in cuts]
            m = len(cuts) + 1
            yield pa.record_batch([pa.array([-1, *blocks], pa.int64()), pa.array([shard] * m, pa.int64()), pa.array([len(y)] * m, pa.int64()), pa.array([b"", *at], pa.binary()), pa.array([own.dense().tobytes(), *values], pa.binary())], names=["block", "shard", "n", "at", "sum"])

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        block = group["block"][0].as_py()
        if block < 0:
            n = group["n"].to_numpy().astype(np.float64)
            out = np.average([np.frombuffer(x.as_py()) for x in group["sum"]], axis=0, weights=n)
        else:
            out, many = np.zeros((ROWS, 2 * DIM)), np.zeros((ROWS, 1))
            for a, x in zip(group["at"], group["sum"], strict=True):
                at = np.frombuffer(a.as_py(), np.int32) % ROWS
                out[at] += np.frombuffer(x.as_py(), np.float32).reshape(-1, 2 * DIM)
                many[at] += 1
            out = (out / np.maximum(many, 1)).astype(np.float32)
        return pa.table({"block": pa.array([block], pa.int64()), "sum": pa.array([out.tobytes()], pa.binary())})

    sums = rows.mapInArrow(learn, "block long, shard long, n long, at binary, sum binary").groupBy("block").applyInArrow(mean, "block long, sum binary")
    per = (1 << TABLE_BITS) // ROWS
    for block, x in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):
        if block < 0:
            state.take(np.frombuffer(x))
        else:
            t, at = divmod(block, per)
            change = np.frombuffer(x, np.float32).reshape(ROWS, 2 * DIM)
            state.model.tables[t, at * ROWS : (at + 1) * ROWS] += change[:, :DIM]
            state.squares[t, at * ROWS : (at + 1) * ROWS] += change[:, DIM:]
    shared.destroy()


def calibrate(rows: DataFrame, model: Model) -> None:
    """Sets ``shift`` and ``cuts`` from counts of all logits: each language's best cut is relative to the shared one, drawn
    towards that as if it had ``CUT_PRIOR`` positives more."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(shared.value)
        for b in batches:
            z = np.array([own.logit(unpacked(x.as_py())) for x in b["ids"]], np.float64)
            yield pa.record_batch([b["lang"], pa.array(np.rint(np.clip(z, -30, 30) * GRID).astype(np.int64)), b["label"]], names=["lang", "bin", "label"])

    logits = rows.select("ids", "lang", "label").mapInArrow(run, "lang string, bin long, label int")
    counts = cut(logits.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")))
    every = counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow()  # 60 * GRID rows at most
    model.shift = shift = best_cut(every["bin"].to_numpy() / GRID, every["n"].to_numpy(), every["pos"].to_numpy())

    def language(group: pa.Table) -> pa.Table:
        n, pos = group["n"].to_numpy(), group["pos"].to_numpy()
        mixed = 0 < pos.sum() < n.sum()
        z = (best_cut(group["bin"].to_numpy() / GRID, n, pos) - shift) * pos.sum() / (pos.sum() + CUT_PRIOR) if mixed else None
        return pa.table({"lang": group["lang"].slice(0, 1), "cut": pa.array([z], pa.float64())})

    found = counts.groupBy("lang").applyInArrow(language, "lang string, cut double").filter("cut is not null")
    model.cuts = {r["lang"]: r["cut"] for r in found.orderBy("lang").collect()}  # a row per language


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD, seed: int = 1) -> Model:
    """``docs``: key, text, lang; ``labels``: key, label. All labels outside the held-out rows count."""
    rows = labelled(docs, labels, shard)
    many = {(r["tune"], r["label"]): r["n"] for r in rows.groupBy("tune", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model.start(np.random.default_rng(seed))
    if not many:
        return model
    if len({tune for tune, _ in many}) == 1:  # nothing to tell apart: all rows serve both ends
        held = rows = rows.withColumn("tune", F.lit(False))
        many = {(False, y): n for (_, y), n in many.items()}
    else:
        held = rows.filter("tune")
    pos, neg = many.get((False, 1), 0), many.get((False, 0), 0)
    add_log_odds(model, word_counts(rows), pos, neg)
    state = State.start(model)
    for i in range(EPOCHS):
        spread_epoch(rows, state, pos, neg, (seed, i))
    model.tables = model.tables.astype(np.float16).astype(np.float32)
    calibrate(held, model)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, keep, score`` of every row; nothing is shuffled."""
    packed = Model(model.tables.astype(np.float16), model.filters, model.biases, model.out, model.bias, model.shift, model.cuts)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(packed))  # a fixed size: 2 MB of tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(shared.value)
        own.tables = own.tables.astype(np.float32)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([own.score(t.as_py()) for t in b.column(1)], pa.float64()), *b.columns[2:]], names=["key", "score", *b.schema.names[2:]])

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = [f"{c} {read.schema[c].dataType.simpleString()}" for c in ("key", *[f"k{i}" for i in range(len(keep))])]
    scored = read.mapInArrow(run, ", ".join([kinds[0], "score double", *kinds[1:]]))
    return scored.select(F.col("key").alias(key), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> tuple[DataFrame, Model]:
    """Trains on ``labels`` and scores all of ``docs``: ``key, lang, score, flagged``, and the model with its cuts.

    ``lang`` is no input of the score; it only says which cut ``flagged`` compares the score with. Null keys are
    scored, but no label belongs to them. Empty tables give no rows; without labels every score is 0.5 or less
    by the start weights.
    """
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(texts, labels.select(F.col(key).alias("key"), F.col(label).alias("label")))
    return flag_by_language(score(docs, model, key, text, (lang,)), model, lang), model


def flag_by_language(scored: DataFrame, model: Model, lang: str = "lang", score_column: str = "score") -> DataFrame:
    """Adds ``flagged``: whether the score reaches its language's own cut (0.5 where there is none)."""
    cut = F.lit(0.5)
    for name, z in model.cuts.items():
        cut = F.when(F.col(lang) == name, float(1 / (1 + np.exp(-z)))).otherwise(cut)
    return scored.withColumn("flagged", F.col(score_column) >= cut)
