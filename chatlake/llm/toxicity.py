"""A convolutional text classifier in numpy.

Every word is hashed twice, and its embedding is the sum of the two of BUCKETS embeddings; filters of several widths run over them, the largest response of
each filter in a document goes to a logistic output. fit() trains on a bounded sample of labelled rows; fit_all() starts there and
goes on over all of them where they are more, with passes in which each task trains on its own part and the models are averaged. The
threshold is calibrated by language, and as the language column is no input of a score, the language of a
text is guessed from its bytes.

Null and empty texts get a score too: that of a text of padding. A table without usable labels, as an empty one, gives
the score 0 to all. Labels that are null or neither 0 nor 1 are not used; of a document labelled twice the
larger label counts, and of a document with several texts the shortest. fit() needs the columns text and lang; a null lang is no language. Repeated rows are scored alike, very long texts
whole, in memory in proportion to them; other columns are ignored, and kept by keep_clean.
"""

from __future__ import annotations

import dataclasses
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .language import held_out
from .session import forget, ready, table, written

#: The bounded sample: at most so many documents of each label, each once, and of so many bytes of text in all.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
SAMPLE_BYTES = 24 << 20
#: Rows of the table of embeddings. Two of them make a word's, so that words that share one row differ.
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: The step of a word's embedding, in units of a batch's gradient, and the spread of embeddings at the start.
WORD_RATE, START = 0.05, 0.01
#: Padding after each document, so that a window of padding alone stands for an empty one.
_PADS, _REACH = max(WIDTHS), max(WIDTHS) - 1
#: Passes over all labelled rows, bytes of text that a part of a pass has, about, and pieces of the embeddings that are averaged apart.
PASSES, PART_BYTES, PIECES = 3, 32 << 20, 64
#: Thresholds of all rows come from counts of logits in bins of 1 / BINS, up to REACHED on both sides.
BINS, REACHED = 512, 32


@dataclasses.dataclass
class Model:
    embedding: np.ndarray  # row 0 is padding
    filters: list[np.ndarray]  # width * DIM by FILTERS
    shifts: np.ndarray
    weights: np.ndarray
    bias: float
    byte_logs: np.ndarray  # guessed language by byte
    thresholds: np.ndarray  # logits

    def responses(self) -> list[list[np.ndarray]]:
        """What each embedding adds to each filter at each of its places."""
        return [[self.embedding @ f[o * DIM : (o + 1) * DIM] for o in range(w)] for w, f in zip(WIDTHS, self.filters)]


def _rows(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words with the padding after each document, and where each document starts."""
    starts = np.searchsorted(doc, np.arange(docs)) + _PADS * np.arange(docs)
    out = np.zeros((len(h) + _PADS * docs, 2), np.int32)
    out[np.arange(len(h)) + _PADS * doc] = 1 + (np.stack([h, h << np.uint64(32)], 1) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    return out, starts


def _hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, doc = tx.words(data, off, tx.NO_LETTER)
    return tx.span_hashes(data, s, e, lower=True), doc


def _byte_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.bincount(doc * 256 + tx._LOWER[data], minlength=256 * (len(off) - 1)).reshape(-1, 256)


def _guess(counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
    return (counts @ logs.T).argmax(1)


def logits(m: Model, responses: list[list[np.ndarray]], rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    pooled = []
    n = len(rows)
    for parts in responses:
        total = None
        for o, table_ in enumerate(parts):
            for j in (0, 1):
                part = table_[rows[o : n - _REACH + o, j]]
                total = part if total is None else np.add(total, part, out=total)
        # windows that start in a document's own padding are left out by the cut at its first pad but one
        pooled.append(np.maximum.reduceat(_inside(total, starts, n), starts))
    x = np.maximum(np.concatenate(pooled, 1) + m.shifts, 0)
    return x @ m.weights + m.bias


def _inside(total: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Responses by place, with those that would read past a document's padding made small."""
    full = np.full((n, total.shape[1]), -1e30, total.dtype)
    full[: len(total)] = total
    ends = np.append(starts[1:], n)
    empty = ends - starts == _PADS
    for j in range(1, _PADS + 1):
        at = ends - j
        full[at[~(empty & (j == _PADS))]] = -1e30
    return full


class _State:
    """What steps remember: moving means of gradients and of their squares."""

    def __init__(self, params: list[np.ndarray]):
        self.mean, self.var = [np.zeros_like(p) for p in params[1:]], [np.zeros_like(p) for p in params[1:]]
        self.step, self.scale = 0, 0.0


def _move(m: Model, params: list[np.ndarray], state: _State, r: np.ndarray, at: np.ndarray, y: np.ndarray, rate: float = 1.0) -> np.ndarray:
    """One step on a batch of documents; the embeddings that moved."""
    grads = _gradients(m, params, r, at, y)
    state.step += 1
    words, g = grads[0]  # one scale for all words, else a word of a single document would move as far as any
    now = float((g * g).sum())
    state.scale = now if state.step == 1 else state.scale + 0.01 * (now - state.scale)
    m.embedding[words] -= rate * WORD_RATE * g / math.sqrt(state.scale / BATCH + 1e-18)
    for p, g, u, v in zip(params[1:], grads[1:], state.mean, state.var):
        u += 0.1 * (g - u)
        v += 0.001 * (g * g - v)
        p -= rate * RATE * (u / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.999**state.step)) + 1e-7)
    m.embedding[0] = 0
    return words


def train(texts: pa.Array, labels: np.ndarray, langs: list[str | None], seed: int = 5) -> Model:
    data, off = tx.utf8(texts)
    rows, starts = _rows_in_chunks(data, off)
    rng = np.random.default_rng(seed)
    n = len(labels)
    names = sorted({x for x in langs if x is not None}) or [""]
    counts = _byte_counts_in_chunks(data, off)
    of = np.array([names.index(x) if x is not None else -1 for x in langs]) if names != [""] else np.zeros(n, int)
    sums = np.stack([counts[of == i].sum(0) for i in range(len(names))]) + 1.0
    logs = np.log(sums / sums.sum(1, keepdims=True))

    f32 = np.float32
    m = Model(rng.normal(0, START, (BUCKETS + 1, DIM)).astype(f32), [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(f32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), f32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(f32), 0.0, logs, np.zeros(len(names)))
    m.embedding[0] = 0
    ends = np.append(starts[1:], len(rows))
    split = rng.permutation(n)
    tune, fit = split[: n // 5], split[n // 5 :]
    params = [m.embedding, *m.filters, m.shifts, m.weights, np.zeros(1, f32)]
    state = _State(params)
    best, kept = np.inf, None
    share = labels[fit].mean() if len(fit) else 0.5
    params[-1][:] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    for _ in range(EPOCHS):
        for b in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            if not len(b):
                continue
            spans = [rows[starts[i] : ends[i]] for i in b]
            r = np.concatenate(spans)
            at = np.cumsum([0, *map(len, spans)])[:-1]
            _move(m, params, state, r, at, labels[b])
        m.bias = float(params[-1][0])
        z = _logits_of(m, rows, starts, ends, tune)
        loss = float(np.logaddexp(0, np.where(labels[tune] == 1, -z, z)).mean()) if len(tune) else 0.0
        if loss < best:
            best, kept = loss, ([p.copy() for p in params], z)
    for p, k in zip(params, kept[0]):
        p[:] = k
    m.bias = float(params[-1][0])
    z, y, who = kept[1], labels[tune], _guess(counts[tune], logs)
    overall = _threshold(z, y, 0.0)
    m.thresholds = np.array([_threshold(z[who == i], y[who == i], overall) for i in range(len(names))])
    return m


def _threshold(z: np.ndarray, y: np.ndarray, default: float) -> float:
    """The logit with the best F1, midway between its neighbours; the default where there is too little to see."""
    if y.sum() < 10 or len(y) - y.sum() < 10:
        return default
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float((z[order[k]] + z[order[min(k + 1, len(y) - 1)]]) / 2)


def _logits_of(m, rows, starts, ends, which):
    out, responses = [], m.responses()
    for b in np.array_split(which, max(1, len(which) // 256)):
        if len(b):
            spans = [rows[starts[i] : ends[i]] for i in b]
            out.append(logits(m, responses, np.concatenate(spans), np.cumsum([0, *map(len, spans)])[:-1]))
    return np.concatenate(out) if out else np.zeros(0)


def _gradients(m: Model, params: list[np.ndarray], r: np.ndarray, at: np.ndarray, y: np.ndarray) -> list:
    """The words with a gradient and theirs, then the gradients of the other parameters."""
    n, docs = len(r), len(at)
    doc = np.repeat(np.arange(docs), np.diff(np.append(at, n)))
    x = m.embedding[r[:, 0]] + m.embedding[r[:, 1]]
    pooled, spots = [], []
    for w, f in zip(WIDTHS, m.filters):
        wide = np.concatenate([x[o : n - _REACH + o] for o in range(w)], 1)
        full = _inside(wide @ f, at, n)
        top = np.maximum.reduceat(full, at)
        where, k = np.nonzero(full == top[doc])
        place = np.full((docs, FILTERS), -1)
        place[doc[where[::-1]], k[::-1]] = where[::-1]
        pooled.append(top)
        spots.append(place)
    a = np.concatenate(pooled, 1) + m.shifts
    act = np.maximum(a, 0)
    z = act @ m.weights + params[-1][0]
    dz = ((1 / (1 + np.exp(-z)) - y) / docs).astype(np.float32)
    da = (dz[:, None] * m.weights) * (a > 0)
    gf, read, passed = [], [], []
    for j, (w, f) in enumerate(zip(WIDTHS, m.filters)):
        d = da[:, j * FILTERS : (j + 1) * FILTERS]
        g = np.zeros_like(f)
        for o in range(w):
            word = np.minimum(spots[j] + o, n - 1)
            g[o * DIM : (o + 1) * DIM] = np.einsum("dk,dkx->xk", d, x[word])
            read.append(r[word.ravel()].ravel())
            passed.append(np.repeat((d[:, :, None] * f[o * DIM : (o + 1) * DIM].T[None]).reshape(-1, DIM), 2, 0))
        gf.append(g)
    words, where = np.unique(np.concatenate(read), return_inverse=True)
    ge = np.zeros((len(words), DIM), np.float32)
    np.add.at(ge, where, np.concatenate(passed))
    return [(words, ge), *gf, da.sum(0), act.T @ dz, np.array([dz.sum()], np.float32)]


def _rows_in_chunks(data, off):
    rows, starts, at = [np.zeros((0, 2), np.int32)], [np.zeros(0, np.int64)], 0
    for a, b in tx.chunks(off):
        part, first = _rows(*_hashed(data[off[a] : off[b]], off[a : b + 1] - off[a]), b - a)
        rows.append(part)
        starts.append(first + at)
        at += len(part)
    return np.concatenate(rows), np.concatenate(starts)


def _byte_counts_in_chunks(data, off):
    parts = [_byte_counts(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in tx.chunks(off)]
    return np.concatenate(parts) if parts else np.zeros((0, 256), np.int64)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id") -> Model | None:
    """Train on a bounded sample of the rows of docs (all may be used) that have a label, in a task."""
    ready(docs.sparkSession)
    marks = _marks(labels, label_col, id_col)
    # documents are taken in the order of a hash of their ids, so that the sample is spread over all of the corpus
    drawn = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    source = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    # ids are few by the bound above, so that nothing of the corpus is dealt out; of an id's rows the shortest text counts
    known = source.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").groupBy("id", "y").agg(F.min(F.struct(F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h"))).alias("t"), F.xxhash64("id").alias("o"))
    sampled, chosen = known.collect(), []
    for y in (1, 0):
        room = SAMPLE_BYTES // 2
        for r in sorted((r for r in sampled if r.y == y), key=lambda r: (r.o, r.id)):
            if r.t.bytes <= room:
                room -= r.t.bytes
                chosen.append((r.id, y, r.t.bytes, r.t.h))
    wanted = docs.sparkSession.createDataFrame(chosen, f"id {docs.schema[id_col].dataType.simpleString()}, y int, bytes int, h long")
    rows = source.join(F.broadcast(wanted), "id").where((F.octet_length("text") == F.col("bytes")) & (F.xxhash64("text") == F.col("h"))).groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("x"))

    def trained(batches):
        if not (held := list(batches)):
            return
        got = pa.Table.from_batches(held).sort_by("id")
        y = got["y"].to_numpy().astype(np.int64)
        if len(y) and y.min() != y.max():
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(got["text"].combine_chunks(), y, got["lang"].to_pylist()))])], ["model"])
        del got, held
        tx.trim()

    # the driver gets the model alone, neither the texts nor what training takes
    models = rows.select("id", "y", "x.text", "x.lang").repartition(1).mapInArrow(trained, "model binary").collect()
    return pickle.loads(models[0].model) if models else None


def _marks(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(id, y) of each document with a usable label."""
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))


def fit_all(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id") -> Model | None:
    """Train on all rows of docs that have a label: as fit() does where its sample holds all of them. Else a fifth of them, by
    a hash of their ids, is kept for choosing the pass and the thresholds; fit() starts on the others, PASSES go over all
    of these, and languages are learned from all rows. Parts depend on ids and the size of the texts alone, not on tasks."""
    spark = ready(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    first = F.min(F.struct(F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h"), "text", "lang")).alias("x")
    known = source.join(_marks(labels, label_col, id_col), "id").groupBy("id", "y").agg(first)
    known = written(known.select("id", "y", "x.bytes", "x.text", "x.lang", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).alias("tune")), "toxicity-known")
    sizes = {r.y: r for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}
    whole = all(y not in sizes or (sizes[y].n <= most and sizes[y].bytes <= SAMPLE_BYTES // 2) for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)))
    model = None
    if not whole:
        rest = known.where("NOT tune")
        model = fit(rest, rest, "y", "id")
    if model is None:
        forget(known)
        return fit(docs, labels, label_col, id_col)
    parts = -(-sum(r.bytes for r in sizes.values()) // PART_BYTES)
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int").alias("part")
    # a file has whole parts, in the order of a hash, and is read by one task
    dealt = written(known.where("NOT tune").select("id", "y", "text", part).repartitionById(parts, "part").sortWithinPartitions("part", F.xxhash64("id"), "id").select("part", "y", "text"), "toxicity-parts")
    model = _with_languages(model, known)
    tune, best = known.where("tune").select("y", "text"), None
    for n in range(PASSES + 1):
        loss, bins = _judged(tune, model)
        if best is None or loss < best[0]:
            best = loss, model, bins
        if n < PASSES:
            model = _passed(dealt, model, 1 / (1 + n))
    model = dataclasses.replace(best[1], thresholds=_binned_thresholds(best[2], len(model.thresholds)))
    forget(dealt)
    forget(known)
    tx.trim()
    return model


def _with_languages(m: Model, known: DataFrame) -> Model:
    """m with the bytes of each language, counted in all rows."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, off = tx.utf8(batch.column(0))
            counts, langs = _byte_counts_in_chunks(data, off), np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + counts[langs == lang].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "counts"])

    by_lang = known.where("lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, counts array<long>").select("lang", F.posexplode("counts").alias("byte", "n"))
    rows = by_lang.groupBy("lang", "byte").agg(F.sum("n").alias("n")).collect()  # 256 for each language
    names = sorted({r.lang for r in rows})
    if not names:
        return m
    sums, at = np.ones((len(names), 256)), {x: i for i, x in enumerate(names)}
    for r in rows:
        sums[at[r.lang], r.byte] += r.n
    return dataclasses.replace(m, byte_logs=np.log(sums / sums.sum(1, keepdims=True)), thresholds=np.zeros(len(names)))


def _params(m: Model) -> list[np.ndarray]:
    return [m.embedding, *m.filters, m.shifts, m.weights, np.array([m.bias], np.float32)]


def _passed(dealt: DataFrame, model: Model, rate: float) -> Model:
    """The mean of the models that parts come to from `model`: of an embedding over the parts where it moved, of the rest
    by their numbers of documents. Parts are added in their order."""
    shared = dealt.sparkSession.sparkContext.broadcast(model)
    each = -(-(BUCKETS + 1) // PIECES)

    def run(batches):
        old, at = shared.value, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if parts[a] != at:
                    if at is not None:
                        yield moved(at, old, m, params, touched, docs)
                    m = dataclasses.replace(old, embedding=old.embedding.copy(), filters=[f.copy() for f in old.filters], shifts=old.shifts.copy(), weights=old.weights.copy())
                    at, params, touched, docs = parts[a], _params(m), np.zeros(BUCKETS + 1, bool), 0
                    state = _State(params)
                rows, starts = _rows_in_chunks(*tx.utf8(batch.column(2).slice(a, b - a)))
                y, ends = batch.column(1).to_numpy()[a:b].astype(np.int64), np.append(starts[1:], len(rows))
                for which in np.array_split(np.arange(b - a), -(-(b - a) // BATCH)):
                    lo, hi = starts[which[0]], ends[which[-1]]
                    touched[_move(m, params, state, rows[lo:hi], starts[which] - lo, y[which], rate)] = True
                docs += b - a
        if at is not None:
            yield moved(at, old, m, params, touched, docs)
        tx.trim()

    def moved(part, old, m, params, touched, docs):
        rows = np.flatnonzero(touched)
        bounds = np.searchsorted(rows, np.arange(0, PIECES + 1) * each)
        pieces = [(p, rows[x:z].astype(np.int32).tobytes(), (m.embedding[rows[x:z]] - old.embedding[rows[x:z]]).tobytes()) for p, (x, z) in enumerate(zip(bounds[:-1], bounds[1:]))]
        others = np.concatenate([(p - q).ravel() for p, q in zip(params[1:], _params(old)[1:])]).astype(np.float64)
        pieces.append((PIECES, b"", others.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in pieces], pa.int32()), pa.array([part] * len(pieces), pa.int32()), pa.array([docs] * len(pieces), pa.int64()), pa.array([x for _, x, _ in pieces], pa.binary()), pa.array([x for _, _, x in pieces], pa.binary())], ["piece", "part", "docs", "rows", "moves"])

    def mean(key, table):
        piece, table = key[0].as_py(), table.sort_by("part")
        docs = table["docs"].to_numpy()
        if piece == PIECES:
            out = sum(np.frombuffer(x.as_py()) * n for x, n in zip(table["moves"], docs)) / docs.sum()
        else:
            first = piece * each
            sums, n = np.zeros((each, DIM)), np.zeros(each)
            for rows, moves in zip(table["rows"], table["moves"]):
                at = np.frombuffer(rows.as_py(), np.int32) - first
                sums[at] += np.frombuffer(moves.as_py(), np.float32).reshape(-1, DIM)
                n[at] += 1
            whole = np.zeros((each, DIM), np.float32)
            old = shared.value.embedding[first : first + each]
            whole[: len(old)] = old + (sums / np.maximum(n, 1)[:, None])[: len(old)]
            out = whole.ravel()
        return pa.table([pa.array([piece], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["piece", "move"])

    moves = dealt.mapInArrow(run, "piece int, part int, docs long, rows binary, moves binary")
    got = {r.piece: np.frombuffer(r.move, np.float64 if r.piece == PIECES else np.float32) for r in moves.groupBy("piece").applyInArrow(mean, "piece int, move binary").collect()}  # the size of a model
    whole = np.concatenate([got[p] for p in range(PIECES)]).reshape(-1, DIM)[: BUCKETS + 1]
    others, at, params = got[PIECES], 0, []
    for p in _params(model)[1:]:
        params.append((p + others[at : at + p.size].reshape(p.shape)).astype(np.float32))
        at += p.size
    n = len(model.filters)
    shared.destroy()  # its copy in the driver's memory as well
    return dataclasses.replace(model, embedding=whole, filters=params[:n], shifts=params[n], weights=params[n + 1], bias=float(params[n + 2][0]))


def _judged(tune: DataFrame, model: Model) -> tuple[float, list]:
    """The mean loss, and (language, bin, label, n, loss) of the logits of all rows."""
    shared = tune.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        responses = m.responses()
        for batch in batches:
            data, off = tx.utf8(batch.column(1))
            for a, b in tx.chunks(off):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                z, y = logits(m, responses, *_rows(*_hashed(part, at), b - a)).astype(np.float64), batch.column(0).to_numpy()[a:b]
                where = np.clip(np.floor(z * BINS), -REACHED * BINS, REACHED * BINS - 1).astype(np.int32)
                # whole numbers, so that sums do not depend on the order of tasks
                loss = np.round(np.logaddexp(0, np.where(y == 1, -z, z)) * 2**20).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_guess(_byte_counts(part, at), m.byte_logs).astype(np.int32)), pa.array(where), pa.array(y.astype(np.int32)), pa.array(loss)], ["lang", "bin", "y", "loss"])

    rows = tune.mapInArrow(run, "lang int, bin int, y int, loss long").groupBy("lang", "bin", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss")).collect()
    shared.destroy()  # its copy in the driver's memory as well
    return sum(r.loss for r in rows) / max(1, sum(r.n for r in rows)), rows


def _binned_thresholds(rows: list, langs: int) -> np.ndarray:
    """As _threshold() of each language, with all logits of a bin at its lower end."""
    n = np.zeros((langs, 2, 2 * REACHED * BINS), np.int64)
    for r in rows:
        n[r.lang, r.y, r.bin + REACHED * BINS] += r.n

    def best(n: np.ndarray, default: float) -> float:
        if n[1].sum() < 10 or n[0].sum() < 10:
            return default
        at = np.flatnonzero(n.sum(0))[::-1]  # from the greatest
        hit = np.cumsum(n[1, at])
        k = int((2 * hit / (np.cumsum(n[:, at].sum(0)) + hit[-1])).argmax())
        low = (at[min(k + 1, len(at) - 1)] + 1 if k + 1 < len(at) else at[k])
        return float((at[k] + low) / 2 / BINS - REACHED)

    overall = best(n.sum(0), 0.0)
    return np.array([best(x, overall) for x in n])


def _scores(m: Model | None, responses: list | None, column: pa.Array):
    """Ranges of rows with their scores."""
    data, off = tx.utf8(column)
    for a, b in tx.chunks(off):
        if m is None:
            yield a, b, np.zeros(b - a)
            continue
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        z = logits(m, responses, *_rows(*_hashed(part, at), b - a)) - m.thresholds[_guess(_byte_counts(part, at), m.byte_logs)]
        yield a, b, 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, `score` (0 to 1) and `predicted` (1 where the score is at least 0.5)."""
    ready(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by BUCKETS

    def run(batches):
        m = shared.value
        responses = m.responses() if m else None
        for batch in batches:
            for a, b, s in _scores(m, responses, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that are not predicted to be toxic."""
    ready(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches):
        m = shared.value
        responses = m.responses() if m else None
        for batch in batches:
            for a, b, s in _scores(m, responses, batch.column(place)):
                yield batch.slice(a, b - a).filter(pa.array(s < 0.5))

    return df.mapInArrow(run, df.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_all(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
