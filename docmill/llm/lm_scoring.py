"""Log-bilinear language-model scoring, trained by noise-contrastive estimation (operator 7).

Tokens are the words of a text and one end.  Their exact counts over all training documents come from the block exchange: each
block sends its distinct words' counts to hash buckets and gets back, for each of its words, the count in the whole corpus.

The model predicts *units*.  Every word with a share of at least ``SHARE`` of the training tokens is one (so there are at most
1 / SHARE of them, whatever the corpus), and each *class* of words by their endings has one more unit for the rest of its words;
the end is a class by itself.  A word's probability is

    p(class | two units before) * p(unit | class, two units before) * p(word | unit)

The first two are log-bilinear: the context's position-wise vectors are added up and multiplied with the vectors of classes, and
of the units of the class.  The last is 1, or the smoothed share of the word in the rest of its class.

All parameters are trained in numpy by noise-contrastive estimation.  The number of steps follows the training tokens: every
training token is seen, in ``ROUNDS`` rounds that deal out all documents.  In a round, learners (one for ``LEARNER_TOKENS`` tokens,
at most ``LEARNERS``) go through their shares one after the other batch, each from the same model, and the mean of what they have
learned is the next round's model.  Corpora under ``LEAST_TOKENS`` are gone through up to ``PASSES`` times.  Scoring normalises: batched
matrix products give all classes of a context, and all units of a class in a context.

Defined cases: null is an empty text, which has the one token end; a text of any length is scored whole, in a block of its own if
it is longer than one; without training documents every probability is that of the smoothing alone (base score 0 for an empty
text); rows with equal ids are scored each by itself; no documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.blocks import SUMMARY, Blocks, answer_of, answered, decode, encode_answer, split, unpack
from docmill.llm.storage import stored, tidy
from docmill.llm.textkernel import row_of, span_hashes, utf8, word_spans

SHARE = 2.0**-15
#: Units below ``WORD``: the rest of each class, the end (a class too), and what stands before a text (in contexts only).
BINS = 126
END, START, WORD = BINS, BINS + 1, BINS + 2
CLASSES = BINS + 1
SMOOTH = 0.1
DIM, BATCH, RATE, CLASS_NOISE, UNIT_NOISE = 16, 1024, 0.15, 64, 2
ROUNDS, LEARNER_TOKENS, LEARNERS = 4, 2_000_000, 1024
LEAST_TOKENS, PASSES = 1_000_000, 16
SLICES = 64
END_KEY = np.uint64(0x454E44)
WORDS = 0


class Tokens:
    """The tokens of a block: distinct keys in order, and for each token the place of its key."""

    def __init__(self, payload, learns):
        rows = unpack(payload)
        self.ids = rows.column("doc_id").to_numpy()
        data, offsets = utf8(rows.column("text"))
        starts, ends, at = word_spans(data, offsets)
        counts = np.diff(at)
        # each row's words and then its end
        self.offsets = at + np.arange(len(at))
        self.row = np.repeat(np.arange(len(counts)), counts + 1)
        keys, bins = np.full(self.offsets[-1], END_KEY, np.uint64), np.full(self.offsets[-1], 255, np.uint8)
        words = np.arange(len(starts)) + row_of(at)
        keys[words], bins[words] = span_hashes(data, starts, ends), _bins(data, starts, ends)
        self.learn = np.array([learns(i) for i in self.ids.tolist()], bool)
        self.keys, first, self.place = np.unique(keys, return_index=True, return_inverse=True)
        self.bins = bins[first]
        self.counts = np.bincount(self.place, self.learn[self.row], len(self.keys)).astype("<u4")

    def units(self, words: Words) -> np.ndarray:
        """The unit of each distinct key."""
        out = self.bins.astype(np.int64)
        if len(words.keys):
            at = np.minimum(np.searchsorted(words.keys, self.keys), len(words.keys) - 1)
            out = np.where(words.keys[at] == self.keys, at + WORD, out)
        return np.where(self.keys == END_KEY, END, out)


def contexts(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token of whole texts that stand one after the other, and the one before that."""
    one, two = np.full(len(units), START, np.int64), np.full(len(units), START, np.int64)
    one[1:] = np.where(units[:-1] == END, START, units[:-1])
    two[2:] = np.where((units[:-2] == END) | (units[1:-1] == END), START, units[:-2])
    return one, two


def _bins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word's bin: by its last two bytes before one trailing punctuation mark, and that mark."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    last = low[ends - 1]
    mark = (last < 48) | ((last > 57) & (last < 97)) | ((last > 122) & (last < 128))
    size = ends - starts
    mark &= size > 1
    tail = ends - 1 - mark
    before = np.where(tail - 1 >= starts, low[np.maximum(tail - 1, 0)], 0)
    code = low[tail].astype(np.uint32) * 31 + before.astype(np.uint32) * 977 + np.where(mark, last, 0).astype(np.uint32) * 13
    return (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) % BINS


def _merge(kind: int, payloads: list) -> tuple[list[bytes], bytes]:
    parts = [decode(p, "<u4", "u1") for p in payloads]
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    uniq, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, counts, len(uniq)).astype("<i8")
    bounds = np.cumsum([0, *(len(p[0]) for p in parts)])
    answers = [encode_answer(total[at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]
    # besides, the bucket's own sums, and what words may have the share of a unit (1 / SHARE of them at most)
    bins = np.zeros(len(uniq), np.uint8)
    bins[at] = np.concatenate([p[2] for p in parts])
    seen = total > 0
    sums = np.concatenate([np.bincount(bins[seen], weights=w, minlength=256) for w in (total[seen], np.ones(int(seen.sum())))]).astype("<i8")
    top = np.flatnonzero((bins != 255) & seen & (total >= SHARE * total.sum()))
    summary = sums.tobytes() + uniq[top].astype("<u8").tobytes() + total[top].tobytes() + bins[top].tobytes()
    return answers, summary


def _sums(batches):
    """From the buckets' summaries: for each bin its words and their count."""
    for batch in batches:
        total = np.zeros((2, 256), np.int64)
        for raw in batch.column("payload").to_pylist():
            total += np.frombuffer(raw, "<i8", 512).reshape(2, 256)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0][some]), pa.array(total[1][some])], names=["bin", "n", "words"])


def _frequent(least: float):
    def run(batches):
        """From the buckets' summaries: the words with a count of ``least`` or more."""
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                n = (len(raw) - 4096) // 17
                keys, counts, bins = np.frombuffer(raw, "<i8", n, 4096), np.frombuffer(raw, "<i8", n, 4096 + 8 * n), np.frombuffer(raw, "u1", n, 4096 + 16 * n)
                some = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(bins[some], pa.int32()), pa.array(keys[some]), pa.array(counts[some])], names=["bin", "key", "n"])

    return run


class Words:
    """What the corpus' counts say of the units: keys (sorted) and counts of words, tokens and kinds of the rest of each class."""

    def __init__(self, keys: np.ndarray, bins: np.ndarray, counts: np.ndarray, rest: np.ndarray, kinds: np.ndarray, end: int):
        self.keys, self.rest, self.kinds = keys, rest, kinds
        self.classes = np.concatenate([np.arange(WORD), bins])  # of units; the class of START is never asked for
        self.counts = np.concatenate([rest, [end, 0], counts]).astype(float)
        # units in the order of their classes, without START; a unit's place there, and the classes' bounds
        order = np.argsort(self.classes, kind="stable")
        self.members = order[order != START]
        self.place = np.zeros(len(self.classes), np.int64)
        self.place[self.members] = np.arange(len(self.members))
        self.bounds = np.searchsorted(self.classes[self.members], np.arange(CLASSES + 1))

    def within(self, unit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 p(word | unit) of words with these counts."""
        rest = unit < END
        at = np.where(rest, unit, 0)
        share = (count + SMOOTH) / (self.rest[at] + SMOOTH * (self.kinds[at] + 1))
        return np.where(rest, np.log10(share), 0.0)


class Model:
    """The parameters: vectors of units as first and second word before, vectors and biases of classes and of units (by place)."""

    def __init__(self, words: Words, raw: bytes | None = None):
        self.words = words
        n, m = len(words.classes), len(words.members)
        # after the parameters, the sums of squares by which steps shrink
        self.shapes = [(n, DIM), (n, DIM), (CLASSES, DIM), (CLASSES,), (m, DIM), (m,), (n,), (n,), (CLASSES,), (m,)]
        if raw is not None:
            self.flat = np.frombuffer(raw, "<f4").copy()
        else:
            self.flat = np.zeros(sum(math.prod(s) for s in self.shapes), np.float32)
        self.parts, at = [], 0
        for shape in self.shapes:
            self.parts.append(self.flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)
        unigram = words.counts[words.members] + 0.5
        by_class = np.add.reduceat(unigram, words.bounds[:-1])
        self.class_share, unit_share = by_class / by_class.sum(), unigram / np.repeat(by_class, np.diff(words.bounds))
        if raw is None:
            r = np.random.default_rng(7)
            for part in (self.parts[0], self.parts[1], self.parts[2], self.parts[4]):
                part[:] = r.normal(0, 0.1, part.shape)
            self.parts[3][:], self.parts[5][:] = np.log(self.class_share), np.log(unit_share)
            for part in self.parts[6:]:
                part[:] = 1.0

    def learn(self, units: np.ndarray, seed: int) -> None:
        """One pass over the tokens of whole texts, in random order."""
        r = np.random.default_rng(seed)
        one, two = contexts(units)
        classes, places = self.words.classes[units], self.words.place[units]
        class_kq = np.log(CLASS_NOISE * self.class_share).astype(np.float32)
        class_cdf, bounds = np.cumsum(self.class_share), self.words.bounds
        size = np.diff(bounds).astype(np.float32)
        unit_kq = np.log(UNIT_NOISE / size)
        order = r.permutation(len(units))
        first, second, cv, cb, uv, ub, sq1, sq2, sqc, squ = self.parts
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            a, b, c = one[at], two[at], classes[at]
            hidden = first[a] + second[b]
            # a data row should be told from noise classes, drawn for the whole batch, and those from data
            drawn = np.minimum(np.searchsorted(class_cdf, r.random(CLASS_NOISE), side="right"), CLASSES - 1)
            right = _sigmoid(np.einsum("nd,nd->n", hidden, cv[c]) + (cb - class_kq)[c]) - 1
            wrong = _sigmoid(hidden @ cv[drawn].T + (cb - class_kq)[drawn])
            g_hidden = right[:, None] * cv[c] + wrong @ cv[drawn]
            g_class = np.empty((len(at) + CLASS_NOISE, DIM + 1), np.float32)
            np.multiply(hidden, right[:, None], out=g_class[: len(at), :DIM])
            np.matmul(wrong.T, hidden, out=g_class[len(at) :, :DIM])
            g_class[: len(at), DIM], g_class[len(at) :, DIM] = right, wrong.sum(0)
            # and its unit from others of its class, drawn evenly
            pick = np.empty((len(at), 1 + UNIT_NOISE), np.int64)
            pick[:, 0] = places[at]
            pick[:, 1:] = bounds[c][:, None] + (r.random((len(at), UNIT_NOISE), np.float32) * size[c][:, None]).astype(np.int64)
            vectors = uv[pick]
            g = _sigmoid(np.einsum("nkd,nd->nk", vectors, hidden) + ub[pick] - unit_kq[c][:, None])
            g[:, 0] -= 1
            g_hidden += np.einsum("nk,nkd->nd", g, vectors)
            g_unit = np.empty((*g.shape, DIM + 1), np.float32)
            np.multiply(g[:, :, None], hidden[:, None, :], out=g_unit[:, :, :DIM])
            g_unit[:, :, DIM] = g
            _step(first, None, sq1, a, g_hidden)
            _step(second, None, sq2, b, g_hidden)
            _step(uv, ub, squ, pick.reshape(-1), g_unit.reshape(-1, DIM + 1))
            _step(cv, cb, sqc, np.concatenate([c, drawn]), g_class)

    def log10(self, one: np.ndarray, two: np.ndarray, units: np.ndarray) -> np.ndarray:
        """log10 of p(class, unit | context) of tokens, normalised over all classes and over all units of the class."""
        first, second, cv, cb, uv, ub = self.parts[:6]
        n, c = len(self.words.classes), self.words.classes[units]
        # distinct classes in contexts, in the order of contexts
        pairs, place = np.unique(((one * n + two) << 7) | c, return_inverse=True)
        context = pairs >> 7
        edge = np.append(True, context[1:] != context[:-1])[: len(pairs)]
        at, context = np.cumsum(edge) - 1, context[edge]
        hidden, classes = first[context // n] + second[context % n], (pairs & 127).astype(np.uint8)
        of_pair = np.einsum("nd,nd->n", hidden[at], cv[classes]) + cb[classes] - _log_sums(hidden, cv, cb)[at]
        order = np.argsort(classes, kind="stable")
        edges = np.searchsorted(classes[order], np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            rows, own = order[edges[k] : edges[k + 1]], slice(self.words.bounds[k], self.words.bounds[k + 1])
            of_pair[rows] -= _log_sums(hidden[at[rows]], uv[own], ub[own])
        p = self.words.place[units]
        own = np.empty(len(units), np.float32)
        for i in range(0, len(units), 16384):
            rows = slice(i, i + 16384)
            own[rows] = np.einsum("nd,nd->n", hidden[at[place[rows]]], uv[p[rows]])
        return ((own + ub[p] + of_pair[place]) / math.log(10)).astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sums(hidden: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials of each row's products with all vectors; so many rows at once as caches hold."""
    out, rows, ones = np.empty(len(hidden), np.float32), max(1, (1 << 17) // len(vectors)), np.ones(len(vectors), np.float32)
    for i in range(0, len(hidden), rows):
        logits = hidden[i : i + rows] @ vectors.T
        logits += bias
        top = logits.max(initial=0.0)
        logits -= top
        total = np.exp(logits) @ ones
        out[i : i + rows] = np.log(np.maximum(total, np.float32(1e-38))) + top
        low = np.flatnonzero(total < 1e-30)  # rows far below the largest
        if len(low):
            own = logits[low].max(1)
            out[i + low] = np.log(np.exp(logits[low] - own[:, None]).sum(1)) + own + top
    return out


def _step(vectors: np.ndarray, bias: np.ndarray | None, squares: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """A step down the rows' summed gradients, the smaller the more a row has moved; the last column is the bias'."""
    order = np.argsort(rows.astype(np.uint16 if len(vectors) <= 1 << 16 else np.uint32), kind="stable")  # a radix sort, if small
    sorted_ = rows[order]
    edge = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    at, g = sorted_[edge], np.add.reduceat(g[order], edge, axis=0)
    squares[at] += (g * g).mean(1)
    g *= (RATE / np.sqrt(squares[at]))[:, None]
    vectors[at] -= g[:, :DIM]
    if bias is not None:
        bias[at] -= g[:, DIM]


def _units(blocks: Blocks, words, learns, learners: int) -> DataFrame:
    """The training documents' units, dealt to rounds and learners."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                x = Tokens(payload.as_buffer(), learns)
                units = x.units(words.value)[x.place].astype("<u4")
                # a document's round comes from its place in the block
                chosen = np.flatnonzero(x.learn)
                turn = np.empty(len(chosen), np.int64)
                turn[np.random.default_rng(block % 2**32).permutation(len(chosen))] = np.arange(len(chosen)) % ROUNDS
                of_doc = np.full(len(x.ids), -1)
                of_doc[chosen] = turn
                of_token = of_doc[x.row]
                rows = [(k, units[of_token == k]) for k in range(ROUNDS)]
                rows = [(k, u) for k, u in rows if len(u)]
                learner = ((block >> 32) * 2654435761 + (block & 0xFFFFFFFF)) % learners
                pack = zstandard.ZstdCompressor(level=1).compress
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], pa.int32()), pa.array([learner] * len(rows), pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([pack(u.tobytes()) for _, u in rows], pa.binary())],
                    names=["round", "learner", "block", "payload"],
                )

    return blocks.read().mapInArrow(tidy(run), "round int, learner int, block long, payload binary")


def _learned(rows: DataFrame, words, raw, round_: int, passes: int) -> DataFrame:
    """What each learner makes of the model ``raw`` out of its rows: its parameters in slices, and the tokens that it saw."""

    def run(batches):
        model, tokens, learner = Model(words.value, raw.value), 0, None
        for batch in batches:
            for learner, block, payload in zip(batch.column("learner").to_pylist(), batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                units = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "<u4").astype(np.int64)
                for k in range(passes):
                    model.learn(units, [round_, k, block >> 32, block & 0xFFFFFFFF])
                tokens += len(units)
        if tokens:
            parts = np.array_split(model.flat, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([learner] * SLICES, pa.int32()), pa.array([tokens] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "learner", "tokens", "payload"]
            )

    return rows.mapInArrow(tidy(run), "slice int, learner int, tokens long, payload binary")


def _mean(batches):
    """The mean of each slice, weighted by tokens; rows stand by slice and learner."""
    own, total, seen = None, 0.0, 0
    for batch in batches:
        for k, tokens, payload in zip(*(batch.column(c).to_pylist() for c in ("slice", "tokens", "payload"))):
            if k != own and own is not None:
                yield _slice(own, total / seen)
                total, seen = 0.0, 0
            own, total, seen = k, total + np.frombuffer(payload, "<f4").astype(float) * tokens, seen + tokens
    if own is not None:
        yield _slice(own, total / seen)


def _slice(k: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([values.astype("<f4").tobytes()], pa.binary())], names=["slice", "payload"])


def trained(blocks: Blocks, words: Words, learns, tokens: int) -> bytes:
    """The parameters after all rounds."""
    spark = blocks.spark
    learners = min(LEARNERS, max(1, tokens // LEARNER_TOKENS))
    passes = max(1, min(PASSES, LEAST_TOKENS // max(tokens, 1)))
    shared = spark.sparkContext.broadcast(words)
    rows = stored(blocks.few(_units(blocks, shared, learns, learners)), f"{blocks.root}/units")
    raw = Model(words).flat.tobytes()
    for k in range(ROUNDS if tokens else 0):
        model = spark.sparkContext.broadcast(raw)
        own = rows.where(F.col("round") == k).repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", "block")
        slices = _learned(own, shared, model, k, passes)
        # as many bytes as the model has
        found = slices.repartitionById(min(SLICES, blocks.buckets), F.col("slice") % min(SLICES, blocks.buckets)).sortWithinPartitions("slice", "learner").mapInArrow(_mean, "slice int, payload binary").collect()
        raw = b"".join(r["payload"] for r in sorted(found, key=lambda r: r["slice"])) if found else raw
        model.unpersist()
    return raw


def lm_scores(docs: DataFrame, learns, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (the model's).

    ``learns(id)`` says of an id (the smallest integer for null) whether its documents are training documents.
    """
    blocks = Blocks(docs, "words", id_col, text_col)
    spark, buckets = blocks.spark, blocks.buckets

    def counted(block, payload):
        x = Tokens(payload, learns)
        yield from split(WORDS, buckets, x.keys, x.counts, x.bins)

    answers = stored(blocks.few(answered(blocks.send(counted), _merge, buckets)), f"{blocks.root}/counts")
    summaries, answers = answers.where(F.col("block") == SUMMARY), answers.where(F.col("block") != SUMMARY)
    per_bin = {r["bin"]: (r["n"], r["words"]) for r in summaries.mapInArrow(_sums, "bin int, n long, words long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()}
    n_all, v_all = (sum(v[i] for v in per_bin.values()) for i in (0, 1))
    # at most 1 / SHARE rows, as their shares add up to one at most
    frequent = summaries.mapInArrow(_frequent(SHARE * n_all), "bin int, key long, n long").collect()
    frequent.sort(key=lambda r: np.int64(r["key"]).view(np.uint64))
    keys, bins, counts = (np.array([r[c] for r in frequent], np.int64) for c in ("key", "bin", "n"))
    rest, kinds = (np.array([per_bin.get(b, (0, 0))[i] for b in range(BINS)], np.int64) for i in (0, 1))
    words = Words(keys.view(np.uint64), bins, counts, rest - np.bincount(bins, counts, BINS).astype(np.int64), kinds - np.bincount(bins, minlength=BINS), per_bin.get(255, (0, 0))[0])
    shared = spark.sparkContext.broadcast((words, trained(blocks, words, learns, n_all)))

    def score(batches):
        own, raw = shared.value
        model = Model(own, raw)
        for batch in batches:
            for row in batch.to_pylist():
                x = Tokens(row["payload"], learns)
                c = answer_of(row["answers"], WORDS, "<i8").astype(float)
                units = x.units(own)
                base = np.log10((c + SMOOTH) / (n_all + SMOOTH * (v_all + 1)))
                within = own.within(units, c)
                seq = units[x.place]
                p = model.log10(*contexts(seq), seq) + within[x.place]
                n, first = np.diff(x.offsets), x.offsets[:-1]
                known = np.add.reduceat((c > 0)[x.place].astype(np.int64), first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.ids, pa.int64(), mask=x.ids == -(2**63)), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_all, np.int64)), pa.array(np.add.reduceat(base[x.place], first)), pa.array(np.add.reduceat(p, first))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return blocks.few(blocks.with_answers(answers).mapInArrow(tidy(score), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
