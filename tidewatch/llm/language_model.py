"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (A-Z lower-cased) and one end for each text. Every token has a class, and

    P(token | context) = P(class | context) * P(token | class, context)

The ``HEAD`` commonest tokens make up classes of ``WIDTH`` by frequency; the others are in classes by
count and by their last two bytes; a class of its own holds all tokens that training has not seen, as
one event. Both factors are log-linear in hashed features of the context: the token before, the two
before, and skips to the second and third before. Features of a context meet all classes (or all words
of a head class) in one row of weights. In a tail class a token has its share of the class's counts,
(c + 0.1) each. Half of the tokens seen once, by hash, stand for unseen ones while weights are fitted.

The jobs, whose parts are each bounded:

1. Texts are cut into tokens once; documents of about ``CHUNK`` characters share a list of distinct
   words, and this is written to the shared folder.
2. Words are dealt to buckets; each chunk sends a bucket its words and counts, and gets the sums over
   all training documents back.
3. The weights start at the counts' logarithms and are fitted on all training documents in one pass. They
   are dealt by hash to parts of bounded size, whose number grows with the text, and to ``ROUNDS`` shares.
   In each round every part makes gradient steps (Adagrad with one rate for each row of weights) from
   the shared weights on its documents of that share, and the rows that changed are averaged by place.
4. Chunks meet the sums of their words and score in numpy batches.

Defined results: a null text is empty and has one token, its end; a null doc_id hashes as the empty
text; rows that repeat a doc_id are documents of their own; no training documents: every token is
unseen, base_score and score are 0; no rows give no rows; extra columns play no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import require, spans
from tidewatch.llm.units import UNIT_BYTES, Rows, UnitTable, text_bytes
from tidewatch.session import checkpoint_dir, cut, ship

#: Commonest tokens with weights of their own, and tokens of a class of them.
HEAD, WIDTH = 2_048, 64
#: Least counts of the tail's bins, and classes of a bin.
BINS, SPELLINGS = (1, 2, 4, 16), 12
HEAD_CLASSES = HEAD // WIDTH
UNSEEN = HEAD_CLASSES + len(BINS) * SPELLINGS
CLASSES = UNSEEN + 1
#: Context symbols: head tokens, then the other classes, then what stands before a text.
START = HEAD + CLASSES - HEAD_CLASSES
SYMBOLS = START + 1
#: Rows of the hashed weights of classes and of words, at least: 14 MB in all. They grow with the fourth
#: root of the text, up to ``GROWTH`` times as many: 55 MB, which each worker holds up to four times.
CLASS_ROWS, WORD_ROWS, GROWTH = 1 << 14, 1 << 15, 4
ALPHA = 0.1
CHUNK = 6_000_000
#: Characters of a part for the least tables (parts grow with the tables, as their changes do), and the least number of parts.
PART_CHARS, PARTS = 16_000_000, 4
#: Shares of the documents between which the parts are averaged, tokens of a gradient step, and the rate.
ROUNDS, BATCH, RATE = 2, 8_192, 0.3
#: Entries that a bucket of words holds, about.
BUCKET_WORDS = 500_000
#: Tokens that are scored at a time. Bytes of texts that are cut into words together.
ROWS, SLICE = 4_096, 1_000_000
NEVER = np.float32(-1e30)
END = b""


# -- the model --------------------------------------------------------------------------------------


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLINGS


def held_back(word: bytes) -> int:
    """1 for the half of the words that stand for unseen ones if seen once."""
    return zlib.crc32(word) >> 8 & 1


def tail_class(c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """The class of tokens outside the head, by their counts."""
    at = HEAD_CLASSES + (np.searchsorted(np.array(BINS), c, "right") - 1) * SPELLINGS + spelled
    return np.where(c > 0, at, UNSEEN)


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.full(1, 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h = (h ^ np.atleast_1d(p).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(29))
    return h


def features(before: list[np.ndarray], cls: np.ndarray, n_class: int = CLASS_ROWS, n_word: int = WORD_ROWS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the n_class class weights and, for tokens of head classes, rows of the n_word word weights."""
    one, two, three = before
    class_rows = [_mix(1, one), _mix(2, two), _mix(3, three), _mix(4, one, two)]
    word_rows = [_mix(5, one, cls), _mix(6, two, cls), _mix(7, three, cls)]
    return [(r % np.uint64(n_class)).astype(np.int64) for r in class_rows], [(r % np.uint64(n_word)).astype(np.int64) for r in word_rows]


def contexts(sym: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The symbols one, two and three before each token; START before a text's first."""
    at = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for k in (1, 2, 3):
        p = np.full(len(sym), START, sym.dtype)
        p[k:] = sym[:-k] if len(sym) > k else p[k:]
        p[at < k] = START
        out.append(p)
    return out


class Weights(NamedTuple):
    class_bias: np.ndarray  # (CLASSES,)
    word_bias: np.ndarray  # (HEAD_CLASSES, WIDTH)
    by_class: np.ndarray  # (CLASS_ROWS or more, CLASSES)
    by_word: np.ndarray  # (WORD_ROWS or more, WIDTH)


def _softmax(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Log-probabilities; table's rows are added to the bias (one row, or one for each token)."""
    x = table[rows[0]]
    for r in rows[1:]:
        x += table[r]
    x += bias
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


class Softmax:
    """One factor of the model over batches of tokens. Its arrays are kept, as new ones of this size cost more than the work.

    table: weights (rows, width); bias: (1 or more, width). A token's row of probabilities is in proportion
    to the product of the exponentials of its bias and its rows of weights.
    """

    def __init__(self, bias: np.ndarray, table: np.ndarray, batch: int):
        self.bias, self.table = np.atleast_2d(bias), table
        self.bias_exp, self.exp = np.exp(self.bias - self.bias.max(axis=1, keepdims=True)), np.exp(table)
        self.x, self.y = (np.empty((batch, table.shape[1]), np.float32) for _ in range(2))
        self.ones, self.line = np.ones(max(batch, table.shape[1]), np.float32), np.arange(batch)

    def products(self, rows: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each token's probabilities are in proportion to (a view of a kept array), and its sum. own: the row of the bias for each token."""
        x, y = self.x[: len(own)], self.y[: len(own)]
        np.take(self.exp, rows[0], axis=0, out=x, mode="clip")
        with np.errstate(over="ignore", invalid="ignore"):
            for r in rows[1:]:
                np.multiply(x, np.take(self.exp, r, axis=0, out=y, mode="clip"), out=x)
        np.multiply(x, self.bias_exp if len(self.bias) == 1 else np.take(self.bias_exp, own, axis=0, out=y, mode="clip"), out=x)
        total = x @ self.ones[: x.shape[1]]
        far = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
        if len(far):  # too large or small for products
            x[far], total[far] = np.exp(_softmax(self.bias[own[far]], self.table, [r[far] for r in rows])), 1
        return x, total

    def log_of(self, rows: list[np.ndarray], own: np.ndarray, true: np.ndarray) -> np.ndarray:
        """ln of the probability of the true one for each token."""
        x, total = self.products(rows, own)
        p = x[self.line[: len(own)], true] / total
        low = np.flatnonzero(p < 1e-30)
        with np.errstate(divide="ignore"):
            out = np.log(p, dtype=np.float64)
        if len(low):
            out[low] = _softmax(self.bias[own[low]], self.table, [r[low] for r in rows])[np.arange(len(low)), true[low]]
        return out


class Learner(Softmax):
    """A factor that learns: of each row of weights it has the sum of squared gradients, too."""

    def __init__(self, bias: np.ndarray, table: np.ndarray, batch: int, features: int):
        super().__init__(bias, table.copy(), batch)
        self.seen = np.ones(len(table), np.float32)
        self.sums, self.some = (np.empty((features * batch, table.shape[1]), np.float32) for _ in range(2))
        self.many = np.ones(features * batch, np.float32)

    def gradient(self, rows: list[np.ndarray], own: np.ndarray, true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of weights that the tokens have, once each, and the gradient of the loss by them (a view of a kept array)."""
        error, total = self.products(rows, own)
        np.multiply(error, np.divide(1, total, out=total)[:, None], out=error)  # the probabilities
        error[self.line[: len(own)], true] -= 1
        at = np.concatenate(rows)
        order = np.argsort(at.astype(np.uint16) if len(self.table) <= 1 << 16 else at, kind="stable")
        at, line = at[order], order % len(own)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        n, out = np.diff(starts, append=len(at)), self.sums[: len(starts)]
        np.take(error, line[starts], axis=0, out=out, mode="clip")
        few, k = np.flatnonzero((n > 1) & (n < 8)), 1
        while len(few):
            x = np.take(error, line[starts[few] + k], axis=0, out=self.some[: len(few)], mode="clip")
            out[few] += x
            k += 1
            few = few[n[few] > k]
        for i in np.flatnonzero(n >= 8).tolist():
            lo, hi = int(starts[i]), int(starts[i] + n[i])
            x = np.take(error, line[lo:hi], axis=0, out=self.some[: hi - lo], mode="clip")
            np.dot(self.many[: hi - lo], x, out=out[i])
        return at[starts], out

    def step(self, rows: list[np.ndarray], own: np.ndarray, true: np.ndarray) -> None:
        row, grad = self.gradient(rows, own, true)
        size = np.einsum("ij,ij->i", grad, grad)
        size *= 4 / grad.shape[1]
        size += self.seen[row]
        self.seen[row] = size
        np.multiply(grad, (RATE / np.sqrt(size))[:, None], out=grad)
        x = np.take(self.table, row, axis=0, out=self.some[: len(row)], mode="clip")
        np.subtract(x, grad, out=x)
        self.table[row] = x
        self.exp[row] = np.exp(x, out=x)


def log_probs(w: Weights, before: list[np.ndarray], cls: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """ln P(class | context), and for head tokens ln P(token | context)."""
    out, n_class, n_word = np.zeros(len(cls)), len(w.by_class), len(w.by_word)
    batch = min(ROWS, max(1, len(cls)))
    classes, words = Softmax(w.class_bias, w.by_class, batch), Softmax(w.word_bias, w.by_word, batch)
    for lo in range(0, len(cls), ROWS):
        c, s = cls[lo : lo + ROWS], sym[lo : lo + ROWS]
        class_rows, word_rows = features([b[lo : lo + ROWS] for b in before], c, n_class, n_word)
        out[lo : lo + ROWS] = classes.log_of(class_rows, np.zeros(len(c), np.int64), c)
        head = np.flatnonzero(c < HEAD_CLASSES)
        out[lo + head] += words.log_of([r[head] for r in word_rows], c[head], s[head] % WIDTH)
    return out


def fit_part(w: Weights, docs: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """docs: the symbols of each text -> the rows that changed and their changes, of both tables."""
    classes, words = Learner(w.class_bias, w.by_class, BATCH, 4), Learner(w.word_bias, w.by_word, BATCH, 3)
    gap = np.full(3, START, np.uint16)
    stream = np.concatenate([x for d in docs for x in (gap, d)])  # three STARTs before each text
    own = np.flatnonzero(stream != START)
    order = np.random.default_rng(seed).permutation(-(-len(own) // BATCH))
    for k in order:
        at = own[k * BATCH : (k + 1) * BATCH]
        s = stream[at].astype(np.int64)
        c = np.where(s < HEAD, s // WIDTH, s - HEAD + HEAD_CLASSES)
        class_rows, word_rows = features([stream[at - n] for n in (1, 2, 3)], c, len(w.by_class), len(w.by_word))
        classes.step(class_rows, np.zeros(len(c), np.int64), c)
        head = np.flatnonzero(c < HEAD_CLASSES)
        if len(head):
            words.step([r[head] for r in word_rows], c[head], s[head] % WIDTH)
    a, b = np.flatnonzero(classes.seen > 1), np.flatnonzero(words.seen > 1)
    return a, classes.table[a] - w.by_class[a], b, words.table[b] - w.by_word[b]


class Vocabulary:
    """head: token -> symbol; totals: sum of (c + ALPHA) of each tail class; tokens N and distinct tokens V of training."""

    def __init__(self, head: list[tuple[bytes, int]], class_counts: dict[int, tuple[int, int]], tokens: int, distinct: int):
        """class_counts: class -> (tokens, distinct tokens) of the tail."""
        self.head = {word: k for k, (word, _) in enumerate(head)}
        self.tokens, self.distinct = tokens, distinct
        counts = np.zeros(CLASSES)
        self.totals = np.ones(CLASSES)
        for k, (n, v) in class_counts.items():
            once = k < HEAD_CLASSES + SPELLINGS
            counts[k] = n * (0.5 if once else 1.0)
            counts[UNSEEN] += n * 0.5 if once else 0.0
            self.totals[k] = n + ALPHA * v
        words = np.zeros(HEAD)
        words[: len(head)] = [c for _, c in head]
        counts[:HEAD_CLASSES] = words.reshape(HEAD_CLASSES, WIDTH).sum(axis=1)
        possible = counts > 0
        possible[UNSEEN] = True
        with np.errstate(divide="ignore"):
            class_bias = np.where(possible, np.log(counts + 0.5), NEVER)
            word_bias = np.where(words > 0, np.log(words), NEVER).reshape(HEAD_CLASSES, WIDTH)
        self.start = Weights(class_bias.astype(np.float32), word_bias.astype(np.float32), np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, WIDTH), np.float32))

    def classify(self, words: list[bytes], c: np.ndarray, fitting: bool) -> tuple[np.ndarray, np.ndarray]:
        """The class and the symbol of each distinct word of a chunk."""
        sym = np.fromiter((self.head.get(x, -1) for x in words), np.int64, len(words))
        tail = np.flatnonzero(sym < 0)
        cls = sym // WIDTH
        cls[tail] = tail_class(c[tail], np.fromiter((spelling(words[i]) for i in tail), np.int64, len(tail)))
        if fitting:
            once = tail[c[tail] == 1]
            cls[once[np.fromiter((held_back(words[i]) for i in once), bool, len(once))]] = UNSEEN
        sym[tail] = HEAD + cls[tail] - HEAD_CLASSES
        return cls, sym


# -- jobs -------------------------------------------------------------------------------------------


class _Chunk:
    """Documents of about ``CHUNK`` bytes and their distinct words, in the order in which they were met; the end is the first."""

    def __init__(self) -> None:
        self.table, self.place, self.long = UnitTable(CHUNK // 8), Rows(at=np.int64), {}
        self.clear()

    def clear(self) -> None:
        self.doc_ids, self.training, self.lengths, self.ids, self.words, self.size = [], [], [], [], [END], 0
        self.long.clear()
        self._forget()
        self.table.clear()

    def _learn(self, words: list[bytes]) -> None:
        self.place.add(at=np.arange(len(self.words), len(self.words) + len(words)))
        self.words += words

    def _forget(self) -> None:
        self.place.clear()

    def add(self, doc_ids: list, training: list, texts: pa.Array) -> None:
        raw, offsets = text_bytes(texts)
        whole = raw.tobytes().lower()
        raw = np.frombuffer(whole, np.uint8)
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])[: len(raw)]))
        ends = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True)[: len(raw)])) + 1
        sizes = ends - starts
        short, long = np.flatnonzero(sizes <= UNIT_BYTES), np.flatnonzero(sizes > UNIT_BYTES)
        ids = np.empty(len(starts), np.uint32)
        entry = self.table.look_up(raw, starts[short], sizes[short], self._learn, self._forget)
        ids[short] = self.place["at"][entry]
        for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
            word = whole[a:b]
            k = self.long.get(word)
            if k is None:
                k = self.long[word] = len(self.words)
                self.words.append(word)
            ids[i] = k
        at = np.searchsorted(starts, offsets)
        self.ids.append(np.insert(ids, at[1:], 0))
        self.lengths.append(np.diff(at) + 1)
        self.doc_ids += doc_ids
        self.training += training
        self.size += len(raw) + 8 * len(doc_ids)

    def row(self, chunk: int) -> pa.RecordBatch:
        lengths, ids = np.concatenate(self.lengths), np.concatenate(self.ids)
        counts = np.bincount(ids[np.repeat(np.array(self.training, bool), lengths)], minlength=len(self.words)).astype(np.uint32)
        return pa.RecordBatch.from_pylist([{"chunk": chunk, "doc_ids": self.doc_ids, "training": self.training, "lengths": lengths, "ids": _pack(ids), "words": b"\n".join(self.words), "counts": counts.tobytes()}], _CHUNK_ARROW)


CHUNK_SCHEMA = "chunk long, doc_ids array<long>, training array<boolean>, lengths array<long>, ids binary, words binary, counts binary"
COUNTED_SCHEMA = "bucket int, asking long, words binary, c binary"
ASKED_SCHEMA = "bucket int, asking long, words binary, own binary"
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, training, text) -> a row for each chunk of documents; its id is unique over the parts.

    words: the distinct words, separated by line feeds; counts: how often training documents of the chunk
    have each; ids: the documents' words by their places in the list, compressed.
    """
    from pyspark import TaskContext

    number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
    for b in batches:
        for lo, hi in spans(pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist(), SLICE):
            chunk.add(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), b.column(2).slice(lo, hi - lo))
            if chunk.size >= CHUNK:
                yield chunk.row(number)
                chunk.clear()
                number += 1
    if chunk.doc_ids:
        yield chunk.row(number)


def _pack(ids: np.ndarray) -> bytes:
    """Four byte planes, compressed: the upper ones are nearly empty."""
    return zstandard.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_ids(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _by_bucket(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the words' order by bucket."""
    b = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    return b, np.argsort(b, kind="stable")


def count_words(chunks: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(bucket, asking, words, c) written below ``path``, and the number of buckets.

    Words are dealt to buckets by hash, about ``BUCKET_WORDS`` entries (of a word in a chunk) each. A
    chunk sends each bucket one row with its words there and its own counts; the bucket adds them up
    and answers each chunk with the sums in the same order (asking: the chunk). The row without a chunk
    has the bucket's words with their counts. A word has one entry for each chunk that has it.
    """
    entries = chunks.agg(F.sum(F.octet_length("counts") / 4)).first()[0] or 0
    buckets = max(1, -(-int(entries) // BUCKET_WORDS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, n = text.split(b"\n"), np.frombuffer(own, np.uint32)
                at, order = _by_bucket(words, buckets)
                ends = np.flatnonzero(np.diff(at[order], append=-1)) + 1
                places = np.split(order, ends[:-1])
                yield pa.RecordBatch.from_pydict({"bucket": at[order[ends - 1]].astype(np.int32), "asking": [chunk] * len(places), "words": [b"\n".join([words[i] for i in x.tolist()]) for x in places], "own": [n[x].tobytes() for x in places]})

    def answer(t: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        asked = [x.split(b"\n") for x in t.column("words").to_pylist()]
        for words, own in zip(asked, t.column("own").to_pylist(), strict=True):
            for w, n in zip(words, np.frombuffer(own, np.uint32).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        get = total.__getitem__
        sums = [np.fromiter(map(get, words), np.uint64, len(words)).tobytes() for words in asked]
        known = [w for w, n in total.items() if n]
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * (len(asked) + 1), pa.int32()), "asking": pa.array([*t.column("asking").to_pylist(), None], pa.int64()), "words": pa.array([None] * len(asked) + [b"\n".join(known) if known else None], pa.binary()), "c": pa.array([*sums, np.fromiter(map(get, known), np.uint64, len(known)).tobytes()], pa.binary())})

    asked = chunks.select("chunk", "words", "counts").mapInArrow(ask, ASKED_SCHEMA)
    asked.groupBy("bucket").applyInArrow(answer, COUNTED_SCHEMA).write.option("compression", "zstd").parquet(path)
    return chunks.sparkSession.read.schema(COUNTED_SCHEMA).parquet(path), buckets


def vocabulary(counted: DataFrame) -> Vocabulary:
    """The head (HEAD rows) and the classes' sums (CLASSES rows) go to the driver."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket its commonest words, and the sums of its words' tail classes."""
        for b in batches:
            for text, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, c = text.split(b"\n"), np.frombuffer(raw, np.uint64).astype(np.int64)
                k = tail_class(c, np.fromiter(map(spelling, words), np.int64, len(words)))
                n, v = np.bincount(k, c, CLASSES).astype(np.int64), np.bincount(k, minlength=CLASSES)
                some = np.flatnonzero(v)
                top = np.flatnonzero(c >= np.partition(c, -HEAD)[-HEAD]) if len(c) > HEAD else np.arange(len(c))
                yield pa.RecordBatch.from_pydict({"k": pa.array([*some, *([None] * len(top))], pa.int32()), "n": pa.array([*n[some], *c[top]], pa.int64()), "v": pa.array([*v[some], *([None] * len(top))], pa.int64()), "word": pa.array([*([None] * len(some)), *[words[i] for i in top.tolist()]], pa.binary())})

    sums = cut(counted.where("asking is null and words is not null").select("words", "c").mapInArrow(summarise, "k int, n long, v long, word binary"))
    head = [(bytes(r["word"]), r["n"]) for r in sums.where("k is null").orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    classes = {r["k"]: (r["n"], r["v"]) for r in sums.where("k is not null").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    tokens, distinct = sum(n for n, _ in classes.values()), sum(v for _, v in classes.values())
    for word, c in head:
        k = int(tail_class(np.array([c]), np.array([spelling(word)]))[0])
        classes[k] = (classes[k][0] - c, classes[k][1] - 1)
    return Vocabulary(head, {k: x for k, x in classes.items() if x[1]}, tokens, distinct)


def _with_counts(chunks: DataFrame, counted: DataFrame):
    """Chunks grouped with the answers of all buckets that they asked."""
    return chunks.drop("counts").groupBy("chunk").cogroup(counted.where("asking is not null").select("asking", "bucket", "c").groupBy("asking"))


def _unpack(left: pa.Table, right: pa.Table, buckets: int) -> Iterator[tuple[dict, list[bytes], np.ndarray]]:
    """The chunk, its words and their counts in all training documents."""
    for x in left.to_pylist():
        words = x["words"].split(b"\n")
        order = _by_bucket(words, buckets)[1]
        c = np.zeros(len(words), np.int64)
        answers = sorted(zip(right.column("bucket").to_pylist(), right.column("c").to_pylist(), strict=True))
        c[order] = np.concatenate([np.frombuffer(a, np.uint64) for _, a in answers]).astype(np.int64)
        yield {"doc_ids": x["doc_ids"], "training": x["training"], "lengths": np.array(x["lengths"], np.int64), "ids": _unpack_ids(x["ids"])}, words, c


def pack_changes(x: np.ndarray) -> list[bytes]:
    """Each row of changes as a scale and eight-bit steps, so within 1 / 254 of its largest change."""
    out = np.zeros(len(x), [("scale", "<f4"), ("steps", "i1", (x.shape[1],))])
    out["scale"] = np.abs(x).max(axis=1) / 127
    out["steps"] = np.rint(x / np.maximum(out["scale"], np.float32(1e-30))[:, None])
    raw, n = out.tobytes(), out.itemsize
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def unpack_changes(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), [("scale", "<f4"), ("steps", "i1", (len(rows[0]) - 4,))])
    return x["steps"] * x["scale"][:, None]


def _part_fitter(shared, seed: int):
    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = []
        for keys, lengths, sym in zip(pdf["keys"], pdf["lengths"], pdf["sym"], strict=True):
            ends = np.cumsum(np.frombuffer(lengths, np.int64))
            docs += zip(np.frombuffer(keys, np.uint32).tolist(), np.split(_unpack_ids(sym).astype(np.uint16), ends[:-1]), strict=True)
        docs.sort(key=lambda d: (d[0], d[1].tobytes()))
        a, da, b, db = fit_part(shared.value, [d for _, d in docs], seed)
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "place": np.concatenate([a, len(shared.value.by_class) + b]), "change": pack_changes(da) + pack_changes(db)})

    return part


def _averager(n_class: int):
    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        """Changes of each place, averaged over the parts that made any."""
        pdf, out = pdf.sort_values(["place", "part"]), []
        for g in (pdf[pdf["place"] < n_class], pdf[pdf["place"] >= n_class]):
            if len(g):
                place = g["place"].to_numpy()
                starts = np.flatnonzero(np.diff(place, prepend=-1))
                x = np.add.reduceat(unpack_changes(list(g["change"])), starts, axis=0)
                x /= np.diff(np.append(starts, len(g)))[:, None]
                out.append(pd.DataFrame({"place": place[starts], "change": [r.tobytes() for r in x]}))
        return pd.concat(out)

    return average


def fit_sizes(chars: float, part_chars: int = PART_CHARS) -> tuple[int, int]:
    """How many times the least tables the tables of a training text are, and its parts."""
    growth = min(GROWTH, 1 << int(np.log2(max(1.0, chars / part_chars))) // 4)
    return growth, max(PARTS, -int(-chars // (growth * part_chars)))


def deal(chunks: DataFrame, counted: DataFrame, buckets: int, vocab: Vocabulary, parts: int) -> DataFrame:
    """(part, share, keys, lengths, sym): the symbols of all training documents, those of a chunk, a part and a share in one row."""
    known = chunks.sparkSession.sparkContext.broadcast(vocab)

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for x, words, c in _unpack(left, right, buckets):
            sym, dealt = known.value.classify(words, c, True)[1].astype(np.uint16), {}
            for doc_id, trains, n, end in zip(x["doc_ids"], x["training"], x["lengths"].tolist(), np.cumsum(x["lengths"]).tolist(), strict=True):
                if trains:
                    own = sym[x["ids"][end - n : end]]
                    key = zlib.crc32(own.tobytes(), zlib.crc32(f"{doc_id}fit".encode()))
                    dealt.setdefault((key % parts, key // parts % ROUNDS), []).append((key, own))
            for (part, share), docs in dealt.items():
                out.append({"part": part, "share": share, "keys": np.array([k for k, _ in docs], np.uint32).tobytes(), "lengths": np.array([len(d) for _, d in docs], np.int64).tobytes(), "sym": _pack(np.concatenate([d for _, d in docs]))})
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("share", pa.int32()), ("keys", pa.binary()), ("lengths", pa.binary()), ("sym", pa.binary())]))

    return _with_counts(chunks, counted).applyInArrow(encode, "part int, share int, keys binary, lengths binary, sym binary")


def fit(chunks: DataFrame, counted: DataFrame, buckets: int, vocab: Vocabulary, part_chars: int) -> Weights:
    """Weights fitted on all training documents, each in one round."""
    spark = chunks.sparkSession
    growth, parts = fit_sizes(6.0 * vocab.tokens, part_chars)  # a training token is about six characters
    n_class = growth * CLASS_ROWS
    dealt = cut(deal(chunks, counted, buckets, vocab, parts))
    weights = vocab.start._replace(by_class=np.zeros((n_class, CLASSES), np.float32), by_word=np.zeros((growth * WORD_ROWS, WIDTH), np.float32))
    for k in range(ROUNDS):
        part = _part_fitter(spark.sparkContext.broadcast(weights), k)

        changes = dealt.where(F.col("share") == k).groupBy("part").applyInPandas(part, "part int, place long, change binary")
        blocks = 64 * growth * max(1, parts // 8)
        changes = changes.groupBy((F.col("place") % blocks).alias("block")).applyInPandas(_averager(n_class), "place long, change binary")
        by_class, by_word = weights.by_class.copy(), weights.by_word.copy()
        for r in changes.toLocalIterator():  # a row for each row of the tables at most
            x = np.frombuffer(r["change"], np.float32)
            if r["place"] < n_class:
                by_class[r["place"]] += x
            else:
                by_word[r["place"] - n_class] += x
        weights = weights._replace(by_class=by_class, by_word=by_word)
    return weights


def _scored(chunks: DataFrame, counted: DataFrame, buckets: int, vocab: Vocabulary, weights: Weights) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast((vocab, weights))  # HEAD words and 14 to 55 MB

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known, w = shared.value
        outs = []
        for x, words, c in _unpack(left, right, buckets):
            cls, sym = known.classify(words, c, False)
            inner = np.where((cls >= HEAD_CLASSES) & (cls < UNSEEN), np.log((c + ALPHA) / known.totals[cls]), 0.0)
            base = np.log10((c + ALPHA) / (known.tokens + ALPHA * (known.distinct + 1)))
            ids, lengths = x["ids"], x["lengths"]
            starts = np.cumsum(lengths) - lengths
            token_cls, token_sym = cls[ids], sym[ids]
            p = (log_probs(w, contexts(token_sym, lengths), token_cls, token_sym) + inner[ids]) / np.log(10)
            outs.append(pa.table({"doc_id": pa.array(x["doc_ids"], pa.int64()), "n_tokens": lengths, "n_known": np.add.reduceat((c > 0)[ids].astype(np.int64), starts), "train_tokens": np.full(len(lengths), known.tokens), "base_score": np.add.reduceat(base[ids], starts), "score": np.add.reduceat(p, starts)}))
        return pa.concat_tables(outs)

    return _with_counts(chunks, counted).applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_path(spark: SparkSession) -> str:
    """A new folder for the tokens, in the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/language-model-{uuid.uuid4().hex}"


def score_documents(df: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``training`` says which ones are learned from."""
    require(df, id_col, text_col)
    spark = df.sparkSession
    ship(spark)
    path = path or lm_path(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(_chunks, CHUNK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    counted, buckets = count_words(chunks, f"{path}/counted")
    vocab = vocabulary(counted)
    weights = vocab.start
    if vocab.tokens:
        weights = fit(chunks, counted, buckets, vocab, part_chars)
    return _scored(chunks, counted, buckets, vocab, weights)
