"""SentencePiece encoding with exact N-best segmentation, and decoding.

The lattice of a text has an edge for each piece of the model that matches there; a path's score is the
sum of its pieces' scores in the model file. Forward Viterbi gives the best score of each prefix. Those
scores are the exact cost to go of a search from the end of the text backwards, so A-star pops complete
segmentations strictly in order of score and never visits a position that no result needs.

The lattice falls apart between two characters that no piece has next to each other: before blanks,
between letters and signs, around line feeds. A text's N best segmentations deviate from its best one only
in the N - 1 parts whose second best costs least, so A-star runs for those parts, and no further than the
cost of the last of them; for the others Viterbi forwards and backwards, over arrays of many parts at a
time, gives the best and the second best score. Parts repeat (they are mostly words), so workers remember
a bounded number of them.

Ties: the segmentation whose last piece is longer comes first, then the piece before it, and so on.

A character without a piece becomes its UTF-8 bytes' pieces and costs ``UNKNOWN`` below the lowest
trained score, once a character. Runs of blanks have pieces scored -1e9 in some models; they count as
given, but not as the lowest score.

Defined results: a null or empty text has no ids, score 0 and one (empty) segmentation; a text with
fewer than N segmentations returns all it has; the character U+2581 is read as a blank, as the format
cannot tell them apart; other columns are passed through, those named like the results are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import Memory, map_batches, mix64, require, spans
from tidewatch.llm.units import UNIT_BYTES, Rows, UnitTable, ranges, text_bytes
from tidewatch.session import ship

MODEL = "piece_bpe_32k.model"
N_BEST = 4
UNKNOWN = 10.0
#: Parts that a worker remembers before it starts anew, about 80 bytes each, and parts of which it remembers
#: the segmentations found by A-star, in each of two generations.
MEMORY_PARTS, MEMORY_SEARCHED = 200_000, 20_000
#: Bytes of texts looked at together; widths of the arrays of parts, and cells (parts x width) in one. Longer parts go one by one.
SLICE, WIDTHS, CELLS = 400_000, (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64), 24_576

BLANK = "▁"
NEVER = float("-inf")


class _Path:
    """The end of a segmentation: where it starts, its score, its first piece and, linked, the path behind it. Of constant size.

    jump leads to a path further behind, at depths such that any path behind is few jumps away.
    """

    __slots__ = ("cost", "pos", "done", "packed", "tail", "depth", "jump")

    def __init__(self, cost: float, pos: int, done: float, packed: bytes, tail: _Path | None):
        self.cost, self.pos, self.done, self.packed, self.tail = cost, pos, done, packed, tail
        if tail is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, far = tail.depth + 1, tail.jump
            self.jump = far.jump if tail.depth - far.depth == far.depth - far.jump.depth else tail

    def __lt__(self, other: _Path) -> bool:
        """By cost; then by the starts of the pieces, from the last piece on, a path before those that continue it."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = self, other
        while a.depth > b.depth:
            a = a.jump if a.jump.depth >= b.depth else a.tail
        while b.depth > a.depth:
            b = b.jump if b.jump.depth >= a.depth else b.tail
        if a is b:
            return self.depth < other.depth
        while a.tail is not b.tail:  # to the first pieces from the end that differ
            if a.jump is not b.jump:
                a, b = a.jump, b.jump
            else:
                a, b = a.tail, b.tail
        return a.pos < b.pos


class _Trie:
    """The pieces' prefixes as numbered nodes, for many lookups at a time."""

    def __init__(self, prefix: dict[str, tuple[float, bytes] | None]):
        chars = sorted({c for p in prefix for c in p})
        self.n = len(chars) + 1
        self.code = np.zeros(0x110000, np.uint16)  # of a character; 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, self.n)
        self.code[ord(" ")] = self.code[ord(BLANK)]
        number = {p: k for k, p in enumerate(prefix)}
        codes = {c: k for k, c in enumerate(chars, 1)}
        self.score = np.array([v[0] if v else NEVER for v in prefix.values()])
        self.id = np.array([int.from_bytes(v[1], "little") if v else -1 for v in prefix.values()], np.int32)
        self.first = np.full(self.n, -1, np.int32)
        self.joint = np.zeros(self.n * self.n, bool)  # whether a piece has two characters next to each other
        self.more = np.zeros(len(prefix), bool)  # whether a longer prefix follows
        pairs, children = [], []
        for p, k in number.items():
            if len(p) == 1:
                self.first[codes[p]] = k
            else:
                self.joint[codes[p[-2]] * self.n + codes[p[-1]]] = True
                self.more[number[p[:-1]]] = True
                pairs.append(number[p[:-1]] * self.n + codes[p[-1]])
                children.append(k)
        self.bits = (4 * len(pairs)).bit_length()
        self.pair, self.child = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        new, child = np.array(pairs, np.int64), np.array(children, np.int32)
        slot = self._slot(new)
        while len(new):
            free = self.pair[slot] < 0
            self.pair[slot[free]], self.child[slot[free]] = new[free], child[free]
            left = self.pair[slot] != new
            new, child, slot = new[left], child[left], (slot[left] + 1) & (len(self.pair) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (mix64(pairs.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that follow, -1 where there is none."""
        pairs = nodes.astype(np.int64) * self.n + codes
        out, left, slot = np.full(len(pairs), -1, np.int32), np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            there = self.pair[slot]
            hit = there == pairs[left]
            out[left[hit]] = self.child[slot[hit]]
            on = ~hit & (there >= 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.pair) - 1)
        return out


class Lattice:
    """The pieces of a model, and the segmentations of texts by them."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        self.prefix: dict[str, tuple[float, bytes] | None] = {}  # a piece: its score and packed id; only the start of one: None
        self.bytes_of: list[bytes] = []
        self.byte_ids: list[int] = [sp.unk_id()] * 256
        lowest, whole = 0.0, []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                whole.append((piece, sp.get_score(i), i))
        for piece, score, i in whole:
            for k in range(1, len(piece)):
                self.prefix.setdefault(piece[:k], None)
            if score > -1e8:
                lowest = min(lowest, score)
            self.prefix[piece] = (score, i.to_bytes(4, "little"))
        self.unknown = lowest - UNKNOWN
        self.trie = _Trie(self.prefix)
        self.longest = max(map(len, self.prefix))
        self.id_bytes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.id_start = np.cumsum(self.id_bytes) - self.id_bytes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.remember(MEMORY_PARTS)
        self.searched = Memory(MEMORY_SEARCHED)

    def remember(self, parts: int) -> None:
        """Set how many parts are remembered."""
        self.table, self.known, self.ids = UnitTable(parts), Rows(best=np.float64, loss=np.float64, at=np.int64, count=np.int32), Rows(ids=np.uint32)

    def _lattice(self, part: str) -> tuple[list[float], list, list]:
        """Forward Viterbi: the best score of each prefix, its last edge, and all edges (start, end, score, packed ids) by start.

        Of equally good last edges the first, which is the longest, is kept.
        """
        n, get = len(part), self.prefix.get
        best, by, edges = [0.0] + [NEVER] * n, [None] * (n + 1), []
        add = edges.append
        for i in range(n):
            so_far = best[i]
            for j in range(i + 1, n + 1):
                hit = get(part[i:j], 0)
                if hit:
                    edge = (i, j, hit[0], hit[1])
                elif j == i + 1:  # no piece has just this character
                    edge = (i, j, self.unknown, b"".join([self.byte_ids[x].to_bytes(4, "little") for x in part[i].encode("utf-8", "surrogatepass")]))
                elif hit is None:
                    continue
                else:
                    break
                add(edge)
                total = so_far + edge[2]
                if total > best[j]:
                    best[j], by[j] = total, edge
                if hit == 0:
                    break
        return best, by, edges

    def best_two(self, part: str) -> tuple[float, float, bytes]:
        """Best score, what the second best costs more (inf if there is none), packed ids of the best."""
        best, by, edges = self._lattice(part)
        j = n = len(part)
        path: list = [None] * (n + 1)  # the best path's edge by its end
        while j:
            path[j] = by[j]
            j = by[j][0]
        # Any other segmentation has an edge off the best path: the best one through such an edge is second.
        back = [NEVER] * n + [0.0]
        second = NEVER
        for e in reversed(edges):
            i, j, s, _ = e
            t = back[j] + s
            if t > back[i]:
                back[i] = t
            t += best[i]
            if t > second and path[j] is not e:
                second = t
        return best[n], best[n] - second, b"".join([e[3] for e in path if e])

    def best_two_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``best_two`` gives for each part, over arrays: best scores, losses, numbers of ids, all ids."""
        n = np.array([len(p) for p in parts], np.int64)
        best, loss, ids = np.empty(len(parts)), np.empty(len(parts)), [b""] * len(parts)
        alone = n > WIDTHS[-1]
        for lo, hi in zip((0, *WIDTHS), WIDTHS):
            rows = np.flatnonzero((n > lo) & (n <= hi))
            for k in range(0, len(rows), CELLS // hi):
                at = rows[k : k + CELLS // hi]
                best[at], loss[at], count, found = self._viterbi([parts[i] for i in at.tolist()], n[at], hi)
                raw, ends = found.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                for i, a, b in zip(at.tolist(), [0, *ends], ends):
                    ids[i] = raw[a:b]
                alone[at[np.unique(np.repeat(np.arange(len(at)), count)[found < 0])]] = True  # a character without a piece
        for i in np.flatnonzero(alone).tolist():
            best[i], loss[i], ids[i] = self.best_two(parts[i])
        return best, loss, np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4")

    def _viterbi(self, parts: list[str], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forwards and backwards, over arrays with a column for each part; an id is -1 for a character without a piece."""
        trie, w, deep = self.trie, len(parts), min(self.longest, width)
        codes = np.zeros((width, w), np.int64)
        column = np.repeat(np.arange(w), n)
        codes[np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n), column] = trie.code[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        # score[l - 1, i] and node[l - 1, i]: of the piece of l characters that begins at i.
        score, node = np.full((deep, width, w), NEVER), np.full((deep, width, w), -1, np.int32)
        pos = np.arange(width)[:, None]
        node[0] = trie.first[codes]
        single = np.where(node[0] >= 0, trie.score[node[0]], NEVER)
        score[0] = np.where(pos < n, np.where(single > NEVER, single, self.unknown), NEVER)
        alive = np.flatnonzero((node[0] >= 0) & (pos + 1 < n) & trie.more[node[0]])
        at, flat, top = node[0].ravel()[alive], codes.ravel(), 1
        for k in range(2, deep + 1):
            at = trie.step(at, flat[alive + (k - 1) * w])
            alive, at = alive[at >= 0], at[at >= 0]
            if not len(alive):
                break
            top = k
            score[k - 1].ravel()[alive], node[k - 1].ravel()[alive] = trie.score[at], at
            on = trie.more[at] & (alive // w + k < n[alive % w])
            alive, at = alive[on], at[on]
        best, by = np.full((width + 1, w), NEVER), np.zeros((width + 1, w), np.int8)
        best[0] = 0
        for j in range(1, width + 1):
            for k in range(min(top, j), 0, -1):  # the longest first: it is kept where another is as good
                t = best[j - k] + score[k - 1, j - k]
                by[j][t > best[j]] = k
                np.maximum(best[j], t, out=best[j])
        path, rows, j = np.zeros((width, w), np.int8), np.arange(w), n.copy()  # the length of the best path's piece by its start
        while len(rows):
            k = by[j[rows], rows]
            j[rows] -= k
            path[j[rows], rows] = k
            rows = rows[j[rows] > 0]
        # Any other segmentation has an edge off the best path: the best one through such an edge is second.
        back, second = np.full((width + 1, w), NEVER), np.full(w, NEVER)
        back[n, np.arange(w)] = 0
        for i in range(width - 1, -1, -1):
            for k in range(1, min(top, width - i) + 1):
                t = back[i + k] + score[k - 1, i]
                np.maximum(back[i], t, out=back[i])
                t += best[i]
                t[path[i] == k] = NEVER
                np.maximum(second, t, out=second)
        row, i = np.nonzero(path.T)
        k = path[i, row]
        on = node[k - 1, i, row]
        total = best[n, np.arange(w)]
        return total, total - second, np.bincount(row, minlength=w), np.where(on >= 0, trie.id[on], -1)

    def search(self, part: str, n_best: int, most: float = np.inf) -> list[tuple[float, bytes]]:
        """The ``n_best`` best segmentations of a part, best first: A-star from the end backwards.

        Of those that cost more than ``most`` above the best, none need be found.
        """
        best, _, edges = self._lattice(part)
        most += 1e-9 * (1 + abs(best[-1])) - best[-1]
        into: list[list] = [[] for _ in range(len(part) + 1)]
        for e in edges:
            into[e[1]].append(e)
        heap = [_Path(-best[-1], len(part), 0.0, b"", None)]
        out: list[tuple[float, bytes]] = []
        while heap and len(out) < n_best:
            path = heapq.heappop(heap)
            if path.pos == 0:
                ids, at = [], path
                while at.tail:
                    ids.append(at.packed)
                    at = at.tail
                out.append((path.done, b"".join(ids)))
                continue
            for i, _, s, packed in into[path.pos]:
                cost = -(best[i] + s + path.done)
                if cost <= most:
                    heapq.heappush(heap, _Path(cost, i, path.done + s, packed, path))
        return out

    def _searched(self, part: bytes, n_best: int, most: float) -> list[tuple[float, bytes]]:
        key = (part, n_best)
        self.searched.missing({key})
        bound, found = self.searched.now.get(key, (NEVER, []))
        if bound < most and len(found) < n_best:
            text = part.decode().replace(" ", BLANK)
            found = self.search(text, n_best, most)
            if any(self.raw_bytes(ids) != part for _, ids in found):
                raise ValueError(f"a segmentation does not give its part back: {text!r}")
            self.searched.now[key] = (most, found)
        return found

    def _learn(self, units: list[bytes]) -> None:
        best, loss, count, ids = self.best_two_of([u.decode().replace(" ", BLANK) for u in units])
        self.known.add(best=best, loss=loss, at=self.ids.n + np.cumsum(count) - count, count=count)
        self.ids.add(ids=ids)

    def _forget(self) -> None:
        self.known.clear()
        self.ids.clear()

    def encode(self, texts: list[str | None] | pa.Array, n_best: int, every: bool = True) -> Iterator[tuple[bytes, list[float], list[bytes]]]:
        """For each text: the packed ids of the best segmentation, the scores best first, and with ``every`` the packed ids of each.

        ``sound`` is then whether each text's best ids, as bytes, are its own (U+2581 being a blank).
        """
        self.sound = []
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        for lo, hi in spans(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE):
            yield from self._encode(texts.slice(lo, hi - lo), n_best, every)

    def _encode(self, texts: pa.Array, n_best: int, every: bool) -> Iterator[tuple[bytes, list[float], list[bytes]]]:
        blank = pa.scalar(" ", pa.large_string())
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), BLANK, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(blank, texts, pa.scalar("", pa.large_string())))
        raw, offsets = text_bytes(texts)
        whole, firsts = raw.tobytes(), offsets[:-1][np.diff(offsets) > 0]
        char = np.flatnonzero((raw & 0xC0) != 0x80)  # where characters begin
        codes = self.trie.code[np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)].astype(np.int64)
        cut = np.zeros(len(raw), bool)
        cut[firsts] = True
        cut[char[1:][~self.trie.joint[codes[:-1] * self.trie.n + codes[1:]]]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(raw)))
        short, long = np.flatnonzero(lengths <= UNIT_BYTES), np.flatnonzero(lengths > UNIT_BYTES)
        entry = self.table.look_up(raw, starts[short], lengths[short], self._learn, self._forget)
        best, loss, at, count = np.empty(len(starts)), np.empty(len(starts)), np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        for name, to in (("best", best), ("loss", loss), ("at", at), ("count", count)):
            to[short] = self.known[name][entry]
        if len(long):  # found again in each slice
            parts = [whole[a : a + n] for a, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
            place = {p: k for k, p in enumerate(dict.fromkeys(parts))}
            of = np.array([place[p] for p in parts])
            b, d, n, ids = self.best_two_of([p.decode().replace(" ", BLANK) for p in place])
            self.ids.lay(ids=ids)
            best[long], loss[long], count[long], at[long] = b[of], d[of], n[of], (self.ids.n + np.cumsum(n) - n)[of]
        ids = self.ids["ids"][ranges(at, count)]
        id_at = np.append(0, np.cumsum(count))
        back = self.all_bytes[ranges(self.id_start[ids], self.id_bytes[ids])]
        lasts = np.append(0, np.cumsum(self.id_bytes[ids]))[id_at]  # bytes decoded up to each part
        packed, bounds = ids.astype("<u4").tobytes(), np.searchsorted(starts, offsets).tolist()
        if np.array_equal(lasts[:-1], starts) and np.array_equal(back, raw):
            self.sound += [True] * len(texts)
        else:  # text by text
            self.sound += [np.array_equal(back[lasts[i] : lasts[j]], raw[a:z]) for i, j, a, z in zip(bounds[:-1], bounds[1:], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        byte_at = 4 * id_at
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own = packed[byte_at[lo] : byte_at[hi]]
            if lo == hi:
                yield own, [0.0], [own] if every else []
                continue
            score, ways = float(best[lo:hi].sum()), self._ways(whole, starts[lo:hi], lengths[lo:hi], loss[lo:hi], n_best)
            full = [own] if every else []
            for _, picks in ways[1:] if every else ():
                out, done = [], byte_at[lo]
                for i, ids_of in sorted(picks):
                    out += [packed[done : byte_at[lo + i]], ids_of]
                    done = byte_at[lo + i + 1]
                full.append(b"".join([*out, packed[done : byte_at[hi]]]))
            yield own, [score - cost for cost, _ in ways], full

    def _ways(self, whole: bytes, starts: np.ndarray, lengths: np.ndarray, costs: np.ndarray, n_best: int) -> list[tuple[float, tuple]]:
        """The cheapest deviations from the best segmentation: (loss, ((part, packed ids), ...))."""
        m = n_best - 1
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        if m < 1:
            return ways
        near = np.arange(len(costs)) if len(costs) <= m else np.flatnonzero(costs <= np.partition(costs, m - 1)[m - 1])
        near = near[np.argsort(costs[near], kind="stable")][:m]
        near = near[costs[near] < np.inf].tolist()
        most = float(costs[near[-1]]) if len(near) == m else np.inf  # the m ways with one deviation cost no more
        for i in near:
            found = self._searched(whole[starts[i] : starts[i] + lengths[i]], n_best, most)
            ways = heapq.nsmallest(n_best, [(loss + found[0][0] - f[0], picks if k == 0 else (*picks, (i, f[1]))) for loss, picks in ways for k, f in enumerate(found)])
        return ways

    def raw_bytes(self, packed: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])

    def decode(self, packed: bytes) -> str:
        raw = self.raw_bytes(packed)
        return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


_LATTICES: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    return _LATTICES.get(model) or _LATTICES.setdefault(model, Lattice(model))


def _offsets(lengths: list[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *lengths]), pa.int32())


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    return pa.ListArray.from_arrays(_offsets([len(w) // 4 for w in packed]), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(df: DataFrame, *, text_col: str = "text", model: str = MODEL, n_best: int = N_BEST, ids: bool = True, best: bool = False, memory_parts: int = MEMORY_PARTS) -> DataFrame:
    """The rows of ``df`` with

    n_tokens long, score double, nbest_scores array<double> (best first), ids_crc32 long (of the best ids
    as little-endian unsigned 32-bit integers), round_trip boolean (the decoded ids, compared with the text, give it
    back, U+2581 being read as a blank), exact boolean (they are the given text, U+2581 and all),
    with ``ids`` nbest array<array<int>>: the ids of each segmentation, and with ``best`` ids array<int>:
    those of the best one. memory_parts: parts that a worker remembers, about 100 bytes each; more save
    time where new words are frequent.
    """
    require(df, text_col)
    ship(df.sparkSession)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("nbest_scores", T.ArrayType(T.DoubleType())), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("exact", T.BooleanType())]
    if ids:
        fields.append(T.StructField("nbest", T.ArrayType(T.ArrayType(T.IntegerType()))))
    if best:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    df = df.drop(*[f.name for f in fields])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        if lat.table.size != memory_parts:
            lat.remember(memory_parts)
        for b in batches:
            texts = b.column(at)
            for lo, hi in spans(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE):
                packed, scores, every = zip(*lat.encode(texts.slice(lo, hi - lo), n_best, ids), strict=True)
                cols = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([x[0] for x in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(map(zlib.crc32, packed), pa.int64()), pa.array(lat.sound), pc.and_(pa.array(lat.sound), pc.invert(pc.match_substring(texts.slice(lo, hi - lo).fill_null(""), BLANK)))]
                if ids:
                    cols.append(pa.ListArray.from_arrays(_offsets([len(x) for x in every]), _id_lists([w for x in every for w in x])))
                if best:
                    cols.append(_id_lists(packed))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), *cols], names=[*b.schema.names, *(f.name for f in fields)])

    return map_batches(df, run, fields)


def decode(df: DataFrame, *, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows of ``df`` with ``decoded`` string: the text of the ids. Null ids: null; ids out of range, or null among the ids, raise."""
    require(df, ids_col)
    ship(df.sparkSession)
    df = df.drop("decoded")
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for b in batches:
            out = [None if x is None else lat.decode(np.array(x, "<u4").tobytes()) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return map_batches(df, run, [T.StructField("decoded", T.StringType())])
