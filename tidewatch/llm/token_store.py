"""Token ids in a content-addressed store.

Documents are encoded, an end id is appended, and a rolling hash over the ids cuts the stream into
chunks wherever its top bits are zero, so equal passages give equal chunks wherever they stand. The
store has three tables of Parquet files:

``chunks``   digest (sha256 of the packed ids), n, ids (little-endian, 2 bytes an id if the vocabulary
             allows, else 4): each distinct chunk once.
``recipes``  in ascending doc_id order over the files: kind 0 = a document (doc_id, part, row, start in
             the part, n_tokens, the digests of its chunks, their Merkle root); kind 1 = the manifest at
             the end of each part (documents, ids, Merkle root of the documents' roots).
``manifest`` one row for the store: parts, documents, ids, Merkle root of the parts' roots, bytes of an id.

Reading verifies: every recipe's rows and roots are held against its part's manifest and those against the
store's (``check_parts``), every chunk against its digest and length, every document against its Merkle root.
``read_documents`` rebuilds all ids and raises where anything is missing or changed; ``read_digests`` marks such
documents (all of a part whose manifest does not fit, all of a store whose own does not) and combines chunk
checksums along the recipes, so that ids are not shuffled again for a checksum.

Defined results: a null text is empty (one end id); rows that repeat a doc_id are documents of their own,
next to each other; a null doc_id comes first; the tokenizer's special strings in a text
have their own ids, as in the library's plain call; an empty table gives an empty store; extra columns are not stored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import HEAVY_KEYS, mix64, require, spans
from tidewatch.llm.units import UNIT_BYTES, Rows, UnitTable, ranges, text_bytes
from tidewatch.session import checkpoint_dir, ship

TOKENIZER = "byte_bpe_50k.json"
#: Chunk lengths in ids: at least, aimed at (a power of two) and at most.
CHUNK_MIN, CHUNK_AIM, CHUNK_MAX = 64, 256, 1024
#: Units of texts that a worker remembers before it starts anew: about 60 bytes each. Bytes of texts looked at together.
#: Units in one call of the tokenizer.
MEMORY_UNITS, SLICE, LINES = 1_500_000, 1_000_000, 100

_GEAR = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
_LETTER, _SIGN, _WHITE, _OTHER = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)  # control characters stay 0, as what may be white space does
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
_KIND[48:58] = _KIND[0x80:] = _OTHER
_KIND[[32, *range(9, 14)]] = _WHITE
#: A word of letters; and units that may stand on lines of their own in one call: no white space but a first blank, no character that may be some.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+").fullmatch
_PLAIN = re.compile(rb" ?(?:[!-~]|[\xc3-\xc8][\x80-\xbf])+").fullmatch


def unit_starts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the units of UTF-8 texts, which follow each other in ``raw`` from ``texts`` on, begin.

    A unit has the same tokens alone as in its text. The pre-tokenizer's pattern takes a run of letters,
    of digits or of signs with a blank before it, an apostrophe with the letters of a contraction, or white
    space up to the last one before a word. So a token always ends where white space follows anything
    else, after a single line feed, between a letter and an ASCII sign, and between an ASCII sign other
    than the apostrophe and a letter. Letters here are those of ASCII and U+00C0 to U+023F; next to a
    character that may be white space there are no units. So cuts may be missing, but none is wrong.
    """
    kind = _KIND[raw]
    high = np.flatnonzero(raw >= 0xC2)  # first bytes of characters beyond ASCII
    high = high[high + 1 < len(raw)]
    lead, second = raw[high], raw[high + 1]
    letters = high[(lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((second == 0x97) | (second == 0xB7)))]
    kind[letters] = kind[letters + 1] = _LETTER
    kind[high[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0))] + 1] = 0
    three = high[(lead >= 0xE1) & (lead <= 0xE3) & (high + 2 < len(raw))]
    lead, second, third = raw[three], raw[three + 1], raw[three + 2]
    spaces = (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (second == 0x81) & (third == 0x9F)
    kind[three[(lead == 0xE1) & ((second == 0x9A) | (second == 0xA0)) | (lead == 0xE2) & spaces | (lead == 0xE3) & (second == 0x80)] + 2] = 0
    cut = np.zeros(len(raw), bool)
    cut[texts] = True
    before, letter, sign = kind[:-1], kind == _LETTER, kind == _SIGN
    cut[1:] |= (before != _WHITE) & (before != 0) & (kind[1:] == _WHITE)
    cut[1:] |= (raw[:-1] == 10) & cut[:-1] & (letter | sign)[1:]
    cut[1:] |= letter[:-1] & sign[1:] | sign[:-1] & (raw[:-1] != 39) & letter[1:]
    return np.flatnonzero(cut)


class Encoder:
    """Whole texts to ids. Texts are cut into units (see ``unit_starts``); only units not met lately go through the tokenizer."""

    def __init__(self, tokenizer: str, size: int = MEMORY_UNITS):
        # Spark runs a worker for each core; the library's own threads would only wait for each other and hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        self.kind = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.table, self.known = UnitTable(size), Rows(at=np.int64, count=np.int32)
        self.ids = Rows(ids=self.kind)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # Only the pre-tokenizer that unit_starts knows may be cut; with any other, a text is one unit.
        pre = self.pre = self.tok.pre_tokenizer
        self.cuts = self.tok.normalizer is None and str(pre) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 and self.cuts else None
        # A word of letters is one piece of the pattern, which then need not be matched.
        self.by_line = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), LINES) for e in self.tok.encode_batch_fast(texts[i : i + LINES], add_special_tokens=False)]

    def _lines(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of units that share calls, one on a line, and where in the ids theirs begin; and the ids."""
        calls = [b"\n".join([*units[i : i + LINES], b""]).decode() for i in range(0, len(units), LINES)]
        ids = np.fromiter(chain.from_iterable(self._library(calls)), self.kind)
        feeds = np.flatnonzero(ids == self.feed)
        count = np.diff(feeds, prepend=-1) - 1
        return count, feeds - count, ids

    def _tokens(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each unit and all ids."""
        how = np.zeros(len(units), np.int8)
        if self.feed is not None:
            how[:] = [2 if _WORD(u) else 1 if _PLAIN(u) else 0 for u in units]
        count, at, found, size = np.empty(len(units), np.int64), np.empty(len(units), np.int64), [], 0
        for k in (0, 1, 2):
            rows = np.flatnonzero(how == k)
            own = [units[i] for i in rows.tolist()]
            if k == 0:
                ids = self._library([u.decode("utf-8", "replace") for u in own])
                n = np.array([len(x) for x in ids], np.int64)
                starts, ids = np.cumsum(n) - n, np.fromiter(chain.from_iterable(ids), self.kind)
            else:
                if k == 2:
                    self.tok.pre_tokenizer = self.by_line
                try:
                    n, starts, ids = self._lines(own)
                finally:
                    if k == 2:
                        self.tok.pre_tokenizer = self.pre
            count[rows], at[rows] = n, size + starts
            found.append(ids)
            size += len(ids)
        return count, np.concatenate(found)[ranges(at, count)]

    def _learn(self, units: list[bytes]) -> None:
        count, ids = self._tokens(units)
        self.known.add(at=self.ids.n + np.cumsum(count) - count, count=count)
        self.ids.add(ids=ids)

    def _forget(self) -> None:
        self.known.clear()
        self.ids.clear()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text and all ids; null is the empty text."""
        raw, offsets = text_bytes(texts)
        whole, firsts = raw.tobytes(), offsets[:-1][np.diff(offsets) > 0]
        if not len(firsts):
            return np.zeros(len(texts), np.int64), np.empty(0, self.kind)
        starts = unit_starts(raw, firsts) if self.cuts else firsts
        if any(t in whole for t in self.special):  # their texts are one unit: what they part is for the library to say
            text_of = np.searchsorted(firsts, starts, "right") - 1
            special = np.array([any(t in whole[a:b] for t in self.special) for a, b in zip(firsts, np.append(firsts[1:], len(raw)), strict=True)])
            starts = starts[~special[text_of] | np.isin(starts, firsts)]
        lengths = np.diff(np.append(starts, len(raw)))
        short = np.flatnonzero(lengths <= UNIT_BYTES)
        entry = self.table.look_up(raw, starts[short], lengths[short], self._learn, self._forget)
        counts, at = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        counts[short], at[short] = self.known["count"][entry], self.known["at"][entry]
        long = np.flatnonzero(lengths > UNIT_BYTES)
        if len(long):
            n, ids = self._tokens([whole[a : a + k] for a, k in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)])
            self.ids.lay(ids=ids)  # for this slice only
            counts[long], at[long] = n, self.ids.n + np.cumsum(n) - n
        out = self.ids["ids"][ranges(at, counts)]
        ends = np.append(0, np.cumsum(counts))[np.searchsorted(starts, offsets)]
        return np.diff(ends), out


def _marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last 16 ids, each shifted by its age, allows a chunk to end."""
    h = _GEAR[ids.astype(np.int64) & 0xFFFF]
    for s in (1, 2, 4, 8):
        older = h[:-s] << np.uint64(s)
        h = h.copy()
        h[s:] += older
    return np.flatnonzero((h >> np.uint64(64 - CHUNK_AIM.bit_length() + 1)) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    ends, start = [], 0
    for m in [*marks, n]:
        while m - start > CHUNK_MAX:
            start += CHUNK_MAX
            ends.append(start)
        if m - start >= CHUNK_MIN or (m == n and m > start):
            ends.append(m)
            start = m
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. Each end but the last depends on the ids near it and on the chunk's start only.

    As no chunk but the last is shorter than ``CHUNK_MIN``, marks of streams that follow each other serve each of them.
    """
    return _ends(_marks(ids).tolist(), len(ids))


def merkle_root(leaves: list[bytes]) -> bytes:
    """sha256 tree: leaves and inner nodes have different prefixes, an odd node moves up. No leaves: sha256 of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    if not level:
        return hashlib.sha256(b"").digest()
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Merkle:
    """``merkle_root`` of leaves that come one by one: the roots of full subtrees are held, one for each bit of the count."""

    def __init__(self):
        self.n, self.full = 0, []

    def add(self, leaf: bytes) -> None:
        node, n = hashlib.sha256(b"\0" + leaf).digest(), self.n
        while n & 1:
            node, n = hashlib.sha256(b"\1" + self.full.pop() + node).digest(), n >> 1
        self.full.append(node)
        self.n += 1

    def root(self) -> bytes:
        if not self.full:
            return merkle_root([])
        node = self.full[-1]
        for left in reversed(self.full[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


# -- checksums of concatenations -------------------------------------------------------------------


def _zero_tables() -> list[np.ndarray]:
    """For each k: what 2**k zero bytes do to a crc32, as four tables of 256 entries."""
    row = np.zeros(32, np.uint32)
    row[0] = 0xEDB88320  # the reflected polynomial of crc32
    row[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def times(m: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for i in range(32):
            out ^= np.where((x >> np.uint32(i)) & np.uint32(1), m[i], np.uint32(0))
        return out

    for _ in range(3):
        row = times(row, row)  # one bit -> one byte
    tables = []
    for _ in range(40):
        tables.append(np.stack([times(row, np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)]))
        row = times(row, row)
    return tables


_ZERO: list[np.ndarray] = []


def crc_combine(first: np.ndarray, second: np.ndarray, second_len: np.ndarray) -> np.ndarray:
    """crc32 of concatenations from the crc32 of both halves and the bytes of the second."""
    if not _ZERO:
        _ZERO.extend(_zero_tables())
    x, n = first.astype(np.uint32), second_len.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        t = _ZERO[k]
        y = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
        x = np.where((n >> k) & 1, y, x)
    return x ^ second.astype(np.uint32)


# -- write -----------------------------------------------------------------------------------------

#: Kinds of encoded rows: a chunk with its ids, and a document whose recipe is packed in the place of ids.
CHUNK, DOCUMENT = 0, 1
_ENCODERS: dict[str, Encoder] = {}


STAGED = "kind int, digest binary, n int, ids binary"


_FIXED = struct.Struct("<?qq32s")


def pack_recipe(doc_id: int | None, n_tokens: int, root: bytes, digests: list[bytes], sizes: list[int]) -> bytes:
    return _FIXED.pack(doc_id is not None, doc_id or 0, n_tokens, root) + b"".join(digests) + np.array(sizes, "<i4").tobytes()


def unpack_recipe(raw: bytes) -> tuple[int | None, int, bytes, list[bytes], list[int]]:
    named, doc_id, n_tokens, root = _FIXED.unpack_from(raw)
    k, at = (len(raw) - _FIXED.size) // 36, _FIXED.size
    digests = [raw[i : i + 32] for i in range(at, at + 32 * k, 32)]
    return doc_id if named else None, n_tokens, root, digests, np.frombuffer(raw, "<i4", k, at + 32 * k).tolist()


def encode_batches(tokenizer: str, end_id: int):
    """Batches of (doc_id, text) to batches of ``STAGED``: the chunks of the texts, and a row for each text.

    A text's digest is made of what its row holds, so texts with the same digest may count as repeats of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
        width = enc.kind.itemsize
        for b in batches:
            for lo, hi in spans(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist(), SLICE):
                counts, ids = enc.encode(b.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                total, raw, marks = counts + 1, ids.tobytes(), _marks(ids)
                firsts = np.cumsum(total) - total
                of = np.split(marks, np.searchsorted(marks, firsts[1:], "right"))  # a mark is the end of a chunk
                digests, sizes, payload, recipes = [], [], [], []
                for doc_id, first, n, own in zip(b.column(0).slice(lo, hi - lo).to_pylist(), firsts.tolist(), total.tolist(), of, strict=True):
                    ends = _ends((own - first).tolist(), n)
                    lengths = [e - a for a, e in zip([0, *ends], ends)]
                    pieces = [raw[(first + a) * width : (first + e) * width] for a, e in zip([0, *ends], ends)]
                    digested = [hashlib.sha256(x).digest() for x in pieces]
                    digests += digested
                    payload += pieces
                    sizes += lengths
                    recipes.append(pack_recipe(doc_id, n, merkle_root(digested), digested, lengths))
                digests += [hashlib.sha256(b"document" + x).digest() for x in recipes]
                kinds = np.repeat(np.array([CHUNK, DOCUMENT], np.int32), [len(payload), len(recipes)])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(digests, pa.binary()), pa.array([*sizes, *[1] * len(recipes)], pa.int32()), pa.array(payload + recipes, pa.binary())], names=["kind", "digest", "n", "ids"])

    return run


def encode_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """The rows of ``STAGED``: the documents' chunks, and each document's recipe with its Merkle root."""
    require(df, id_col, text_col)
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode_batches(tokenizer, end_id), STAGED)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part in doc_id order: rows numbered, ids counted, the manifest at the end."""
    from pyspark import TaskContext

    part, row, start, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
    names = ["kind", "part", "row", "start", "doc_id", "n_tokens", "root", "digests", "sizes"]
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        starts = start + np.concatenate([[0], np.cumsum(n)])
        for root in b.column("root").to_pylist():
            tree.add(root)
        m = len(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(row, row + m)), pa.array(starts[:-1]), *(b.column(c) for c in names[4:])], names=names)
        row, start = row + m, int(starts[-1])
    if row:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        last = [1, part, row, 0, None, start, tree.root(), [], []]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds, strict=True)], names=names)


MANIFEST = "parts int, documents long, n_tokens long, root binary, width int"
RECIPE = "doc_id long, n_tokens long, root binary, digests array<binary>, sizes array<int>"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed recipes, each as often as it was met."""
    for b in batches:
        rows = [unpack_recipe(x) for x, n in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True) for _ in range(n)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_tokens", "root", "digests", "sizes"])


def store_encoded(encoded: DataFrame, path: str) -> str:
    """Write the tables of a store from encoded rows (``STAGED``).

    Chunks and documents pass one shuffle, in which equal chunks become one; its output is the table of
    chunks, and the documents' recipes, which are small, are then put in order.
    """
    spark = encoded.sparkSession
    n = F.when(F.col("kind") == DOCUMENT, F.sum("n")).otherwise(F.first("n")).cast("int")
    met = encoded.groupBy("kind", "digest").agg(n.alias("n"), F.first("ids").alias("ids"))
    met.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/met")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop(f"{path}/met/kind={CHUNK}")):
        if not files.rename(hadoop(f"{path}/met/kind={CHUNK}"), hadoop(f"{path}/chunks")):
            raise RuntimeError(f"the chunks could not be moved to {path}/chunks")
        packed = spark.read.schema("n int, ids binary").parquet(f"{path}/met/kind={DOCUMENT}")
    else:
        spark.createDataFrame([], "digest binary, n int, ids binary").write.parquet(f"{path}/chunks")
        packed = spark.createDataFrame([], "n int, ids binary")
    ordered = packed.mapInArrow(_recipes, RECIPE).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_number, "kind int, part int, row long, start long, doc_id long, n_tokens long, root binary, digests array<binary>, sizes array<int>").write.parquet(f"{path}/recipes")
    files.delete(hadoop(f"{path}/met"), True)
    parts = spark.read.parquet(f"{path}/recipes").where("kind = 1").select("part", "row", "n_tokens", "root").orderBy("part").collect()  # a row a file
    some = spark.read.parquet(f"{path}/chunks").select((F.length("ids") / F.col("n")).cast("int")).first()
    whole = (len(parts), sum(r["row"] for r in parts), sum(r["n_tokens"] for r in parts), merkle_root([bytes(r["root"]) for r in parts]), some[0] if some else 4)
    spark.createDataFrame([whole], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def write_store(df: DataFrame, path: str, **kw) -> str:
    """Write the documents of ``df`` as a store below ``path``, a new folder, and return the path."""
    return store_encoded(encode_documents(df, **kw), path)


# -- read ------------------------------------------------------------------------------------------


def check_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, documents, n_tokens, root, sound) as found: a part is sound if its rows are all there, in order, and their count, ids and Merkle root are its manifest's. A row for each file."""
    ship(spark)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, ids, tree, ordered, sound = None, 0, 0, Merkle(), True, False

        def found() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, n, ids, tree.root(), sound), kinds, strict=True)], names=["part", "documents", "n_tokens", "root", "sound"])

        for b in batches:
            for p, kind, row, n_tokens, root in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "row", "n_tokens", "root")), strict=True):
                if p != part:
                    if part is not None:
                        yield found()
                    part, n, ids, tree, ordered, sound = p, 0, 0, Merkle(), True, False
                if kind == 0:
                    ordered, n, ids = ordered and row == n, n + 1, ids + n_tokens
                    tree.add(root)
                else:
                    sound = not sound and ordered and (row, n_tokens, root) == (n, ids, tree.root())
        if part is not None:
            yield found()

    rows = spark.read.parquet(f"{path}/recipes").select("part", "kind", "row", "n_tokens", "root")
    return rows.repartition("part").sortWithinPartitions("part", "kind", "row").mapInArrow(check, "part int, documents long, n_tokens long, root binary, sound boolean")


def _checked(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, int, bool]]]:
    """The bytes of an id, and (part, ids, sound) of each part; no part is sound if the store's manifest does not fit them."""
    parts = check_parts(spark, path).orderBy("part").collect()  # a row a file
    kept = spark.read.parquet(f"{path}/manifest").collect()
    whole = [(len(parts), sum(r["documents"] for r in parts), sum(r["n_tokens"] for r in parts), merkle_root([bytes(r["root"]) for r in parts]))]
    good = [(r["parts"], r["documents"], r["n_tokens"], bytes(r["root"])) for r in kept] == whole
    return kept[0]["width"] if kept else 4, [(r["part"], r["n_tokens"], r["sound"] and (good or _only(r, parts))) for r in parts]


def _only(own, parts: list) -> bool:
    """Where another part is broken, the store's manifest cannot fit; a sound part stays so. Where none is, something of the whole is missing."""
    return own["sound"] and any(not r["sound"] for r in parts)


def _documents(spark: SparkSession, path: str, parts: list[tuple[int, int, bool]]) -> DataFrame:
    """The recipes with ``start`` counted over all parts, and whether their part is ``sound``. Part numbers follow doc_id order."""
    recipes, base, rows = spark.read.parquet(f"{path}/recipes"), 0, []
    own = {r["part"]: r["n_tokens"] for r in recipes.where("kind = 1").select("part", "n_tokens").collect()}  # as written: a lost recipe moves no start
    for part, ids, sound in parts:
        rows.append((part, base, sound))
        base += own.get(part, ids)
    bases = spark.createDataFrame(rows, "part int, base long, sound boolean")
    return recipes.where("kind = 0").join(F.broadcast(bases), "part").withColumn("start", F.col("start") + F.col("base")).drop("kind", "base")


def _with_chunks(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join on the digest. Chunks that very many documents share, fewer than 1,000, are broadcast, so that their references stay spread."""
    total = refs.count()
    heavy = F.broadcast(refs.groupBy("digest").count().where(F.col("count") * HEAVY_KEYS > total).select("digest"))
    light = refs.join(heavy, "digest", "left_anti").join(chunks, "digest", "left")
    return refs.join(heavy, "digest", "left_semi").join(F.broadcast(chunks.join(heavy, "digest", "left_semi")), "digest", "left").unionByName(light)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>): every document rebuilt from its recipe.

    Raises, now or when it runs, if a manifest does not fit or a chunk is missing or changed.
    """
    ship(spark)
    width, parts = _checked(spark, path)
    if not all(sound for *_, sound in parts) or (not parts and spark.read.parquet(f"{path}/manifest").where("documents > 0").count()):
        raise ValueError(f"manifests do not fit the recipes: parts {[p for p, _, sound in parts if not sound]} of {path}")
    refs = _documents(spark, path, parts).select("part", "row", "doc_id", "start", "n_tokens", F.posexplode("digests").alias("pos", "digest"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for doc_id, pieces, n in zip(b.column("doc_id").to_pylist(), b.column("pieces").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if any(x["ids"] is None or hashlib.sha256(x["ids"]).digest() != x["digest"] for x in pieces):
                    raise ValueError(f"a chunk of document {doc_id} is missing or changed")
                raw = b"".join(x["ids"] for x in pieces)
                if len(raw) != width * n:
                    raise ValueError(f"document {doc_id} has {len(raw) // width} of {n} ids")
                ids.append(np.frombuffer(raw, f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    met = _with_chunks(refs, spark.read.parquet(f"{path}/chunks").select("digest", "ids"))
    grouped = met.groupBy("part", "row", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "ids"))).alias("pieces"))
    return grouped.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(join, "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks, verified) of every document, read back from the files.

    ids_crc32: crc32 of its ids as little-endian unsigned 32-bit integers. verified: all its chunks are
    there and match their digests, its lengths add up, its Merkle root is that of its recipe, and the
    manifests of its part and of the store fit what was found.
    """
    ship(spark)
    width, parts = _checked(spark, path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests, counts = b.column("ids").to_pylist(), b.column("digest").to_pylist(), b.column("n").to_pylist()
            good = [len(x) == width * n and hashlib.sha256(x).digest() == d for x, d, n in zip(ids, digests, counts, strict=True)]
            crc = [zlib.crc32(x if width == 4 else np.frombuffer(x[: len(x) // 2 * 2], "<u2").astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(crc, pa.int64()), pa.array(good)], names=["digest", "n", "crc", "good"])

    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(check, "digest binary, n int, crc long, good boolean")
    docs = _documents(spark, path, parts)
    refs = docs.select("part", "row", F.posexplode("digests").alias("pos", "digest"))
    piece = F.struct("pos", "digest", "n", "crc", "good")
    grouped = _with_chunks(refs, chunks).groupBy("part", "row").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    grouped = grouped.join(docs.select("part", "row", "doc_id", "start", "n_tokens", "root", "sound"), ["part", "row"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column("pieces")
            at = np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy()))
            digest, n, of, good = (pieces.flatten().field(f) for f in ("digest", "n", "crc", "good"))
            digest, n, of, good = digest.to_pylist(), *(np.asarray(pc.fill_null(x, v)) for x, v in ((n, 0), (of, 0), (good, False)))
            counts, crc = np.diff(at), np.zeros(len(pieces), np.uint32)
            for k in range(int(counts.max(initial=0))):
                rows = np.flatnonzero(counts > k)
                crc[rows] = crc_combine(crc[rows], of[at[rows] + k].astype(np.uint32), 4 * n[at[rows] + k].astype(np.int64))
            spans_of = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            roots = [merkle_root(digest[lo:hi]) == root for (lo, hi), root in zip(spans_of, b.column("root").to_pylist(), strict=True)]
            bad, lengths = np.append(0, np.cumsum(~good)), np.append(0, np.cumsum(n))
            sound = np.array(roots, bool) & (np.diff(bad[at]) == 0) & (np.diff(lengths[at]) == b.column("n_tokens").to_numpy()) & b.column("sound").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc.astype(np.int64)), pa.array(counts, pa.int64()), pa.array(sound, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"])

    return grouped.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, verified boolean")


def store_path(spark: SparkSession) -> str:
    """A new folder for a store, in the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
