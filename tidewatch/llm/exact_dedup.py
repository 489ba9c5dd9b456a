"""Exact deduplication against history through sharded minimal perfect hashes.

The distinct digests of the historical rows are dealt to shards by their leading bytes, so a shard
holds about ``SHARD_KEYS`` of them however large the history is. Each shard is one row: the level
bitmaps of a minimal perfect hash (keys alone at their position in a level take it, the others fall
to the next level; a key's slot is the rank of its bit), and the slots, which hold the full digest and
the winner's locator. A minimal perfect hash also maps strangers to slots, hence every lookup compares
all 32 bytes. Incoming digests that are no members are grouped separately.

Defined results: a null text counts as empty; texts are equal if they are identical after lower-casing
A-Z only; the row with the largest doc_id stays (rows that repeat that doc_id all do); a null doc_id
never wins against another; other columns, whatever their names, play no part; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import crc_mod, join_with_heavy, mix64, require
from tidewatch.session import cut, ship

#: Keys of a shard, on average: about 3 MB of slots.
SHARD_KEYS = 50_000
#: Bits a key in a level of the hash. More bits: fewer levels.
GAMMA = 2.0
#: Stands for a null id in the packed locators.
NO_ID = -(2**63)

INDEX_SCHEMA = "shard long, n long, levels array<binary>, digests binary, winners binary, sizes binary"


def digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", historical: Column | None = None) -> DataFrame:
    """(doc_id long, old boolean, digest binary): sha256 of the whole text with A-Z lower-cased, in UTF-8."""
    require(df, id_col, text_col)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            out = [hashlib.sha256((v.as_buffer().to_pybytes() if (v := texts[i]).is_valid else b"").lower()).digest() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "old", "digest"])

    old = F.coalesce(historical, F.lit(False)) if historical is not None else F.lit(False)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), old.alias("old"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, old boolean, digest binary")


def shard_of(digest: Column, n_shards: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long") % F.lit(n_shards)


# -- the hash of one shard ----------------------------------------------------------------------


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    """keys: (n, 4) uint64, the digest's words. The digest is uniform already; words mix per level."""
    return mix64(keys[:, level % 4] + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) * (keys[:, (level + 1) % 4] | np.uint64(1)))


def build_mph(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """raw: n distinct 32-byte digests -> the level bitmaps, and the slot of each key (a permutation)."""
    keys = np.frombuffer(raw, "<u8").reshape(-1, 4)
    slot, left, levels, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), [], 0
    while len(left):
        size = max(64, int(len(left) * GAMMA))
        at = (_level_hash(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slot[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        levels.append(np.packbits(bits).tobytes() + size.to_bytes(8, "little"))
        left = left[~alone]
        if len(levels) > 500:
            raise ValueError("digests repeat")
    return levels, slot


def lookup_mph(levels: list[bytes], raw: bytes) -> np.ndarray:
    """The slot that the hash gives each key, -1 if no level takes it. A stranger may get a slot too."""
    keys = np.frombuffer(raw, "<u8").reshape(-1, 4)
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, level in enumerate(levels):
        size = int.from_bytes(level[-8:], "little")
        bits = np.unpackbits(np.frombuffer(level[:-8], np.uint8))[:size].astype(bool)
        at = (_level_hash(keys[left], k) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return out


# -- jobs -----------------------------------------------------------------------------------------


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest; repeats are added up before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size"))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """history (digest, winner, size), distinct digests -> one row for each shard that has keys."""
    ship(history.sparkSession)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(pdf["digest"])
        levels, slot = build_mph(raw)
        order = np.argsort(slot)
        winners = pdf["winner"].fillna(NO_ID).to_numpy(np.int64)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(pdf)], "levels": [levels], "digests": [np.frombuffer(raw, "V32")[order].tobytes()], "winners": [winners[order].tobytes()], "sizes": [pdf["size"].to_numpy(np.int64)[order].tobytes()]})

    return history.withColumn("shard", shard_of(F.col("digest"), n_shards)).groupBy("shard").applyInPandas(build, INDEX_SCHEMA)


def lookup(index: DataFrame, incoming: DataFrame, n_shards: int) -> DataFrame:
    """incoming (digest, winner, size), distinct digests -> the same with member, h_winner, h_size of the index."""
    ship(index.sparkSession)

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = len(right)
        member, winner, size = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(left) and n:
            row = left.iloc[0]
            raw = b"".join(right["digest"])
            slot = lookup_mph(list(row["levels"]), raw)
            held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
            asked = np.frombuffer(raw, "<u8").reshape(-1, 4)
            got = np.flatnonzero(slot >= 0)
            got = got[(held[slot[got]] == asked[got]).all(axis=1)]
            member[got] = True
            winner[got] = np.frombuffer(row["winners"], np.int64)[slot[got]]
            size[got] = np.frombuffer(row["sizes"], np.int64)[slot[got]]
        return pd.DataFrame({"digest": right["digest"], "winner": right["winner"].astype("Int64"), "size": right["size"], "member": member, "h_winner": winner, "h_size": size})

    asked = incoming.withColumn("shard", shard_of(F.col("digest"), n_shards))
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(probe, "digest binary, winner long, size long, member boolean, h_winner long, h_size long")


def exact_dedup(df: DataFrame, *, historical: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """All rows of ``df`` as (doc_id, keep_id, group_size, kept, text_sha256, is_repeat).

    ``historical`` says which rows make up the history that is indexed (default: an even crc32 of the
    id); the others are the incoming rows that are looked up. The groups are the same for any choice;
    is_repeat marks incoming rows whose text the history holds.
    """
    historical = crc_mod(F.col(id_col), 2) == 0 if historical is None else historical
    rows = cut(digests(df, id_col=id_col, text_col=text_col, historical=historical))
    history, incoming = cut(_grouped(rows.where("old"))), cut(_grouped(rows.where("not old")))
    # Shards bound what one task holds of either side; there are as many as the cluster has cores at least.
    n_shards = max(df.sparkSession.sparkContext.defaultParallelism, -(-max(history.count(), incoming.count()) // shard_keys))
    index = cut(build_index(history, n_shards))
    probed = lookup(index, incoming, n_shards)
    # A member joins the group of its slot, a nonmember is a group of its own. Of a digest's two rows
    # (history's and the member's, which includes it) the larger one is the whole group.
    h_winner = F.when(F.col("h_winner") > NO_ID, F.col("h_winner"))
    found = probed.select("digest", F.when(F.col("member"), F.greatest("winner", h_winner)).otherwise(F.col("winner")).alias("winner"), F.when(F.col("member"), F.col("size") + F.col("h_size")).otherwise(F.col("size")).alias("size"), "member")
    groups = cut(found.union(history.withColumn("member", F.lit(False))).groupBy("digest").agg(F.max("winner").alias("keep_id"), F.max("size").alias("group_size"), F.max("member").alias("member")))
    return join_with_heavy(rows, groups, "digest", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        (F.col("member") & ~F.col("old")).alias("is_repeat"),
    )
