"""Damage is reported: stores with lost or changed parts, texts that their ids do not give back."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import pieces, token_store


@pytest.fixture()
def store(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 900)))) for i in range(200)] + [(1000 + i, "the same long passage " * 300) for i in range(60)]
    return token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"{tmp_path}/store")


def rewrite(spark, path, name, change):
    """Read a table of the store, change it, and put it back."""
    df = spark.read.parquet(f"{path}/{name}")
    kept = spark.createDataFrame(change(df).collect(), df.schema)
    kept.write.mode("overwrite").parquet(f"{path}/{name}")


def verified(spark, path):
    return {r["doc_id"]: r["verified"] for r in token_store.read_digests(spark, path).collect()}


def test_a_sound_store(spark, store):
    assert len(verified(spark, store)) == 260 and all(verified(spark, store).values())
    assert token_store.read_documents(spark, store).count() == 260
    manifest = spark.read.parquet(f"{store}/manifest").first()
    assert manifest["documents"] == 260 and manifest["width"] == 2
    assert all(r["sound"] for r in token_store.check_parts(spark, store).collect())


def test_a_lost_recipe(spark, store):
    before = {r["doc_id"]: r["start"] for r in token_store.read_digests(spark, store).collect()}
    rewrite(spark, store, "recipes", lambda df: df.where("doc_id is null or doc_id not in (17, 101)"))
    parts = {r["part"]: r["sound"] for r in token_store.check_parts(spark, store).collect()}
    assert not all(parts.values())
    found = {r["doc_id"]: r for r in token_store.read_digests(spark, store).collect()}
    assert len(found) == 258 and not found[18]["verified"] and all(r["start"] == before[i] for i, r in found.items())
    with pytest.raises(ValueError, match="manifests"):
        token_store.read_documents(spark, store)


def test_a_lost_part_and_a_lost_manifest(spark, store):
    first = spark.read.parquet(f"{store}/recipes").agg(F.min("part")).first()[0]
    rewrite(spark, store, "recipes", lambda df: df.where(F.col("part") != first))
    assert not any(verified(spark, store).values())
    with pytest.raises(ValueError, match="manifests"):
        token_store.read_documents(spark, store)


def test_a_changed_manifest(spark, store):
    rewrite(spark, store, "recipes", lambda df: df.withColumn("n_tokens", F.when(F.col("kind") == 1, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))))
    assert not any(verified(spark, store).values())
    with pytest.raises(ValueError, match="manifests"):
        token_store.read_documents(spark, store)


def test_a_changed_manifest_of_the_store(spark, store):
    rewrite(spark, store, "manifest", lambda df: df.withColumn("documents", F.col("documents") + 1))
    assert not any(verified(spark, store).values())


def test_swapped_recipes(spark, store):
    """Two documents' rows change places: each is sound by itself, the part's root is not."""
    place = F.when(F.col("doc_id") == 3, 4).when(F.col("doc_id") == 4, 3).otherwise(F.col("row"))
    rewrite(spark, store, "recipes", lambda df: df.withColumn("row", F.when(F.col("kind") == 0, place).otherwise(F.col("row")).cast("long")))
    assert not verified(spark, store)[3]


def test_a_lost_chunk(spark, store):
    shared = spark.read.parquet(f"{store}/recipes").where("doc_id = 1001").select(F.explode("digests").alias("digest")).first()["digest"]
    rewrite(spark, store, "chunks", lambda df: df.where(F.col("digest") != F.lit(bytes(shared))))
    found = verified(spark, store)
    assert {i for i, ok in found.items() if not ok} == set(range(1000, 1060))
    with pytest.raises(Exception, match="missing or changed"):
        token_store.read_documents(spark, store).collect()


def test_a_changed_chunk(spark, store):
    own = spark.read.parquet(f"{store}/recipes").where("doc_id = 5").select(F.explode("digests").alias("digest")).first()["digest"]
    zeros = F.unhex(F.repeat(F.lit("00"), F.length("ids")))
    rewrite(spark, store, "chunks", lambda df: df.withColumn("ids", F.when(F.col("digest") == F.lit(bytes(own)), zeros).otherwise(F.col("ids"))))
    assert {i for i, ok in verified(spark, store).items() if not ok} == {5}
    with pytest.raises(Exception, match="document 5 is missing or changed"):
        token_store.read_documents(spark, store).collect()


def test_shared_chunks_are_joined_apart(spark, store, monkeypatch):
    plain = sorted(map(tuple, token_store.read_digests(spark, store).collect()))
    monkeypatch.setattr(token_store, "HEAVY_KEYS", 10**9)  # every chunk counts as shared
    assert sorted(map(tuple, token_store.read_digests(spark, store).collect())) == plain
    assert token_store.read_documents(spark, store).count() == 260


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 8, 100, 255, 256])
def test_merkle_one_by_one(n):
    leaves = [bytes([i % 256]) * 3 for i in range(n)]
    tree = token_store.Merkle()
    for x in leaves:
        tree.add(x)
    assert tree.root() == token_store.merkle_root(leaves)


def test_texts_are_compared_one_by_one(spark, monkeypatch):
    texts = ["a▁b", "a b", None, "", "▁", "plain text", "café 中文"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    found = {r["k"]: r for r in pieces.encode(df, best=True).collect()}
    assert [found[k]["exact"] for k in range(7)] == [False, True, True, True, False, True, True]
    decoded = {r["k"]: r["decoded"] for r in pieces.decode(pieces.encode(df, best=True)).collect()}
    assert all(found[k]["exact"] == (decoded[k] == (t or "")) and found[k]["round_trip"] for k, t in enumerate(texts))


def test_a_text_that_fails_ends_nothing():
    """Ids that decode to other bytes: the text is marked, its neighbours are not."""
    lat = pieces.Lattice(pieces.MODEL)
    list(lat.encode(["good", "bad one", "good too"], 2))
    assert lat.sound == [True] * 3
    wrong = int.from_bytes(next(lat.encode(["bad one"], 1))[0][-4:], "little")
    lat.all_bytes = lat.all_bytes.copy()
    lat.all_bytes[lat.id_start[wrong] + lat.id_bytes[wrong] - 1] ^= 1  # the last byte of that piece
    out = list(lat.encode(["good", "bad one", "good too"], 2))
    assert len(out) == 3 and lat.sound == [True, False, True]
