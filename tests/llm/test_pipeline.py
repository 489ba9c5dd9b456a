"""The pipeline against its stages by brute force, and the registry."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.test_operators import components, slow_fingerprint
from tidewatch.llm import langid, mixing
from tidewatch.llm.queries import ORACLES, QUERIES
from tidewatch.session import table


def brute_lines(rows):
    """Texts without lines that stand on over 5 % of their source's pages, three at least."""
    pages, on = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        on.update({(r["source"], x) for x in (r["text"] or "").split("\n") if x.strip(" ")})
    out = {}
    for r in rows:
        if r["text"] is None:
            out[r["doc_id"]] = None
            continue
        lines = r["text"].split("\n")
        bad = [bool(x.strip(" ")) and on[r["source"], x] >= 3 and on[r["source"], x] > 0.05 * pages[r["source"]] for x in lines]
        solid = [b for x, b in zip(lines, bad, strict=True) if x.strip(" ")]
        out[r["doc_id"]] = r["text"] if solid and all(solid) else "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)
    return out


def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{name}").collect()))
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    (raw, known), (_, lined), (_, single), (_, mixed), (_, ids) = seen
    model = langid.fit(table(spark, SMALL, "documents"))
    lang, score, _ = model.predict([r["text"] for r in raw])
    assert {r["doc_id"] for r in known} == {r["doc_id"] for r, a, s in zip(raw, lang, score, strict=True) if a != "und" and s >= langid.MIN_SCORE}
    assert {r["doc_id"]: r["text"] for r in lined} == brute_lines(known)
    assert all(r["n_chars"] == len(r["text"]) for r in lined if r["text"] is not None)
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in lined}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {r["doc_id"] for r in single} == set(components(fps, links).values())
    taken = Counter({r["doc_id"]: r["times"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/simhash")).collect() if r["times"]})
    assert Counter(r["doc_id"] for r in mixed) == taken
    assert Counter(r["doc_id"] for r in ids) == taken and all(r["round_trip"] for r in ids)
    again = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in again) == Counter((r["doc_id"], r["ids_crc32"]) for r in ids)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats, ties and clashing names go through all stages; so does an empty table."""
    docs = table(spark, SMALL, "documents")
    clash = ["n_lines", "n_dropped", "score", "lang_pred", "fp", "size", "times", "mix_hash", "copy", "line_keys", "group"]
    some = docs.orderBy("doc_id").limit(60)
    long = " ".join(r["text"] for r in docs.collect() if r["text"] and r["lang"] == "en")
    extra = [(None, docs.first()["text"], "en", "s", 1), (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, long, "en", "s", len(long)), (900_003, long, "en", "s", len(long)), (900_004, " \t\n", "en", None, 3)]
    some = some.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    some = some.select("*", *[F.lit(7).alias(c) for c in clash])
    for start in (some, some.limit(0)):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out, at = stage(spark, docs, SMALL), f"{tmp_path}/{start is some}-{k}"
            if name != "sentencepiece":
                assert out.columns == some.columns
            out.write.parquet(at)
            docs = spark.read.parquet(at)
            if name != "sentencepiece":
                assert {tuple(r[5:]) for r in docs.collect()} <= {(7,) * len(clash)}
            if name == "simhash":
                single = {r["doc_id"] for r in docs.collect()}
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= single and not ids if start is not some else len(ids) > 5 and 900_003 in single and not single & {900_001, 900_002, 900_004}


def test_registry():
    import __spark_entry__ as entry

    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 11)) and set(ORACLES) < set(QUERIES)
    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
