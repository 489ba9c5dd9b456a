"""Blocks of vectors are bounded by bytes, whatever the vectors' length, and the bound changes no result."""

import numpy as np

from tidewatch.llm import embeddings


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for dim in (4, 600):  # 600 doubles are 4,800 bytes
        base = rng.normal(size=(6, dim))
        for k in range(60):
            rows.append((len(rows), (base[k % 6] + rng.normal(size=dim) * 0.05).tolist()))
    rows += [(len(rows), rows[0][1]), (None, rows[70][1]), (900, None), (901, [0.0] * 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    for block_bytes in (embeddings.BLOCK_BYTES, 40_000, 4_800, 100):  # the last: a vector is a block
        out = embeddings.embedding_dedup(df, block_bytes=block_bytes).collect()
        seen.append(sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=str))
    assert seen[0] == seen[1] == seen[2] == seen[3] and len(seen[0]) == len(rows)
    x = {k: embeddings.unit(np.array([v]))[0] for k, v in rows if k is not None and v is not None and any(v)}
    want = {k: sum(j != k and len(x[j]) == len(x[k]) and x[j] @ x[k] >= 0.9 for j in x) for k in x}
    extra = embeddings.unit(np.array([rows[70][1]]))[0]
    want = {k: n + int(len(x[k]) == 600 and x[k] @ extra >= 0.9) for k, n in want.items()}
    assert {k: n for k, n, *_ in seen[0] if k in want} == want
