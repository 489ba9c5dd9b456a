"""Hard-negative mining, conversation repair and benchmark decontamination against brute force, with awkward rows."""

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewatch.llm import conversations, decontamination, mining, queries

# -- mining -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score long, dim int, key string, b int"


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(0, 3))) for i in range(420)]
    rows += [(1000 + i, list(rows[100][1]), i % 3) for i in range(40)]  # ties
    rows += [rows[7], rows[7], (200, rows[9][1], 2)]  # a repeated row, a repeated id
    rows += [(300, None, 1), (400, rows[1][1], None), (500, [1.0, None] * 3, 1), (600, [1.0, float("nan")] * 3, 1), (700, [float("inf")] * 6, 1), (800, [3e38] * 6, 1)]
    rows += [(900, [], 1), (901, [], 1), (902, [], 0), (1100, [0.5], 1), (1101, [0.75], 1), (1102, [0.5], 2)]
    rows += [(None, rows[100][1], 1), (None, rows[3][1], 0)]
    return [(i, v, lab, 1, 2, "k", 3) for i, v, lab in rows]


def brute_negatives(rows):
    seen = set()
    for i, v, lab, *_ in rows:
        if v is None or lab is None or any(x is None or not math.isfinite(x) for x in v) or sum((256 * x) ** 2 for x in v) >= 2**61:
            continue
        lab = (lab + 1) % 10 if i is not None and i % 7 == 0 else lab
        seen.add((i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)))

    def order(score, row):
        digest = hashlib.md5(" ".join([*([str(row[0])] if row[0] is not None else []), str(row[1]), ",".join(map(str, row[2]))]).encode()).digest()
        return -score, row[0] is None, row[0] or 0, digest

    out = []
    for a in seen:
        if a[0] is None or a[0] % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2])), r) for r in seen if r != a and len(r[2]) == len(a[2])), key=lambda t: order(*t))
        for p, pos in [t for t in scored if t[1][1] == a[1]][:5]:
            fit = [t for t in scored if t[1][1] != a[1] and 80 * p <= 100 * t[0] <= 100 * p][:5]
            out += [(a[0], pos[0], k, n[0], p, s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(df, F.col("id") % 100 == 0, label=label)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = vector_rows()
    want = brute_negatives(rows)
    df = spark.createDataFrame(rows, VECTORS)
    assert len(want) > 20
    assert sorted(map(tuple, mined(df).collect()), key=str) == want
    monkeypatch.setattr(mining, "BLOCK_MIN", 50)  # many blocks of rows, and of anchors
    monkeypatch.setattr(mining, "BLOCK_BYTES", 900)
    assert sorted(map(tuple, mined(df).collect()), key=str) == want


def test_hard_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], VECTORS)).collect() == []
    assert mined(spark.createDataFrame([(100, [1.0], 1, 1, 1, "", 1)], VECTORS)).collect() == []


@pytest.mark.parametrize("scale", [1, 2**22])
def test_vantage_tree(scale):
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(900, 12))).astype(np.int64) * scale
    x[300:500] = x[3]
    labels, ids, keys = rng.integers(0, 4, 900), [int(i) // 2 if i % 9 else None for i in range(900)], [b"%d" % i for i in range(900)]
    tree = mining.VantageTree(x, labels, ids, keys, leaf=32)
    opened = []
    for i in range(40):
        asked, scores = tree.ask(x[i]), x @ x[i]
        for same, low, high in ((True, None, None), (False, None, None), (False, int(scores.max()) // 3, int(scores.max()) // 2), (False, 5, 4)):
            fit = [j for j in range(900) if (labels[j] == labels[i]) == same and (low is None or low <= scores[j] <= high) and j != i]
            want = sorted((-int(scores[j]), ids[j] is None, ids[j] or 0, keys[j], j) for j in fit)[:5]
            assert asked.first(int(labels[i]), same, low, high, 5, keys[i]) == [(-w[0], w[-1]) for w in want]
        near = tree.ask(x[i])
        near.first(int(labels[i]), False, None, int(scores.min()), 5)
        opened.append(len(near.opened))
    assert min(opened) < sum(n[2] < 0 for n in tree.nodes)  # the annulus keeps leaves closed


# -- conversations ----------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, fault int, at long"


def brute_repair(rows):
    """Every sequence of edits of each conversation, with at most three insertions at a place."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: brute_conversation(r) for c, r in by.items()}


def brute_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    inserts = [list(x) for n in range(3) for x in itertools.product(["user", "assistant"], repeat=n)]
    # by dynamic search over (written initials' state), keeping every least string
    start = [(0, "", [])]
    for k in range(len(rows) + 1):
        grown = [(c + 5 * len(i), s + "I" * len(i), w + [(r, "") for r in i]) for c, s, w in start for i in inserts]
        grown = [g for g in grown if re.fullmatch("(s?(ua)*u?)", "".join(r[:1] for r, _ in g[2]))]
        if k == len(rows):
            done = [g for g in grown if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in g[2]))]
            best = min(done, key=lambda g: (g[0], g[1]))
            break
        _, role, text = rows[k]
        start = []
        for c, s, w in grown:
            start.append((c + 2, s + "D", w))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 if faults[k] == "truncated" else 0
                start += [(c + more, s + "K", w + [(role, text)]), *[(c + 1 + more, s + "R", w + [(r, text)]) for r in ("user", "assistant")]]
        start = [g for g in start if re.fullmatch("(s?(ua)*u?)", "".join(r[:1] for r, _ in g[2])) and all(r for r, _ in g[2])]
        states = {}
        for g in start:  # all strings of least cost for each state
            state = "".join(r[:1] for r, _ in g[2])
            states.setdefault((state[:1] == "s", len(state) % 2, len(state) < 2, state == ""), []).append(g)
        start = [g for gs in states.values() for g in gs if g[0] <= min(x[0] for x in gs)]
    turns = sorted({t for t, *_ in rows if t is not None})
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], sha)


def conversation_rows():
    rng = np.random.default_rng(3)
    roles, texts = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "ä"], ["Yes.", "No", "Why? ", "\t\n ", "", None, "One.\r\n", "a b!", "ja ä"]
    rows = []
    for conv in range(120):
        for turn in range(int(rng.integers(0, 6))):
            t = None if rng.random() < 0.05 else int(turn + (rng.random() < 0.2) * 3)
            rows.append((conv, t, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    rows += [(None, 1, "user", "Hm?"), (None, None, "assistant", "Oh."), (5000, 1, "user", "x."), (5000, 1, "user", "x."), (5000, 1, "assistant", "x.")]
    rows += [(6000, -3, "system", "S."), (6000, 9, "user", "U."), (6000, 10, "assistant", "A.")]
    rows += [(7000 + i, None, None, None) for i in range(3)]
    return [(*r, 9, 9) for r in rows]


def repaired(df):
    return conversations.digests(conversations.repair(conversations.damage(df)))


def test_repair_equals_brute_force(spark):
    rows = conversation_rows()
    found = {r[0]: tuple(r)[1:] for r in repaired(spark.createDataFrame(rows, TURNS).repartition(3)).collect()}
    want = brute_repair(rows)
    assert found.keys() == want.keys()
    for c in want:
        assert found[c] == want[c], c


def test_every_short_role_sequence(spark):
    """All sequences of four rows, without damage: ties between edits among them."""
    rows, want = [], {}
    for n in range(4):
        for k, combo in enumerate(itertools.product([("system", "S."), ("user", "U."), ("user", "cut"), ("assistant", "A."), ("other", "O.")], repeat=n)):
            conv = 1000 * n + k
            turns = [(t, r, f"{t}{x}") for t, (r, x) in enumerate(combo)]
            rows += [(conv, *t, 0, 0) for t in turns]
            if turns:
                want[conv] = brute_conversation(turns)
    edits = conversations.repair(conversations.intact(spark.createDataFrame(rows, TURNS)))
    assert {r[0]: tuple(r)[1:] for r in conversations.digests(edits).collect()} == want


def test_repair_long_conversation_and_nothing(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}.", 0, 0) for t in range(30_000)] + [(2, 0, "user", "x " * 200_000 + ".", 0, 0), (2, 1, "assistant", "y.", 0, 0)]
    edits = conversations.repair(conversations.intact(spark.createDataFrame(rows, TURNS)))
    found = {r["conv"]: r for r in conversations.digests(edits).collect()}
    assert found[1]["audit"] == "K" * 30_000 and found[1]["cost"] == 0 and found[2]["audit"] == "KK"
    assert found[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[:30_000]).encode()).hexdigest()
    kept = edits.where("conv = 1 and edit = 'K'")
    assert kept.count() == 30_000 and kept.agg(F.max("at")).first()[0] == 29_999
    assert repaired(spark.createDataFrame([], TURNS)).collect() == []


# -- decontamination --------------------------------------------------------------------------------

DOCS = "doc_id long, text string, words array<string>, key string, start int, at int"
ITEMS = "item_id long, text string, words int"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_decontamination(docs, items):
    out = []
    for doc, text, *_ in docs:
        w, hit, names = words_of(text), set(), set()
        for item, t, *_ in items:
            iw = words_of(t)
            n = min(10, len(iw))
            for k in range(len(iw) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[k : k + n]:
                        hit |= set(range(p, p + n))
                        names.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "The Übung of alpha-beta gamma_delta 42 words goes on; and on, AND on until the end of it."


def decontamination_rows():
    rng = np.random.default_rng(4)
    some = lambda n: " ".join(rng.choice(["on", "and", "the", "of", "end", "Ü", "x1"], n))
    items = [(1, PASSAGE), (2, "on and on"), (3, "Solo"), (4, "two words"), (5, None), (6, ""), (7, "  ;; "), (None, "no id at all for this item but eleven words in it"), (10, PASSAGE), (10, "on and on and on and on and on and on and on"), (11, "émile zola ÀÉ"), (12, some(40))]
    docs = [(1, f"x {PASSAGE} y"), (2, PASSAGE.upper()), (3, PASSAGE.replace("Ü", "ü")), (4, "on " * 50), (5, "and on " * 40), (6, None), (7, ""), (8, "solo"), (9, "solos Solo_solo"), (10, "two  WORDS two words"), (11, "twowords two; words!"), (12, " ".join(PASSAGE.split()[:9])), (13, " ".join(PASSAGE.split()[3:14])), (13, "again " + PASSAGE), (13, "again " + PASSAGE), (None, "xx no id at all for this item but eleven words in it"), (14, "Émile Zola àé"), (15, "émile ZOLA ÀÉ"), (16, items[-1][1][10:] + " " + items[-1][1]), (17, "w " * 30_000 + PASSAGE)]
    docs += [(100 + i, some(int(rng.integers(0, 200)))) for i in range(30)] + [(200 + i, f"{some(5)} {PASSAGE} {some(5)}") for i in range(40)]
    return [(i, t, None, "k", 1, 2) for i, t in docs], [(i, t, 1) for i, t in items]


def digest(spark, docs, items):
    documents, _ = decontamination.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    rows = documents.select("doc", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0)
    return sorted(map(tuple, rows.collect()), key=str)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    docs, items = decontamination_rows()
    want = brute_decontamination(docs, items)
    assert sum(r[-1] for r in want) > 45
    assert digest(spark, docs, items) == want
    long_only = [r for r in items if len(words_of(r[1])) >= 3]
    assert digest(spark, docs, long_only) == brute_decontamination(docs, long_only)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)  # everything by shuffles
    assert digest(spark, docs, items) == want


def test_decontamination_spans_and_nothing(spark):
    docs, items = decontamination_rows()
    documents, spans = decontamination.decontaminate(spark.createDataFrame(docs[:1], DOCS), spark.createDataFrame(items[:1], ITEMS))
    n = len(words_of(PASSAGE))
    assert sorted((r["start"], r["length"]) for r in spans.collect()) == [(k, 10) for k in range(2, n - 10 + 3)]
    assert documents.first()["items"] == ["1"]
    assert digest(spark, docs[:12], []) == brute_decontamination(docs[:12], [])
    assert digest(spark, [], items) == []


def test_decontamination_is_native(spark):
    documents, spans = decontamination.decontaminate(*[spark.createDataFrame(r, s) for r, s in zip(decontamination_rows(), (DOCS, ITEMS), strict=True)])
    for df in (documents, spans):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_conversation_repair", "op13_decontamination"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = con.execute(queries.MORE_ORACLES[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = queries.MORE_QUERIES[name](spark, SMALL).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and want


def test_new_queries_are_registered():
    assert {"op11_hard_negatives", "op12_conversation_repair", "op13_decontamination"} <= set(queries.MORE_QUERIES) & set(queries.MORE_ORACLES)
