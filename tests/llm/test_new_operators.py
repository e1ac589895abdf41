"""Merkle manifests, periodic runs and reply trees: against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import chat, merkle, periodic, queries, shared

BASE = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- Merkle manifests


def tree_by_hand(digests, fan):
    """(root, for each leaf its segments) of one tree."""
    segments, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for k, i in enumerate(at):
            run = runs[i // fan]
            segments[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        at, level = [i // fan for i in at], [sha("".join(r)) for r in runs]
    return level[0], segments


def manifest_by_hand(rows, fields, fan=16):
    """{key: (leaf, subroot, root, segments)} of rows with the keys group, order."""
    leaf_of = lambda r: sha("".join("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in fields))
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subs.append(tree_by_hand([leaf_of(r) for r in groups[name]], fan))
    root, above = tree_by_hand([s for s, _ in subs], fan)
    return [
        (r["doc_id"], leaf_of(r), sub, root, own + up)
        for name, (sub, below), up in zip(names, subs, above, strict=True)
        for r, own in zip(groups[name], below, strict=True)
    ]


@pytest.mark.parametrize("fan", [2, 16])
def test_proofs(spark, fan, monkeypatch):
    r = random.Random(fan)
    sizes = {None: 3, "a": 1, "b": 2, "é": 300, "z": 33, "zz": 17, "Z": 1}
    rows = []
    for s, n in sizes.items():
        for k in range(n):
            rows.append({"doc_id": r.choice([None, k, k - 7]), "source": s, "text": r.choice([None, "", "ä b", f"t{k}"]), "left": "clash"})
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, left string").repartition(3)
    fields = ["doc_id", "source", "text"]
    want = sorted(map(repr, manifest_by_hand(rows, fields, fan)))
    for limit in (merkle.BROADCAST_BYTES, 0):  # ancestors broadcast, or salted
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(merkle, "SALTS", 3)
        found = merkle.proofs(df, fields, "source", "doc_id", fan=fan)
        assert found.columns == ["doc", "leaf", "subroot", "root", "proof"]
        got = found.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
        assert sorted(repr((x["doc"]["doc_id"], x["leaf"], x["subroot"], x["root"], [tuple(s) for s in x["proof"]])) for x in got) == want
        assert all(x["folded"] == x["root"] for x in got)


def test_proofs_of_little(spark):
    schema = "doc_id long, source string, text string"
    none = merkle.proofs(spark.createDataFrame([], schema), ["text"], "source", "doc_id", {"doc_id": F.col("doc_id")})
    assert none.columns == ["doc_id", "leaf", "subroot", "root", "proof"] and none.count() == 0
    one = merkle.proofs(spark.createDataFrame([(1, None, None)], schema), ["text"], "source", "doc_id").collect()
    assert [(x["leaf"], x["subroot"], x["root"], x["proof"]) for x in one] == [(sha("-"),) * 3 + ([],)]


def test_ranks_of_a_hot_group(spark):
    rows = [("h", i % 50, i) for i in range(2000)] + [(None, 1, -1), ("a", 2, -2), ("z", 0, -3)]
    df = spark.createDataFrame(rows, "g string, o long, u long").repartition(5)
    placed, n, largest = shared.ranked(df, "g", "o", "u")
    got = {(x["tree"], x["place"]): x["u"] for x in placed.collect()}
    want = {(1 if g == "a" else 2 if g == "h" else 3 if g == "z" else 0, 0): u for g, _, u in rows if g != "h"}
    want |= {(2, k): u for k, (_, u) in enumerate(sorted((o, u) for g, o, u in rows if g == "h"))}
    assert got == want and (n, largest) == (4, 2000)


def test_op11(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()]
    fields = queries.FIELDS
    want = {w[0]: w[1:] for w in manifest_by_hand(rows, fields)}
    texts = {r["doc_id"]: r for r in rows}
    got = queries.op11_merkle_manifest(spark, BASE).collect()
    assert len(got) == len(rows) == len({r["doc_id"] for r in got})
    struck = 0
    for r in got:
        leaf, subroot, root, segments = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == sha("".join(a + b for a, b in segments))
        d = texts[r["doc_id"]]
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            low = d["text"] and d["text"].translate({c: c + 32 for c in range(65, 91)})
            leaf = sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (low if f == "text" else d[f] for f in fields)))
        for a, b in segments:
            leaf = sha(a + leaf + b)
        assert (r["folded_root"], r["verified"]) == (leaf, leaf == root)
        struck += leaf != root
    assert 0 < struck < len(rows) / 2


# ---------------------------------------------------------------- periodic runs


def runs_by_hand(w):
    """All runs, by trying every period at every place."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            b = i
            while i < n and w[i] == w[i - q]:
                i += 1
            start, length = b - q, i - b + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k - p] for k in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted((s, m, q) for s, m, q in out)


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looked(texts):
    return periodic._found(pa.array(texts, type=pa.string()).cast(pa.binary())).to_pylist()


def test_runs(monkeypatch):
    r, texts = random.Random(3), [None, "", " \n", "a", "a a a a a a", "a a a a a", "ab ab\tab  ab ab\x0bab ab"]
    texts += ["aaaaaab" * 0 + " ".join(("aaaaaab" * 4)), " ".join("a" * 7 + "b" + "a" * 9 + "b" + "a" * 7 + "b"), "é è é è é è é è   x"]
    for _ in range(400):
        w = [r.choice("ab" if r.random() < 0.6 else "abcdef") for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):
            u = [r.choice("abc") for _ in range(r.randint(1, 9))]
            at = r.randrange(len(w) + 1)
            w[at:at] = (u * 9)[: r.randint(0, 9) * len(u) + r.randrange(len(u) + 1)]
        texts.append(" ".join(w))
    for size in (2 << 20, 1, 300):
        monkeypatch.setattr(periodic, "BATCH", size)
        for text, got in zip(texts, looked(texts), strict=True):
            w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            want = runs_by_hand(w)
            assert [tuple(x.values()) for x in got["runs"]] == want, text
            assert (got["n_words"], got["collapsed"]) == (len(w), collapsed_by_hand(w, want))


def test_runs_of_long_texts():
    r = random.Random(4)
    block = [f"w{r.randrange(40)}" for _ in range(5000)]
    hostile = [
        " ".join(["the"] * 300_000),
        " ".join(block * 20),
        " ".join(x for k in range(300) for x in [*["a"] * (900 + r.randrange(200)), f"s{k}"]),
        " ".join(f"w{r.randrange(3)}" for _ in range(200_000)),
    ]
    got = looked(hostile)
    assert [tuple(x.values()) for x in got[0]["runs"]] == [(0, 300_000, 1)] and got[0]["collapsed"] == "the"
    assert [tuple(x.values()) for x in got[1]["runs"] if x["period"] > 50] == [(0, 100_000, 5000)]
    assert len([x for x in got[2]["runs"] if x["period"] == 1]) == 300


def test_periodic_runs(spark):
    schema = "doc_id long, text string, found string"
    df = spark.createDataFrame([(1, "x " * 8, "clash"), (1, "x " * 8, "clash"), (None, None, None)], schema)
    got = periodic.runs(df)
    assert got.columns == ["doc_id", "text", "found"]
    assert sorted((x["found"]["n_words"], len(x["found"]["runs"]), x["found"]["collapsed"]) for x in got.collect()) == [(0, 0, ""), (8, 1, "x"), (8, 1, "x")]
    assert periodic.runs(df.limit(0)).count() == 0


def test_op12(spark):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, BASE).collect()}
    docs = spark.read.parquet(f"{BASE}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w) if n < 1500 else [tuple(x.values()) for x in looked([" ".join(w)])[0]["runs"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        r = got[d["doc_id"]]
        milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, milli)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(collapsed_by_hand(w, runs))
        some += bool(runs)
    assert some > 10


# ---------------------------------------------------------------- reply trees


def test_best_paths(spark):
    r, rows = random.Random(5), []
    for t in range(6):
        for i in range(r.choice([1, 2, 40, 90])):
            parent = None if i == 0 or r.random() < 0.05 else r.randrange(max(0, i - (2 if t == 3 else 30)), i)
            rows.append((t, i, parent, r.choice([None, 0.0, 1.0, 2.5]), r.choice(["user", "assistant", None, "tool]"]), r.choice(["", "hi", None])))
    rows += [(7, 0, 99, 1.0, "user", "an orphan"), (8, None, None, 1.0, "user", "no id"), rows[3]]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string")
    by = {(x[0], x[1]): x for x in rows}
    children = defaultdict(list)
    for x in by.values():
        if x[2] is not None:
            children[x[0], x[2]].append(x[1])

    def up(t, i):
        out = [i]
        while by[t, out[-1]][2] is not None and (t, by[t, out[-1]][2]) in by:
            out.append(by[t, out[-1]][2])
        return out[::-1]

    def ranked(t):
        leaves = [i for (u, i) in by if u == t and not children[t, i]]
        mean = lambda i: sum(by[t, k][3] or 0.0 for k in up(t, i)) / len(up(t, i))
        return sorted(leaves, key=lambda i: (-mean(i), i is not None, i or 0))

    once = df.dropDuplicates()
    for keep in (1, 3, None):
        got = defaultdict(list)
        for x in chat.paths(once.select("tree", "id", "parent", "score"), keep).collect():
            got[x["tree"], x["leaf"]].append((x["place"], x["id"]))
        want = {(t, i): list(enumerate(up(t, i))) for t in {x[0] for x in rows} for i in ranked(t)[:keep]}
        assert {k: sorted(v) for k, v in got.items()} == want
    template = chat.Template()
    made = chat.conversations(df, 2)
    back = made.withColumns({"turns": template.parsed(F.col("formatted")), "learnt": template.learnt(F.col("formatted"), F.col("mask"))})
    found = {(x["tree"], x["leaf"]): x for x in back.collect()}
    assert set(found) == {(t, i) for t in {x[0] for x in rows} for i in ranked(t)[:2]}
    for (t, i), x in found.items():
        want = [(by[t, k][4] or "", by[t, k][5] or "") for k in up(t, i)]
        assert [tuple(s) for s in x["turns"]] == want
        assert x["learnt"] == "".join(text for role, text in want if role == "assistant")
    assert chat.conversations(df.limit(0)).count() == 0


def test_replies_in_a_circle(spark):
    df = spark.createDataFrame([(1, 1, 3, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 0.0), (1, 4, None, 0.0)], "tree long, id long, parent long, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.paths(df)


def test_escapes(spark):
    r, template = random.Random(6), chat.Template()
    pieces = ["<", "s>", "</s>", "<s>", "/s>", "\\", "[", "[INST]", "[/INST]", "INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE:4A]", "[/ROLE]", "ROLE:]", " ", "x", "é😀", "\n", "$1"]
    turns = [[(r.choice(["user", "assistant", "system", "", "tool</s>", "[INST]"]), "".join(r.choices(pieces, k=r.randrange(9)))) for _ in range(r.randint(1, 6))] for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i long, turns array<struct<role: string, text: string>>")
    made = df.withColumn("p", template.pieces(F.col("turns"))).withColumn("out", template.written(F.col("p"))).select("i", "out.*")
    got = made.select("i", "formatted", template.parsed(F.col("formatted")).alias("turns"), template.learnt(F.col("formatted"), F.col("mask")).alias("learnt"))
    for x in got.collect():
        assert [tuple(t) for t in x["turns"]] == turns[x["i"]], x["formatted"]
        assert x["learnt"] == "".join(t for role, t in turns[x["i"]] if role == "assistant")


def test_turns_that_repeat(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 3, "assistant", "x"), (1, 9, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.turn_by_turn(df, "conv_id", "turn", "role", "text").withColumn("turns", chat.Template().parsed(F.col("formatted")))
    found = {x["name"]: [tuple(t) for t in x["turns"]] for x in got.collect()}
    assert found == {1: [("", ""), ("user", "a"), ("user", "b"), ("user", "b"), ("assistant", "c")], None: [("assistant", "x")]} or found[1][0] == ("", "") and sorted(found[1][1:4]) == [("user", "a"), ("user", "b"), ("user", "b")]
    assert chat.turn_by_turn(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_op13(spark):
    rows = defaultdict(list)
    for x in spark.read.parquet(f"{BASE}/conversations.parquet").collect():
        rows[x["conv_id"]].append((x["turn"], x["role"], x["text"] or ""))
    rows[-1] = [(0, "user", queries.CONTROL), (1, "assistant", queries.CONTROL)]
    got = {x["conv_id"]: x for x in queries.op13_chat_format(spark, BASE).collect()}
    assert set(got) == set(rows)
    for k, turns in rows.items():
        turns.sort()
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        x = got[k]
        assert (x["n_turns"], x["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (x["loss_chars"], x["loss_sha256"]) == (len(learnt), sha(learnt))
        assert x["formatted_chars"] > sum(len(t) for _, _, t in turns)


def test_diagonals_are_counted_by_hashes_of_whole_stretches():
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3], dtype=np.uint64)
    ends, lag = periodic._diagonals(words, np.arange(9), 3)
    assert ends.tolist() == list(range(2, 9)) and lag.tolist() == [0, 0, 0, 3, 3, 3, 3]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_periodic_runs", "op13_chat_format"])
def test_sql(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, BASE), con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    want = sql.select(",".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))


def test_languages_of_rows_that_repeat_an_id(spark):
    from orrery.llm import language_id

    one = [(7, f"der hund und die katze {i}", "de") for i in range(60)] + [(7, "the dog and the cat", "en")] * 100_000
    rows = spark.createDataFrame(one, "doc_id long, text string, lang string")
    model = language_id.fit(rows, per_language=1)
    assert sorted(n for m in model.within.values() for n in m.names) == ["de", "en"]
    got = rows.limit(100).select(language_id.predictor(rows, model).alias("p")).collect()
    assert {r["p"]["lang_pred"] for r in got} <= {"de", "en"}
    codes = spark.range(5000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("lang"))
    few = language_id.fit(codes.withColumnRenamed("id", "doc_id"), per_language=2, max_languages=5)
    assert sum(len(m.names) for m in few.within.values()) == 5


def test_toxicity_is_learnt_from_few_rows_of_an_id(spark):
    from orrery.llm import toxicity

    docs = spark.createDataFrame([(1, f"clean text {i}") for i in range(3000)] + [(2, "you vile filth")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    seen = []
    held = toxicity._logistic
    toxicity._logistic = lambda rows, y, ratios: seen.append(len(rows)) or held(rows, y, ratios)
    try:
        toxicity.fit(docs, labels, max_rows=2)
    finally:
        toxicity._logistic = held
    assert seen == [2]


def kd_by_hand(rows, caps, scale):
    """Shards of (size, y0, y1, y2) by splitting at exact weighted quantiles along the widest dimension of each box."""
    out = {}

    def split(own, first, parts, box):
        if parts == 1:
            out.update({i: first for i in own})
            return
        total, left = sum(caps[first : first + parts]), sum(caps[first : first + parts // 2])
        dim = max(range(3), key=lambda d: round((box[d][1] - box[d][0]) / scale[d], 6))
        order, want, size = sorted(own, key=lambda i: rows[i][1 + dim]), left / total * sum(rows[i][0] for i in own), 0
        cut = box[dim][1]
        for i in order:
            if size + rows[i][0] / 2 >= want:
                cut = rows[i][1 + dim]
                break
            size += rows[i][0]
        low, high = [list(box) for _ in range(2)]
        low[dim], high[dim] = (box[dim][0], cut), (cut, box[dim][1])
        split([i for i in own if rows[i][1 + dim] < cut], first, parts // 2, low)
        split([i for i in own if rows[i][1 + dim] >= cut], first + parts // 2, parts - parts // 2, high)

    box = [(min(r[1 + d] for r in rows), max(r[1 + d] for r in rows)) for d in range(3)]
    split(range(len(rows)), 0, len(caps), box)
    return [out[i] for i in range(len(rows))]


def test_the_tree_is_that_of_brute_force(spark):
    from orrery.llm import sharding

    r = random.Random(12)
    for n in (1, 2, 5, 12):
        rows = [(r.randint(1, 50), r.random() * 9, r.random() * 4, r.random()) for _ in range(500)]
        points = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, size long, y0 double, y1 double, y2 double").repartition(3)
        caps = [r.choice([50.0, 100.0]) for _ in range(n)]
        frame = spark.createDataFrame(list(enumerate(caps)), "shard int, cap double")
        scale = [max(x[1 + d] for x in rows) - min(x[1 + d] for x in rows) for d in range(3)]
        got = {x["i"]: x["shard"] for x in sharding.dealt(shared.Tables(spark), points, frame, n, 100.0, tolerance=0.0).collect()}
        want = kd_by_hand(rows, caps, scale)
        assert sum(got[i] != want[i] for i in range(500)) <= n  # rows at a cut
