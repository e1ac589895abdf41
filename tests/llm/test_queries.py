"""The registered queries on a small table, by their contracts: against brute force, or by the laws that results obey."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from orrery.llm import decontaminate, packing, quality_rules, queries, secret_scan
from tests.llm.test_operators import by_hand, components, shingled
from tests.llm.test_suffix_dedup import brute

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}


_MADE = {}


def made(spark, name):
    if name not in _MADE:
        df = __spark_entry__.queries()[name](spark, BASE)
        _MADE[name] = df.dtypes, df.collect()
    return _MADE[name]


def rows_of(spark, name, types):
    found, rows = made(spark, name)
    assert {c: t for c, t in found if c in types} == types
    return rows


def test_op1(spark, docs):
    types = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    encoder, by, lines = queries.byte_bpe(), defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op1_packing", types):
        by[r["doc_id"]].append(r)
        lines[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(docs)
    for i, d in docs.items():
        ids, at = [*encoder._slow.encode(d["text"] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(piece.tobytes()))
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for parts in lines.values():
        size = 0
        for offset, length in sorted(parts):
            assert offset == size
            size += length
        assert size <= packing.WINDOW
        padded += 0 if size & (size - 1) == 0 else packing.WINDOW - size
    assert padded == 0


def test_op2(spark, docs):
    got = rows_of(spark, "op2_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    right = []
    for r in got:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if r["held_out"] and letters and d["lang"]:
            right.append(r["lang_pred"] == d["lang"])
    assert len(got) == len(docs) and np.mean(right) > 0.9


def test_op3(spark, docs):
    items = {r["item_id"]: decontaminate.coded(r["text"]) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()}
    want = {}
    for i, d in docs.items():
        codes = decontaminate.coded(d["text"])
        seeds = set(decontaminate.seeds_of(codes, 5).tolist())
        for k, item in items.items():
            if not seeds.isdisjoint(decontaminate.seeds_of(item, 5).tolist()):
                share = sum(n for _, _, n in decontaminate.tiles(codes, item, 5)) / len(item)
                if share >= 0.5:
                    want[i, k] = share
    got = rows_of(spark, "op3_decontaminate", {"coverage": "double", "n_tiles": "int", "longest_tile": "int"})
    assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in got} == want and len(got) == len(want) > 0


def test_op4(spark, docs):
    types = {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    got = rows_of(spark, "op4_secret_scan", types)
    assert len(got) == len(docs)
    for r in got:
        base = by_hand(docs[r["doc_id"]]["text"] or "")
        listed = ",".join(f"{k}:{b}:{e}" for k, b, e in base)
        n = Counter(k for k, _, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert [x for x in spans if x[0] in secret_scan.BASE_KINDS] == [(k, str(b), str(e)) for k, b, e in base]


def test_op5(spark, docs):
    ids = sorted(docs)
    want, sizes = components([docs[i]["text"] for i in ids], 85)
    got = {r["doc_id"]: r for r in rows_of(spark, "op5_near_dedup", {"n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"})}
    for k, i in enumerate(ids):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (sizes[k], ids[want[k]], want[k] == k)


@pytest.mark.parametrize("name", ["op5_near_dedup", "op6_warc", "op7_quality_rules"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    (types, rows), sql = made(spark, name), con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(c for c, _ in types)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, sql.select(",".join(columns)).fetchall()))


def test_op8(spark, docs):
    types = {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got, by, of = rows_of(spark, "op8_sharding", types), defaultdict(list), defaultdict(set)
    for r in got:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        by[r["shard"]].append(r)
        of[data].add(r["shard"])
    assert len(got) == len(docs) and set(by) <= set(range(24))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    largest, total = max(r["size"] for r in got), sum(r["size"] for r in got)
    assert max(sum(r["size"] for r in rows) for rows in by.values()) <= total / 24 + largest
    weight = Counter(docs[r["doc_id"]]["text"] for r in got)
    assert all(len(s) == 1 for t, s in of.items() if weight[t.decode()] * (len(t) + 8) < total / 48)


def test_op9(spark, docs):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    got, right = rows_of(spark, "op9_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}), []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in toxic:
            right.append(r["predicted"] == toxic[r["doc_id"]])
    assert len(got) == len(docs) and np.mean(right) > 0.9


def test_op10(spark, docs):
    ids = sorted(docs)
    got = {r["doc_id"]: r for r in rows_of(spark, "op10_suffix_dedup", {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})}
    for i, (n, spans, digest) in zip(ids, brute([docs[i]["text"] for i in ids], 200), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (n, sum(e - b for b, e in spans), len(spans), digest)


def test_pipeline_by_brute_force(spark, docs):
    """What each stage leaves, from its own input; then the pieces of the last."""
    keep = set(docs)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i in list(keep):
        w, t = words(docs[i]["text"]), docs[i]["text"] or ""
        lines = [x for x in t.split("\n") if words(x)]
        windows = defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        again = len({k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)})
        n, chars, symbols = len(w), sum(map(len, w)), len(re.findall(quality_rules.SYMBOLS, t))
        bad = n < 20 or 100 * again > 30 * n or 10 * chars < 15 * n or chars > 20 * n or 4 * symbols > n or 100 * (len(lines) - len(set(lines))) > 60 * len(lines)
        if bad:
            keep.discard(i)
    ids = sorted(keep)
    want, _ = components([docs[i]["text"] for i in ids], 80)
    keep = {ids[k] for k, c in enumerate(want) if c == k}
    items = [decontaminate.coded(r["text"]) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    for i in list(keep):
        codes = decontaminate.coded(docs[i]["text"])
        if any(2 * sum(n for _, _, n in decontaminate.tiles(codes, x, 5)) >= len(x) for x in items if len(x)):
            keep.discard(i)
    text = {i: secret_scan.redacted(docs[i]["text"], secret_scan.findings(docs[i]["text"])) for i in keep}
    encoder, got = queries.byte_bpe(), defaultdict(list)
    for r in corpus_pipeline.run(spark, BASE).collect():
        got[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    assert set(got) == keep and len(keep) > 20
    for i in keep:
        assert np.frombuffer(b"".join(x for _, x in sorted(got[i])), dtype="<u4").tolist() == encoder.ids(text[i]).tolist()
    assert all(shingled(text[i]) for i in keep)
