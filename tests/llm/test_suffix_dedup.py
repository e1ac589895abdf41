"""Repeated strings against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), [list(x) for x in suffix_dedup.runs(gone)], hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(45)
    texts = [text(r.randint(0, 80)) for _ in range(30)]
    texts += [text(20) + " " + passage + " " + text(k % 17) for k in range(40)]
    texts += [other[k:] + text(9) + other for k in range(6)]
    texts += [None, "", "a" * 700, "ab" * 300, passage, passage, texts[3], texts[3], "x" * 199]
    return texts


@pytest.mark.parametrize("crowd", [1, suffix_dedup.CROWD])
def test_dedup_matches_brute_force(spark, crowd):
    """With a crowd of 1 every bucket of several contents is dealt anew, up to the strings themselves."""
    texts = corpus()
    docs = spark.createDataFrame([(i if i != 4 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    if crowd > 1:
        rows = Counter((r["n_bytes"], str([list(s) for s in r["removed"]]), r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect())
        assert rows == Counter((n, str(s), h) for n, s, h in brute(texts, 200))
        return
    want = {hashlib.md5((t or "").encode()).digest(): w for t, w in zip(texts, brute(texts, 200))}
    got = {bytes(r["key"]): r["found"] for r in suffix_dedup.repeated(docs, crowd=crowd).collect()}
    for digest, w in want.items():
        spans = [(f["start"] + s["begin"], f["start"] + s["end"]) for f in got.get(digest, []) for s in f["spans"]]
        assert [list(x) for x in suffix_dedup.merged(spans)] == w[1]


def maximal(texts, length):
    """(text, occurrences) of each string of ``length`` or more that is in several places, which no longer string shares."""
    grown = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            grown.setdefault(t[p : p + length], set()).add((i, p))
    out = set()
    for places in grown.values():
        todo = [(length, frozenset(places))]
        while todo:
            n, at = todo.pop()
            if len(at) < 2:
                continue
            after = {}
            for i, p in at:
                after.setdefault(texts[i][p + n] if p + n < len(texts[i]) else (i, p), set()).add((i, p))
            if len(after) > 1 and len({texts[i][p - 1] if p else (i, p) for i, p in at}) > 1:
                out.add((n, at))
            todo += [(n + 1, frozenset(x)) for x in after.values()]
    return out


@pytest.mark.parametrize("crowd", [1, suffix_dedup.CROWD])
def test_groups_are_the_maximal_repeats(spark, crowd):
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    long, short, twice = text(900), text(230), text(400)
    texts = [text(50) + long + text(31), text(77) + long, long + text(200), short + text(300), text(9) + short, text(60) + twice + text(41) + twice, text(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in suffix_dedup.groups(docs, crowd=crowd).collect():
        got.setdefault((x["group"], x["size"]), set()).add((x["doc_id"], x["start"]))
    assert {(n, frozenset(at)) for (_, n), at in got.items()} == maximal(texts, 200) and len(got) == 3


def test_groups_have_all_occurrences_where_parts_have_more(spark):
    r = random.Random(13)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    long = text(1200)
    texts = [text(40) + long, long + text(60), text(70) + long[500:800] + text(80), text(20) + long]
    texts.append(texts[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, covered = {}, [np.zeros(len(t), dtype=bool) for t in texts]
    for x in suffix_dedup.groups(docs).collect():
        got.setdefault((x["group"], x["size"]), set()).add((x["doc_id"], x["start"]))
        covered[x["doc_id"]][x["start"] : x["start"] + x["size"]] = True
    for (_, n), at in got.items():
        i, p = min(at)
        s = texts[i][p : p + n]
        assert n >= 200 and at == {(i, p) for i, t in enumerate(texts) for p in range(len(t)) if t.startswith(s, p)} and len(at) > 1
    assert [[list(x) for x in suffix_dedup.runs(c)] for c in covered] == [w[1] for w in brute(texts, 200)]
    assert len(long[500:800]) in {n for _, n in got}


def test_text_of_several_chunks(spark, monkeypatch):
    r = random.Random(14)
    long = "".join(r.choice("abcdefgh ") for _ in range(3000))
    texts = [long, long[100:2900], "x" + long[1400:1700]]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    for t in texts:
        whole = np.frombuffer(t.encode(), dtype=np.uint8)
        found = [np.concatenate(c) for c in zip(*suffix_dedup.stretches(whole), strict=True)]
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(found[0], found[1], strict=True)])
        assert sorted(at.tolist()) == list(range(len(t) - 199))


def test_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_maximal_repeats_have_all_their_occurrences():
    contents = [b"xabcdey zabcdew abcd", b"qabcdef", b"", b"zz\0\0", b"zz\0", b"zz\0\0a"]
    data, sizes = np.frombuffer(b"".join(contents), dtype=np.uint8), np.array([len(c) for c in contents])
    found = {(data[o[0] : o[0] + n].tobytes(), *sorted(o.tolist())) for n, o, _ in suffix_dedup.repeats(data, sizes, 3)}
    assert found == {(b"abcde", 1, 9, 21), (b"abcd", 1, 9, 16, 21), (b"zz\0", 27, 31, 34), (b"zz\0\0", 27, 34)}
