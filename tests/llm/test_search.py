import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from curbstream.llm import block_max, resampling, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, "w1 w2x W3xx and more"), (2, "w1, w1! nothing-here"), (3, None), (4, ""), (5, "zzz yyy"), (6, " ".join(f"w{i}" for i in range(300))), (None, "MIT license"), (2, "w9")]


def terms(text):
    return TERM.findall((text or "").translate(brute.LOWER))


# Resampling


def plain_resample(docs, target, most, buckets, percent, least):
    def grams(t):
        w = terms(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(g for _, x in docs for g in grams(x)), Counter(g for x in target for g in grams(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t_all + buckets) ** 0 * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for s_all, t_all in [(sum(s.values()), sum(t.values()))] for b in range(buckets)]
    out = []
    for d, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[g] for g in grams(x))
        out.append((d, len(terms(x)), len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    old = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, old[: percent * len(old) // 100]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 40), (2, 70_000, 100)])
def test_resampling(spark, docs, corpus, most, buckets, percent):
    target = spark.createDataFrame(ITEMS, "n bigint, text string")
    got = resampling.resample(docs, target, most, buckets, percent=percent).collect()
    want, top = plain_resample([(r[0], r[1]) for r in corpus], [t for _, t in ITEMS], most, buckets, percent, 20)
    flat = lambda rows: sorted(rows, key=str)
    assert flat((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == flat(want)
    taken = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in taken] == list(range(1, len(top) + 1)) and [(r.doc_id, r.score) for r in taken] == [(r[0], r[4]) for r in top]


def test_resampling_favours_the_target(spark, docs, nothing):
    rows = [(i, " ".join(["court"] * 30 if i % 2 else ["game"] * 30)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(" ".join(["court"] * 50),)], "text string")
    kept = resampling.drawn(d, target, buckets=1000)
    assert kept.columns == d.columns and kept.count() == 40 and kept.where("text LIKE 'game%'").count() == 0
    assert resampling.resample(nothing, target).count() == 0
    assert resampling.resample(docs, nothing).where("rank IS NOT NULL").count() == 10 * docs.where(F.size(F.regexp_extract_all("text", F.lit("[0-9A-Za-z\x80-\U0010ffff]+"), 0)) >= 20).count() // 100


@given(st.text("aB é1-_\n", max_size=40), st.integers(1, 4))
@settings(deadline=None)
def test_spans(text, most):
    w = terms(text)
    assert list(resampling.spans(text.encode(), most)) == [" ".join(w[i : i + n]).encode() for n in range(1, most + 1) for i in range(len(w) - n + 1)]


# WARC

PAGES = [(5, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (7, None, None), (8, "http://c/", ""), (None, "http://d/", "<p>one</p>"), (None, None, "no id"), (9, "http://e/", "no id"), (10, "http://f/", "é" * 5000), (11, "u", "\r\n\r\nWARC-Type: response\r\n")]
PAGE_SCHEMA = "page_id bigint, url string, html string, address string, copies int, size int, header string, sha1 string, row int, payload string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "h", "s", 3, "p") for r in rows], PAGE_SCHEMA).repartition(4)


@pytest.mark.parametrize("least", [0, 1, 10_000])
def test_warc(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "SHARE", 2)
    rows = PAGES + [(100 + i, f"http://h/{i}", "hot") for i in range(40)]
    got = warc.parse(warc.read(spark, warc.write(pages_of(spark, rows), least_bytes=least))).collect()
    body = lambda h: (h or "").encode()
    first = {}
    for p, _, h in rows:
        k = (p is None, p or 0)
        first[body(h)] = min(first.get(body(h), k), k)
    assert sorted((str(r.page_id), bytes(r.payload)) for r in got) == sorted((str(p), body(h)) for p, _, h in rows)
    by = defaultdict(list)
    for r in got:
        x = bytes(r.payload)
        assert r.payload_bytes == len(x) and r.payload_digest == base64.b32encode(hashlib.sha1(x).digest()).decode()
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        assert bytes(r.record).endswith(b"\r\n\r\n") and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
        assert rest[:-4].endswith(x) if r.record_type == "response" else rest[:-4].endswith(b"\r\n\r\n")
        by[x].append(r)
    for x, same in by.items():
        answers = [r for r in same if r.record_type == "response"]
        if len(x) < least:
            assert len(answers) == len(same) and all(r.refers_to is None for r in same)
        else:
            p = None if first[x][0] else first[x][1]
            assert [(r.page_id, r.refers_to) for r in answers] == [(p, None)]
            ids = {re.search(rb"WARC-Record-ID: (\S+)", bytes(r.header))[1] for r in answers}
            assert all(r.refers_to == p and re.search(rb"WARC-Refers-To: (\S+)", bytes(r.header))[1] in ids for r in same if r.record_type == "revisit")
    assert len({re.search(rb"WARC-Record-ID: (\S+)", bytes(r.header))[1] for r in got}) == len(rows)
    assert sum(r.url is None for r in got) == 2 and {"http://b/ X: y", "http://b/"} <= {r.url for r in got}


def test_warc_stores_once_and_sees_damage(spark):
    folder = warc.write(pages_of(spark, PAGES))
    stored = spark.read.parquet(folder + "/payloads")
    assert stored.count() == len({h or "" for _, _, h in PAGES})
    other = warc.write(pages_of(spark, []))
    assert warc.parse(warc.read(spark, other)).count() == 0
    stored.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.mode("append").parquet(other + "/payloads")
    spark.read.parquet(folder + "/headers").write.mode("append").parquet(other + "/headers")
    with pytest.raises(PySparkException, match="damaged payload"):
        warc.read(spark, other).collect()


# Search


def plain_search(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(w for _, c in counts for w in c)
    of = defaultdict(set)
    for i, t in items:
        of[i] |= set(terms(t))
    out = []
    for i, ws in of.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in ws if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "shard", "block_items"), [(50, 1 << 23, 512), (5, 2000, 2), (1, 1, 1)])
def test_search(spark, docs, corpus, nothing, top, shard, block_items):
    items = spark.createDataFrame([(*x, 1, "d") for x in ITEMS], "item_id bigint, text string, rank int, doc_id string")
    index = block_max.build(docs, shard_bytes=shard)
    got = block_max.search(index, items, top, block_items=block_items)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == plain_search([(r[0], r[1]) for r in corpus], ITEMS, top)
    assert block_max.search(index, items.where("item_id = 3")).count() == 0
    if top == 50:
        assert block_max.search(block_max.build(nothing), items).count() == 0


def test_long_text(monkeypatch):
    monkeypatch.setattr(block_max, "_PIECE", 7)
    text = ("alpha beta, gamma-delta " * 9).encode()
    assert b"".join(block_max._pieces(text)) == text
    assert [w for p in block_max._pieces(text) for w in block_max._TERM.findall(p)] == block_max._TERM.findall(text)


def test_blocks_are_refused_unopened():
    """Rare terms fill the heap; blocks of the frequent term open only where a candidate may still enter."""
    r = np.random.default_rng(3)
    shard, rows = block_max._Shard(), []
    for i in range(6000):
        w = ["the"] * ((1 if i < 3000 else 6) * (r.random() < 0.6)) + [f"t{r.integers(40)}" for _ in range(r.integers(20, 30) * (3 if i < 3000 else 1))] + (["rare"] * r.integers(1, 9) if r.random() < 0.05 else [])
        rows.append((i, " ".join(w)))
        shard.add(i, rows[-1][1].encode())
    total = sum(shard.lengths)
    b = shard.rows(0, len(rows), total).to_pydict()
    df = dict(zip(b["term"], b["df"], strict=True))
    norms = block_max.norm(np.array(shard.lengths, np.int64), len(rows), total)
    lists = []
    for k in ("the", "rare"):
        i = b["term"].index(k)
        lists.append((math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[k] + 1))), block_max._List(b["best"][i], *(np.array(b[c][i]) for c in ("last", "peak", "at", "wide")), b["data"][i], b["df"][i], norms)))
    best, seen = block_max.Best(50), {}
    doc, score = block_max.find(lists, best, len(rows), seen)
    best.add(score, np.zeros(len(doc), bool), doc)
    assert [(1, i + 1, int(d), int(s)) for i, (d, s) in enumerate(zip(best.id, best.score, strict=True))] == sorted(plain_search(rows, [(1, "the rare")], 50), key=lambda x: x[1])
    assert seen["refused"] > 0 and seen["essential"] == len(lists[1][1].whole()[0]) and len(lists[0][1].open) < len(lists[0][1].at)
