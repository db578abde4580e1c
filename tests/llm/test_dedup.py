import hashlib
import random
import re

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curbstream.llm import components, exact_dedup, fingerprints, jaccard_join, substring_dedup


def pairs(corpus):
    return [(r[0], r[1]) for r in corpus]


def test_exact_dedup(docs, corpus, nothing):
    rows = exact_dedup.exact_dedup(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in pairs(corpus):
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(d)
    assert len(rows) == len(corpus)
    for r in rows:
        ids = [d for d in groups[r.text_sha256] if d is not None]
        assert (r.keep_id, r.group_size) == (min(ids, default=None), len(groups[r.text_sha256]))
    assert sorted(r.text_sha256 for r in rows if r.kept) == sorted(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_of_one_text(spark):
    many = spark.range(5000).select((F.col("id") + 3).alias("doc_id"), F.lit("same  text").alias("text")).repartition(7)
    assert [tuple(r) for r in exact_dedup.exact_dedup(many).groupBy("keep_id", "group_size").agg(F.count("*"), F.sum(F.col("kept").cast("int"))).collect()] == [(3, 5000, 5000, 1)]


def test_substring_dedup(docs, corpus, nothing):
    want = brute.repeats(pairs(corpus))
    got = substring_dedup.remove_repeats(docs, with_text=True).collect()
    assert len(got) == len(corpus)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(d), *want[d, t]) for d, t in pairs(corpus))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(v[1] for v in want.values()) > 500
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_large_shards_are_cut(docs, corpus, monkeypatch):
    want = brute.repeats(pairs(corpus))
    monkeypatch.setattr(substring_dedup, "SHARD_PIECES", 2)
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted((str(d), want[d, t][1]) for d, t in pairs(corpus))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(2, 6))
def test_suffix_automaton(texts, window):
    sam = substring_dedup.SuffixAutomaton()
    for i, t in enumerate(texts):
        sam.add(t, i)
    sam.finish()
    probe = [x for t in texts for x in t]
    for i, (n, low) in enumerate(sam.matches(probe, window)):
        have = [k for k in range(min(i + 1, window) + 1) if any(t[j : j + k] == probe[i + 1 - k : i + 1] for t in texts for j in range(len(t) - k + 1))]
        assert n == max(have)
        full = probe[i + 1 - window : i + 1]
        assert low == (min(d for d, t in enumerate(texts) if any(t[j : j + window] == full for j in range(len(t)))) if n == window else None)


def test_jaccard_components(docs, corpus, nothing):
    known = {d: t for d, t in pairs(corpus) if d is not None}
    want = brute.jaccard_components(list(known.items()))
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len({c for _, c in want.values()}) <= len(want) - 10
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_jaccard_without_groups(docs, corpus, monkeypatch):
    """With no MinHash keys every class is its own group: the matrix alone must find all links."""
    known = {d: t for d, t in pairs(corpus) if d is not None}
    real = jaccard_join._describe

    def no_keys(batches):
        import pyarrow as pa

        for b in real(batches):
            yield b.set_column(4, "keys", pa.array([[] for _ in range(b.num_rows)], pa.list_(pa.int64())))

    monkeypatch.setattr(jaccard_join, "_describe", no_keys)
    got = jaccard_join.jaccard_components(docs).where("doc_id is not null").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(list(known.items()))


def test_components(spark):
    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1001), (1001, 1000), (1002, 1001)], "a bigint, b bigint"))
    got = {r.node: r.component for r in components.components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 301)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert components.components(chain.limit(0)).count() == 0


def test_fingerprints(docs, corpus, nothing):
    rows = sorted(((d, t or "") for d, t in pairs(corpus)), key=lambda x: (x[0] is not None, x[0] or 0))
    got = fingerprints.edit_fingerprints(docs).collect()
    assert len(got) == len(rows)
    ids = [d for d, _ in rows]
    by = {r.doc_id: r for r in got}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)]
        if ids.count(d) > 1 or ids.count(nxt[0]) > 1:  # their order among themselves is by hash
            continue
        e = fingerprints.edited(t, nxt[1])
        assert (by[d].n_chars, by[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (brute.shingle_set(x) for x in (t, e, nxt[1]))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(by[d].near_edited - like(a, b)) < 0.3 and abs(by[d].near_next - like(a, c)) < 0.3
    assert by[200].fingerprint == by[201].fingerprint
    assert fingerprints.edit_fingerprints(nothing).count() == 0


def test_near_documents(docs, corpus):
    known = {d: brute.shingle_set(t) for d, t in pairs(corpus) if d is not None}
    got = fingerprints.near_documents(docs).collect()
    for r in got:
        a, b = known[r.a], known[r.b]
        assert r.jaccard == pytest.approx(len(a & b) / len(a | b)) and r.jaccard >= 0.8
    assert {(r.a, r.b) for r in got} >= {(100, 101), (100, 102)}


def test_near_documents_find_all_links(spark):
    """Unlike texts with a common passage come first in many bands; chains of edits; equal shingle sets; common first words."""
    rows, w = [], lambda x, n: [f"{x}{i}" for i in range(n)]
    passage = w("p", 120)
    for i in range(12):
        rows.append((i, " ".join(passage + w(f"u{i}x", 60))))
    for i in range(10):
        base = passage + w(f"v{i}x", 70)
        rows += [(100 + 10 * i + k, " ".join([*base[: len(base) - 5 * k], *w(f"e{k}y", 5 * k)])) for k in range(6)]
    rows += [(300, rows[0][1]), (301, rows[20][1]), (302, rows[20][1].upper())]
    known = {d: brute.shingle_set(t) for d, t in rows}
    got = fingerprints.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    like = lambda a, b: len(known[a] & known[b]) / len(known[a] | known[b])
    assert got and all(r.a < r.b and r.jaccard == pytest.approx(like(r.a, r.b)) and r.jaccard >= 0.8 for r in got)
    comp = {d: d for d in known}
    for r in got:
        x, y = comp[r.a], comp[r.b]
        comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    assert comp == {d: c for d, (_, c) in brute.jaccard_components(rows).items()}


def test_near_documents_lose_no_link_of_different_texts(spark):
    """Every pair of different sets and not only enough of them to connect; ids with several texts; copies hang on the smallest id."""
    r, base, rows = random.Random(4), [f"b{i}" for i in range(120)], []
    for i in range(40):
        w = list(base)
        for j in r.sample(range(120), r.randrange(0, 4)):
            w[j] = f"e{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(50, rows[3][1].upper()), (51, " ".join(f"o{i}" for i in range(40))), (52, " ".join(f"o{i}" for i in range(41))), (7, rows[-1][1] + " o40"), (5, "of its own " * 9), (None, rows[0][1])]
    classes = {}
    for d, t in rows:
        if d is not None:
            classes.setdefault(frozenset(brute.shingle_set(t)), set()).add(d)
    want = {(min(ds), d): 1.0 for ds in classes.values() for d in ds if d > min(ds)}
    for x in classes:
        for y in classes:
            a, b, like = min(classes[x]), min(classes[y]), len(x & y) / len(x | y)
            if a < b and like >= 0.8:
                want[a, b] = max(like, want.get((a, b), 0.0))
    got = fingerprints.near_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(got) == len({(x.a, x.b) for x in got}) and len(want) > 100
    assert {(x.a, x.b): pytest.approx(x.jaccard) for x in got} == want


def test_near_documents_need_no_common_band(docs, corpus):
    """With a single band of all permutations hardly any like documents share it: the exact join must find their links."""
    known = {d: t for d, t in pairs(corpus) if d is not None}
    comp = {d: d for d in known}
    for r in fingerprints.near_documents(docs, bands=1).collect():
        x, y = comp[r.a], comp[r.b]
        comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    assert comp == {d: comp_id or d for d, (_, comp_id) in brute.jaccard_components(list(known.items())).items()}


def test_near_documents_are_a_query(spark):
    from curbstream.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    comp = {d: d for d in (r.doc_id for r in docs)}
    for r in QUERIES["op4_near_documents"](spark, "/root/testdata/sf0.001").collect():
        x, y = comp[r.a], comp[r.b]
        comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    want = {d: c for d, (_, c) in brute.jaccard_components([tuple(r) for r in docs]).items()}
    assert comp == want and len(set(want.values())) < len(want)


def test_jaccard_opens_no_pairs_of_unlike_documents(spark, monkeypatch):
    """A passage that all documents share, and a text of which all are edits: groups that open each other grow with the documents, not with their pairs."""
    r, n, sizes = random.Random(9), 160, {}
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join(passage + [f"own{i}x{j}" for j in range(45)])) for i in range(n)]
    base = [f"b{i}" for i in range(150)]
    for i in range(n):
        w = list(base)
        for j in r.sample(range(150), r.randrange(1, 12)):
            w[j] = f"e{i}x{j}"
        rows.append((1000 + i, " ".join(w)))
    kept = jaccard_join.stage

    def stage(df, name):
        out = kept(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stage", stage)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.jaccard_components(rows)
    assert sizes["jaccard-open"] <= 4 * n and sizes["jaccard-able"] <= 4 * n and sizes.get("jaccard-rest", 0) <= 4 * n, sizes


def test_jaccard_asks_few_members_of_a_large_group(spark, monkeypatch):
    """Texts put together from edits of many members lie inside a large group's row but near no member: not all members are asked."""
    r, m, n, base = random.Random(3), 90, 60, [f"b{i}" for i in range(300)]
    edits = [{j: f"e{i}x{j}" for j in r.sample(range(300), 2)} for i in range(m)]
    mixed = [{k: v for i in r.sample(range(m), 8) for k, v in edits[i].items()} for _ in range(n)]
    rows = [(i, " ".join(e.get(j, w) for j, w in enumerate(base))) for i, e in enumerate(edits + mixed)]
    asked, real = spark.sparkContext.accumulator(0), jaccard_join._qualify

    def counted(percent):
        run = real(percent)

        def seen(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(jaccard_join, "_qualify", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute.jaccard_components(rows)
    assert len({c for _, c in got.values()}) > n // 2
    assert 0 < asked.value <= 8 * (m + n), asked.value
