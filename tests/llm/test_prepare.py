import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import canon, connect

from curbstream.llm import html_text, language_id, license_scan, mixing, packing, shards
from curbstream.llm.queries import ORACLE, QUERIES

FOLDER, TOKENIZER = "/root/testdata/sf0.001", public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    cur = connect(FOLDER).execute(ORACLE[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())


def test_mixing(docs, corpus, nothing):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(c[0]), size(c[1])) for c in corpus)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    # Sharing again until none is above three times its size.
    order = sorted((s for s in by if s is not None)) + [None]
    weight, sizes = {s: 1 + i % 3 for i, s in enumerate(order)}, {s: sum(r.size for r in by[s]) for s in order}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    for s, rows in by.items():
        assert {r.source_size for r in rows} == {sizes[s]} and rows[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r.size * sum(x.h == r.h for x in rows) for r in rows)
        assert all(r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size for r in rows)
    assert sorted((str(r.doc_id), r.taken) for r in mixing.mix_sources(docs.repartition(3)).collect()) == sorted((str(r.doc_id), r.taken) for r in got)
    many = mixing.repeated(docs)
    assert many.columns == docs.columns
    assert Counter(str(r.doc_id) for r in many.collect()) == Counter(str(r.doc_id) for r in got for _ in range(r.copies))
    assert mixing.mix_sources(nothing).count() == 0


def test_shards(docs, corpus, nothing):
    got = shards.shard_rows(docs).collect()
    want = Counter((c[0], len((c[1] or "").encode()) + 1, zlib.crc32((c[1] or "").encode())) for c in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert shards.shard_rows(nothing).count() == 0


def test_communication_matrix():
    m = sum(shards.draw_matrix([30, 0, 50], [20, 20, 40], s) for s in range(400))
    assert m.sum(axis=1).tolist() == [12000, 0, 20000] and m.sum(axis=0).tolist() == [8000, 8000, 16000]
    assert abs(m[0, 0] - 3000) < 150
    big = shards.draw_matrix([3 * 10**9, 10**9], [10**9, 3 * 10**9], 1)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 10**9] and big.sum(axis=0).tolist() == [10**9, 3 * 10**9] and abs(int(big[0, 0]) - 75 * 10**7) < 10**6


def test_packing(docs, corpus, nothing):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(TOKENIZER), Counter()
    for c in corpus:
        ids = np.array([*tok.encode(c[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((c[0], p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048)))
    for group in (packing.PIECES_PER_GROUP, 7):
        got = packing.pack(docs, TOKENIZER, group=group).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for v in bins.values():
            v.sort()
            assert all(o == sum(n for _, n in v[:i]) for i, (o, _) in enumerate(v)) and sum(n for _, n in v) <= 2048
        if group > 100:
            assert len(bins) <= packing.lower_bound(np.array([r.length for r in got]), 2048) + 1
    assert packing.pack(nothing, TOKENIZER).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_best_fit_and_bound(sizes):
    x = np.array(sizes, np.int64)
    bins, offsets, n = packing.best_fit_decreasing(x, 20)
    assert all(x[bins == b].sum() <= 20 for b in range(n)) and len(set(zip(bins.tolist(), offsets.tolist(), strict=True))) == len(x)

    def least(rest, free):
        if not rest:
            return 0
        h, t = rest[0], rest[1:]
        best = 1 + least(t, [*free, 20 - h])
        for i in {f: i for i, f in enumerate(free) if f >= h}.values():
            best = min(best, least(t, [*free[:i], free[i] - h, *free[i + 1 :]]))
        return best

    if len(sizes) <= 7:
        assert packing.lower_bound(x, 20) <= least(sorted(sizes, reverse=True), []) <= n
    assert packing.lower_bound(x, 20) <= n


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    enc = packing.Encoder(TOKENIZER)
    assert enc.encode([text, "a " + text])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_language(spark, docs, nothing):
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    given_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(given_, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    net = language_id.fit(docs)
    out = language_id.predict(docs, net).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(by[d].lang_pred == "und" for d in (220, 221, 222, 225)) and net.labels == ["de", "en"]
    assert language_id.fit(nothing) is None and language_id.predict(nothing, net).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language_id.new_net(["a", "b", "c"], 4, 1)
    net = language_id.Net(*[p.astype(np.float64) for p in net.params()], net.labels)
    x, y, mask = rng.integers(0, 256, (3, 9)), np.array([0, 1, 2]), np.ones((3, 9))
    _, grads = language_id.gradients(net, x, y, mask)
    for p, g in zip(net.params(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[i], 1e-5
        p[i] = old + e
        up, _ = language_id.gradients(net, x, y, mask)
        p[i] = old - e
        down, _ = language_id.gradients(net, x, y, mask)
        p[i] = old
        assert g[i] == pytest.approx((up - down) / (2 * e), rel=1e-4)
    states = language_id.log_probs(net, language_id.states(language_id.Net(*[p.astype(np.float32) for p in net.params()], net.labels), x.astype(np.uint8)))
    assert np.exp(states).sum(axis=0) == pytest.approx(np.ones((9, 3)), rel=1e-3)


def test_license_scan(docs, corpus, nothing):
    got = license_scan.scan(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(str((c[0], *brute.base_licenses(c[1]))) for c in corpus)
    by = {r.doc_id: r for r in got}
    assert by[230].labels == "cc-by,gpl,mit" and by[231].labels == "cc-by,cc-by-nc,mit" and by[231].n_base == 3
    assert by[232].labels == "mit" and by[232].base_labels == "" and 0.8 <= by[232].score < 1 and by[1].score == 0
    assert license_scan.scan(nothing).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div id="page-content"><div class="article-body-12"><h1>T &amp; t</h1><p>one <b>two</b>three<p>four<br>five &lt;x&gt;<ul><li>a<li>b</ul>
<div class="comments"><p>bad comment</p></div><form>bad</form><script>if(a<b)</script><!-- <p>bad</p> --></div><aside>bad</aside></div><footer>bad</footer>"""


def test_html_text(spark, nothing):
    rows = [(1, "https://a.example/1", PAGE, "x"), (2, "https://a.example/2", "<article><p>" + "long text " * 50 + "</article><p>tail", "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "https://A.example", "plain 1 < 2", "x"), (None, "https://b.example", "<p>p&nbsp; q", "x")]
    rows += [rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert html_text.main_text(pages).count() == len(rows)
    assert got[1, "https://a.example/1"][0] == "T & t\none twothree\nfour five <x>\na\nb"
    assert got[2, "https://a.example/2"][0] == ("long text " * 50).strip()
    assert got[3, None] == ("", 0) and got[4, "u"] == ("", 0) and got[5, "https://A.example"] == ("plain 1 < 2", 11)
    assert got[None, "https://b.example"] == ("p q", 3)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_of_the_tables(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(FOLDER + "/pages.parquet").collect()}
    for r in QUERIES["op9_html_text"](spark, FOLDER).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(x for x in parts if x)


@pytest.mark.parametrize("bare", ["<button>Menu</button>", "<menu><li>Menu</menu>", "<svg><text>x</text></svg>", "<svg class='a'/>", "<math />", "<svg width=1><path>", "<iframe src='x'/>", "<script src='x'/>", "<noscript>x"])
def test_html_text_goes_on_after_bare_elements(bare):
    article = "<article><h1>Head</h1>{}<p>one</p><p>two <button>Share</button> three</p></article>"
    want = "Head\none\ntwo\nthree"
    for page in (f"<body>{bare}{article.format('')}</body>", f"<body>{article.format(bare)}<script>x()</script></body>"):
        assert html_text.extract(page, None) == want and sum(html_text.scores(page).values()) == len(want) - 3
    assert html_text.extract("<p class=share><button>Share</button> this</p><p>text", None) == "text"
    assert html_text.extract("<p>a</p><script src=a/>if (b) c()</script><p>d", None) == "a\nd"


def test_html_text_from_several_containers(spark):
    long, more = " ".join(["long text"] * 30), " ".join(["other words"] * 25)
    menu = "<div class='x'><a href=a>one page</a> <a href=b>another page</a></div>"
    two = f"<body>{menu}<div class='intro'><p>short start</p></div><div class='text'><p>{long}</p></div></body>"
    nested = f"<body>{menu}<div class='outer'><p>{more}</p><div class='inner'><p>{long}</p></div><p>end</p></div></body>"
    card = f"<body><div class='text'><p>{long}</p></div><article><p>a card</p></article></body>"
    usual = f"<body>{menu}<article><p>{long}</p><div class='list'><p><a href=c>see this one</a></div></article><p>tail</p></body>"
    rows = [(1, "http://a/1", two), (2, "http://b/2", nested), (3, "http://c/3", card), *((4 + i, f"http://c/{4 + i}", usual) for i in range(5))]
    rows += [(9, "http://d/9", two), *((10 + i, f"http://d/{10 + i}", two.replace("<div class='intro'><p>short start</p></div>", "")) for i in range(5))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[9] == f"short start\n{long}" and got[10] == long
    assert got[2] == f"{more}\n{long}\nend"
    assert got[3] == f"{long}\na card" and got[4] == f"{long}\nsee this one"


LONG = " ".join(["long text"] * 30)


@pytest.mark.parametrize("start", ["<article class='post type-post category-social tag-search'>", "<div class='post type-post category-social tag-search'>", "<div class='article-body related-science'>", "<div id='search-engine-history'>", "<div class='page-header'>", "<div class='header-layout'><article>", "<div class='share'><div class='comments'>"])
def test_html_text_judges_names_by_what_they_take(start):
    page = f"<body><div class='sidebar'><a href=a>one</a><a href=b>two</a></div>{start}<h2 class='section-header'>Head</h2><p>{LONG}</p></div>"
    assert html_text.extract(page) == f"Head\n{LONG}"


def test_html_text_leaves_out_what_names_mark():
    rest = f"<div class='comments'><p>{LONG} {LONG}</p></div><div class='post-navigation'>next</div><div id='nyt-sidebar'><p>more</p></div><li class='social-links'>x</li>"
    assert html_text.extract(f"<body><article><h1>T</h1><p>{LONG}</p></article>{rest}") == f"T\n{LONG}"
    assert html_text.extract(f"<body><div id='search-engine-history'><p>{LONG}</p>{rest.replace(f'{LONG} ', '')}</div>").startswith(LONG)
    assert html_text.extract(f"<body><div class='text'><p>{LONG}</p>{rest}") == LONG
