"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, html_extract, line_dedup, lsa_quality, order_minhash, quality_rules, sharding, suffix_dedup, url_rules

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("aeinorst") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else "edit" + w for w in text.split(" "))


def corpus():
    base, line = prose(200, 1), "  This Line is long enough to be counted as a repeated line \t"
    rows = [(i, prose(60, 100 + i)) for i in range(12)]
    rows += [(20 + i, edited(base, 0.01, i)) for i in range(8)] + [(40, base), (41, base), (42, base)]
    rows += [(50 + i, f"{prose(30, i)}\n{line if i % 2 else line.strip().upper()}\n{prose(20, 500 + i)}") for i in range(7)]
    rows += [(60, None), (61, ""), (None, base), (None, None), (41, base), (70, "é" * 30 + " ünïcode " * 9), (71, "a" * 5000), (72, "a" * 5000), (73, prose(4000, 9)), (74, " \n\t\r\x0b\x0c "), (75, line), (75, line)]
    return rows


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- 1 line dedup


def test_line_dedup(docs_of):
    rows = corpus()
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(x))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    expected = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        expected.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(docs_of(rows))
    assert {"h1", "size", "node", "keys"} <= set(got.columns)
    found = [(r.doc_id, r.line_total, r.line_dropped, r.text or "") for r in got.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert sum(e[2] for e in expected) > 5


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2)
    for k in range(5):
        batch = spark.createDataFrame([(k * 10 + d, h, h) for d in range(3) for h in (1, 2 + k)], "doc_id long, h1 long, h2 long")
        runs.add(batch)
        keys = [r.h1 for level in runs.levels for name in level for r in spark.table(name).collect()]
        assert sorted(keys) == list(range(1, 3 + k))  # a key stands in one run: what the anti-join found was not added again
    assert [len(level) for level in runs.levels] == [1, 0, 1] and [len(level) for level in runs.updates] == [0, 0, 1]
    assert {r.h1: (r.n_docs, r.max_doc) for r in runs.totals().collect()} == {1: (15, 42)} | {2 + k: (3, 10 * k + 2) for k in range(5)}
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_batches_follow_the_rows(docs_of, spark, monkeypatch):
    added = []
    monkeypatch.setattr(line_dedup.LineRuns, "add", lambda self, pairs, add=line_dedup.LineRuns.add: added.append(1) or add(self, pairs))
    docs = docs_of([(i, f"{'a common line of text that all documents share'}\n{i:050d}\n{i // 6:050d} six") for i in range(120)])
    lost = line_dedup.repeated_lines(docs, batch_rows=1 + 360 // (9 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    assert lost.distinct().count() == 119 + 100 and len(added) > line_dedup.BATCHES
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_beside_columns_of_its_names(docs_of):
    docs = docs_of([(i, "x" * 50) for i in range(6)]).selectExpr("*", "9 AS line_total", "doc_id AS line_dropped")
    got = line_dedup.dedup_lines(docs, total="__n", dropped="__gone").collect()
    assert all(r.line_total == 9 and r.line_dropped == r.doc_id and r["__gone"] == (r.doc_id < 5) for r in got)


def test_line_dedup_empty(docs_of, spark):
    assert line_dedup.dedup_lines(docs_of([(1, "x")]).limit(0)).count() == 0


# ---- 2 html


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/a">menu</a></nav><div class="x">site line</div>
<article><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>ly&nbsp;put<p>Two<br>three &lt;x&gt;<div class="comments">reader said</div><form>f</form></article><aside>side</aside><footer>&copy;</footer></body></html>"""


def test_main_text_of_one_page():
    assert html_extract.Page(PAGE).text(set()) == "Head & more One boldly\xa0put Two three <x>"
    for broken in ("", "<", "<p", "</p></div>text", "<a href='x>t", "<!-- open", "<script>never", "a &amp b"):
        html_extract.Page(broken).text(set())
    assert html_extract.Page("</p></div>text").text(set()) == "text"
    assert html_extract.Page("<p " + "x" * 100_000).text(set()) is not None
    assert html_extract.Page("<div>" * 5000 + "deep").text(set()) == "deep"


@pytest.mark.parametrize("name", ["site has-sidebar", "layout with-sidebar", "page no-comments", "sticky-header layout", "post widget", "sidebar", "comments"])
def test_layout_wrappers_are_no_boilerplate(name):
    for kind in ("article", "main"):
        page = f'<body><div class="{name}"><{kind}><h1>Head</h1><p>Body text</p></{kind}><div class="ad">buy</div><div id="site-footer">end</div></div></body>'
        assert html_extract.Page(page).text(set()) == "Head Body text"
    if name != "comments":
        assert html_extract.Page(f'<body><div class="{name}"><p>{prose(30, 1)}</p><div class="cookie-notice">ok</div></div><p>end</p></body>').text(set()) == prose(30, 1) + " end"


def test_names_that_stay_and_go():
    for name in ("ad", "ad-slot", "google-ad", "cookie-consent", "share-buttons", "social-share", "post-comments", "comment-list", "related-posts", "x comments", "sidebar_left", "top-nav", "ads_1", "article-footer"):
        assert html_extract.Page(f'<article><p>{prose(9, 1)}</p><div class="{name}">gone</div></article>').text(set()) == prose(9, 1), name
    for name in ("has-sidebar", "no-comments", "sticky-header", "entry-header", "with-ads", "navigable", "socialism"):
        assert html_extract.Page(f'<article><p>{prose(9, 1)}</p><div class="{name}">kept</div></article>').text(set()) == prose(9, 1) + " kept", name
    # a long thread of comments is no content, nor are teasers beside the article
    assert html_extract.Page(f'<article><p>Short.</p><div id="comments">{prose(90, 2)}</div></article><div class="related"><article>teaser</article></div>').text(set()) == "Short."
    assert html_extract.Page("<article><p>Let <math><mi>x</mi></math> be</p><label>Fig. 1</label></article><label>off</label>").text(set()) == "Let x be Fig. 1"


@pytest.mark.parametrize("max_broadcast", [10, 0])
def test_site_template(spark, max_broadcast):
    body = "<html><body><div>Welcome to our site</div><p>{}</p><section><p>{}</p><p>All rights kept</p></section></body></html>"
    rows = [(i, f"https://a.example/{i}", body.format(prose(9, i), prose(3, 50 + i))) for i in range(6)]
    rows += [(10 + i, f"https://b.example/{i}", body.format(prose(9, i), "other")) for i in range(2)] + [(30, None, None), (31, "no scheme", "")]
    # copies of one article are no template
    rows += [(40 + i, f"https://c.example/{i}", "<html><body><p>" + prose(40, 77) + "</p></body></html>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(pages, max_broadcast=max_broadcast).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i] == f"{prose(9, i)} {prose(3, 50 + i)}"
    assert got[10].startswith("Welcome") and got[30] == "" == got[31] and got[44] == prose(40, 77)


@pytest.mark.parametrize("kind", ["article", "main"])
@pytest.mark.parametrize("max_broadcast", [10, 0])
def test_template_inside_articles(spark, max_broadcast, kind):
    body = "<html><body><div><{0}><h1>{1}</h1><div>Read us <b>daily</b></div><p>{2}</p><blockquote>Tell a friend</blockquote></{0}></div></body></html>"
    rows = [(i, f"https://a.example/{i}", body.format(kind, prose(4, i), prose(40, 50 + i))) for i in range(6)]
    rows += [(10 + i, f"https://b.example/{i}", body.format(kind, prose(4, i), prose(40, 50 + i))) for i in range(2)]
    # copies of one article are no template
    rows += [(20 + i, f"https://c.example/{i}", body.format(kind, prose(4, 1), prose(40, 77))) for i in range(9)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), max_broadcast=max_broadcast).collect()}
    for i in range(6):
        assert got[i] == f"{prose(4, i)} {prose(40, 50 + i)}"
    assert got[10] == f"{prose(4, 0)} Read us daily {prose(40, 50)} Tell a friend"
    assert got[25] == f"{prose(4, 1)} Read us daily {prose(40, 77)} Tell a friend"


def test_template_beside_a_long_shared_script(spark):
    body = "<html><head><style>{0}</style></head><body><script>{0}</script><div>{1}</div><p>{2}</p><p>{3}</p></body></html>"
    script, notice = "track(1);" * 200, "We use some biscuits " + prose(60, 3)
    rows = [(i, f"https://a.example/{i}", body.format(script, notice, prose(20, i), prose(9, 50 + i))) for i in range(6)]
    # copies of one article with a small part of their own are no template
    rows += [(20 + i, f"https://c.example/{i}", body.format(script, prose(40, 77), prose(60, 78), f"Page {i}")) for i in range(9)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"{prose(20, i)} {prose(9, 50 + i)}"
    assert got[25] == f"{prose(40, 77)} {prose(60, 78)} Page 5"


# ---- 3 quality rules


def test_repeat_words_and_base(docs_of):
    rows = [(1, "a b c d e f a b c d e g"), (2, "x " * 12), (3, prose(100, 3)), (4, None), (5, "one\ntwo\none\n \n"), (6, "a b c d e a b c d e"), (7, "#$ a|b <c> &&")]

    def repeated(w):
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        c = Counter(grams)
        return len({i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)})

    got = {r.doc_id: r for r in quality_rules.text_statistics(docs_of(rows)).collect()}
    for i, t in rows:
        w = (t or "").split()
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), repeated(w)), i
    assert got[5].n_dup_lines == 1 and got[7].n_symbols == 7


def test_weak_supervision_parts_good_from_bad(docs_of):
    good = [(i, "\n".join(prose(40, 10 * i + k).capitalize() + "." for k in range(3))) for i in range(40)]
    bad = [(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(20, i).split()) for _ in range(4))) for i in range(12)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs_of(good + bad + [(500, None), (None, "")])).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad) and not got[500]
    assert quality_rules.judge(docs_of([(1, "a")]).limit(0)).count() == 0


# ---- 4 BPE


def test_bpe_equals_the_definition(docs_of):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    true = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = corpus() + [(900 + i, "".join(chr(rng.choice([rng.randrange(9, 127), rng.randrange(160, 0x700), rng.randrange(0x4E00, 0x4F00), 0x1F600])) for _ in range(rng.randrange(80)))) for i in range(200)]
    rows += [(2000, " " * 3000), (2001, "\n" * 500 + "=" * 700), (2002, "<|endoftext|> 's 're")]
    got = bpe.decode(bpe.encode(docs_of(rows), path, public_tokenizers.PATTERN), path).select("doc_id", "text", "tokens", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.tokens == true.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    checked = bpe.encode(docs_of(rows[:40]), path, public_tokenizers.PATTERN, checked=True).collect()
    assert all(r.decoded_sha256 == sha((r.text or "").encode()) and r.tokens == true.encode_ordinary(r.text or "") for r in checked)


def test_transducer_forgets_and_goes_on():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    small, large = bpe.Transducer(ranks, max_states=20), bpe.Transducer(ranks)
    for k in range(200):
        piece = prose(3, k).encode()
        assert small.encode(piece) == large.encode(piece) == bpe.merge_bytes(ranks, piece)


def test_transducer_follows_open_places_of_rare_and_long_pieces(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    rng = random.Random(5)
    pieces = ["".join(rng.choices("aebcdéß日 1.", k=rng.choice((1, 4, 9, 60, 300)))).encode() for _ in range(150)] * 2
    for least, ahead in ((0, 48), (1, 3), (3, 48), (1 << 30, 7)):
        monkeypatch.setattr(bpe, "LEAST_ASKED", least)
        monkeypatch.setattr(bpe, "AHEAD", ahead)
        transducer = bpe.Transducer(ranks)
        for piece in pieces:
            assert transducer.encode(piece) == bpe.merge_bytes(ranks, piece)


def test_encoder_of_many_words_stays_small():
    """Words that come once do not fill the memory of a task with states."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoder = bpe.Encoder(bpe.parse_ranks(f.read()), public_tokenizers.PATTERN)
    rng = random.Random(6)
    parts = ["an", "the", "rer", "tion", "ing", "of", "sh", "wh", "nd", "ea", "ble", "on", "ti", "er", "au", "schen", "keit", "ü"]
    text = " ".join("".join(rng.choices(parts, k=rng.randint(2, 5))) for _ in range(30_000))
    tracemalloc.start()
    encoder.encode(text)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 10_000_000


def test_pairs_are_kept_by_token():
    """Each pair is worked out once, is found under its second token, and is bounded and forgotten with the states."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    transducer = bpe.Transducer(ranks)
    pieces = [prose(3, k).encode() for k in range(60)]
    expected = [bpe.merge_bytes(ranks, piece) for piece in pieces]
    assert [transducer.encode(piece) for piece in pieces] == expected
    n = transducer.n_stable
    assert n == sum(len(pairs) - 1 for pairs in transducer.stable.values()) > 0
    assert all(pairs[-1] and pairs[last] == transducer._stays(last, token) for token, pairs in transducer.stable.items() for last in list(pairs) if last >= 0)
    assert [transducer.encode(piece) for piece in pieces] == expected and transducer.n_stable == n
    transducer._forget()
    assert transducer.n_stable == 0 and all(pairs == {-1: True} for pairs in transducer.stable.values())
    assert [transducer.encode(piece) for piece in pieces] == expected


def test_utf8_machine():
    text = "aé漢😀b" * 50
    raw = text.encode()
    for size in (1, 2, 3, 5, 7):
        machine = bpe.Utf8Machine()
        assert "".join(machine.feed(raw[i:i + size]) for i in range(0, len(raw), size)) + machine.finish() == text
    machine = bpe.Utf8Machine()
    assert machine.feed(b"a\xe2\x82") + machine.finish() == "a\ufffd"


# ---- 5 decontamination


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination_matches(docs_of, spark, block_bytes):
    items = [(i, prose(25, 900 + i)) for i in range(12)] + [(50, "Short one, here"), (51, None), (52, ""), (53, prose(25, 900)), (None, prose(14, 990)), (54, "single"), (3, prose(25, 903))]
    rows = corpus() + [(200 + i, f"{prose(30, i)} {prose(25, 900 + i).upper()}! {prose(9, 3)}") for i in range(6)] + [(300, "a short ONE here b single"), (301, prose(9, 900)), (302, prose(10, 900))]
    words = lambda t: [w.decode() for w in decontaminate.words_of(t)]
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add("" if item is None else str(item))
    expected = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for g, names in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= names
        expected.append((i, len(w), len(hit), sorted(found)))
    got = decontaminate.matches(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.word_count, sum(r.hit_spans[1::2]) - sum(r.hit_spans[::2]), r.hit_items) for r in got), key=str) == sorted(expected, key=str)


def test_decontaminate_cuts_and_keeps(docs_of, spark):
    item = prose(25, 900)
    rows = [(1, f"{prose(60, 1)} {item} {prose(60, 2)}"), (2, item), (3, prose(50, 3)), (4, None)]
    frame = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs_of(rows), frame).collect()}
    assert set(got) == {1, 3, 4} and item not in got[1] and got[1].startswith(prose(60, 1)) and got[3] == prose(50, 3)
    assert not [r for r in decontaminate.matches(docs_of([(1, got[1])]), frame).collect() if r.hit_spans]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontaminate_keeps_short_items_and_cuts_until_none_is_left(docs_of, spark, block_bytes):
    words = [f"w{k}" for k in range(2000)]
    # each cut of b joins the halves of the next one, four deep
    items = [[f"{c}{k}" for k in range(12)] for c in "abcd"]
    nested = items[0]
    for inner in items[1:]:
        nested = inner[:6] + nested + inner[6:]
    short = ["three", "short", "words"]
    rows = [(1, " ".join(words[:1000] + short + words[1000:])), (2, " ".join(words[:500] + nested + words[500:900])), (3, "Three, short words!"), (4, " ".join(words[:9] + nested + words[9:50])),
            (5, " ".join(words[:30])), (6, None)]
    frame = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate([*items, short])], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs_of(rows), frame, block_bytes=block_bytes).collect()}
    assert got.pop(2).split() == words[:900]
    # 48 of 98 words are cut: under the coverage limit
    assert got.pop(4).split() == words[:50]
    assert got == {1: rows[0][1], 5: rows[4][1], 6: None}


# ---- 6 quality classifier


def test_nearest_neighbours_are_exact():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, (60, lsa_quality.TERMS)).astype(np.float32)
    model = lsa_quality.Model(counts, rng.integers(0, 2, 60))
    query = lsa_quality.unit(lsa_quality.weigh(counts[:5], model.idf) @ model.projection)
    for row, score in zip(query, model.score(counts[:5], 7)):
        cosine = sorted(((float(row @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[:7]
        weight = [max(c, 1e-6) ** lsa_quality.SHARPNESS for c, _ in cosine]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weight, cosine)) / sum(weight), rel=1e-3)


def test_counts_of_long_texts_are_whole(docs_of, spark, monkeypatch):
    texts = ["ab " * 90_001 + "cd, " * 70_003, "xy. " * 3001 + prose(200, 1), prose(300, 2)]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % lsa_quality.HELD_OUT_FOLDS][:3]
    docs, labels = docs_of(zip(ids, texts)), spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    counts = np.stack([lsa_quality.count_terms(t) for t in texts])
    fitted = []
    monkeypatch.setattr(lsa_quality, "Model", lambda c, labels: fitted.append(c))
    lsa_quality.fit(docs, labels)
    monkeypatch.undo()
    assert {row.tobytes() for row in fitted[0]} == {row.tobytes() for row in counts}
    model = lsa_quality.Model(np.vstack([counts, np.random.default_rng(2).poisson(0.3, (40, lsa_quality.TERMS))]).astype(np.float32), np.arange(43) % 2)
    got = {r.doc_id: r.quality_score for r in lsa_quality.scored(docs, model).collect()}
    assert [got[i] for i in ids] == pytest.approx(model.score(counts).tolist(), rel=1e-5)


def test_classifier_on_held_out_rows(docs_of, spark):
    good = [(i, prose(50, i)) for i in range(60)]
    bad = [(100 + i, " ".join(w + "***" for w in prose(30, i).split())) for i in range(60)]
    docs = docs_of(good + bad + [(None, ""), (500, None)])
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lsa_quality.scored(docs, lsa_quality.fit(docs, labels)).withColumn("held", lsa_quality.held_out(F.col("doc_id"))).collect()}
    for i, r in got.items():
        assert r.held == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.quality_score <= 1 and (i is None or i >= 500 or (r.quality_score >= 0.5) == (i < 100))
    assert {r.quality_score for r in lsa_quality.scored(docs, lsa_quality.fit(docs, labels.limit(0))).collect()} == {lsa_quality.NO_LABELS}


# ---- 7 URLs


def test_fixed_rules_and_parts(spark):
    rows = [("https://A.example.NET/en/1?x=1", "a.example.net", "/en/1", "example.net/en/"), ("http://example.net/de", "example.net", "/de", "net/"), ("http://x.net", "x.net", "", None),
            ("http://www.example.com/de/2#t", "www.example.com", "/de/2", "example.com/de/"), ("http://notexample.com/de/", "notexample.com", "/de/", None), ("ftp://q.org/fr/", "q.org", "/fr/", "org/fr/"),
            (None, "", "", None), ("no scheme/", "", "", None), ("", "", "", None), ("http://", "", "", None), ("x://a/b://c", "a", "/b://c", None)]
    pages = spark.createDataFrame([(k, r[0], "") for k, r in enumerate(rows)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages, labels).collect()}
    for k, (_, host, path, rule) in enumerate(rows):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), rows[k]
        assert got[k].verdict == (dict(url_rules.FIXED_RULES)[rule] if rule else "allow")


def test_mined_rules(spark):
    rows = [(i, f"https://spam{i % 3}.ads.example.org/en/{i}") for i in range(60)] + [(100 + i, f"https://www.fine.example.org/en/{100 + i}") for i in range(60)]
    pages = spark.createDataFrame([(i, u, "") for i, u in rows] + [(999, "http://new.ads.example.org/es/7", "")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, _ in rows[:40] + rows[60:100]], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i < 100 else "allow") for i, _ in rows) and got[999] == "block"


# ---- 8 suffix dedup


def test_suffix_order():
    rng = random.Random(3)
    for t in range(200):
        strings = [bytes(rng.choice(b"ab" if t % 2 else b"abcd") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        text, order, gaps = suffix_dedup.suffix_order(strings)
        assert sorted(order) == [i for i in range(len(text)) if i not in gaps]
        suffixes = [text[i:min(g for g in gaps if g > i)] for i in order]
        assert suffixes == sorted(suffixes)


@pytest.mark.parametrize("max_bucket", [5000, 1])
def test_remove_repeats(docs_of, monkeypatch, max_bucket):
    monkeypatch.setattr(suffix_dedup, "MAX_BUCKET", max_bucket)
    rows = corpus() + [(400 + i, prose(20, i)[: 45 + i]) for i in range(8)] + [(500 + i, prose(20, i)[: 45 + i]) for i in range(8)]
    low = -(1 << 63)
    data = [(low if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, _, b in sorted(data):
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    expected = []
    for i, shown, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        expected.append((shown, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_pieces_do_not_depend_on_neighbours(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab" if k % 3 else b" ") for _ in range(rng.choice((0, 10, 49, 50, 51, 120, 299, 300, 301, 700)))) for k in range(120)]
    got = defaultdict(list)
    for k, *piece in zip(*(c.tolist() for c in suffix_dedup.pieces(*joined(texts)))):
        got[k].append(piece)
    contents = {}
    for k, text in enumerate(texts):
        alone = [piece for _, *piece in zip(*(c.tolist() for c in suffix_dedup.pieces(*joined([text]))))]
        assert got[k] == alone
        assert [p for _, _, at, n in alone for p in range(at, at + n)] == list(range(len(text) - 49))
        for _, name, at, n in alone:
            assert contents.setdefault(name, text[at:at + n + 49]) == text[at:at + n + 49]


def test_shared_string_as_one_symbol(monkeypatch):
    rng = random.Random(6)
    middle = bytes(rng.randrange(97, 123) for _ in range(suffix_dedup.K))
    for _ in range(50):
        sides = [bytes(rng.choice(b"ab") for _ in range(52)) for _ in range(2)]
        strings, middles = [], []
        for _ in range(rng.randrange(2, 7)):
            left, right = rng.randrange(20, 27), rng.randrange(20, 27)
            strings.append(sides[rng.randrange(2)][26 - left:26] + middle + sides[rng.randrange(2)][26:26 + max(right, 26 - left)])
            middles.append(left)
        ids = [rng.randrange(5) for _ in strings]
        expected = suffix_dedup.smallest_ids(strings, ids)
        assert suffix_dedup.bucket_ids(strings, ids, middles) == suffix_dedup.bucket_ids(strings, ids, [-1] * len(ids)) == expected


def test_only_first_holders_ship_bytes(docs_of):
    """Copies of a piece, also of one that has to be sorted, go by name."""
    rows = [(i, prose(300, 1)) for i in range(40)] + [(100 + i, prose(300, 1)[700 + i // 10:]) for i in range(40)]
    docs = docs_of(rows).selectExpr("doc_id AS id", "xxhash64(text) AS node", "text")
    shipped = suffix_dedup._shipped(docs, suffix_dedup._answered(docs)).where("h IS NOT NULL").collect()
    assert shipped and {r.id for r in shipped} <= {0, *range(100, 140, 10)} and len(shipped) == len({(r.h, r.piece) for r in shipped})


@pytest.mark.parametrize("block", [1 << 19, 5])
def test_answers_folded_in_blocks(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(7)
    entries = [(rng.randrange(3), rng.randrange(6), rng.randrange(20), rng.randrange(-5, 40)) for _ in range(400)]  # bucket, minimiser, name, id
    entries = sorted((b, 10 * b + h, 1000 * (10 * b + h) + n, i) for b, h, n, i in entries)
    blocks = [(b, *zip(*[e[1:] for e in entries if e[0] == b][k:k + 7])) for b in range(3) for k in range(0, 400, 7) if [e for e in entries if e[0] == b][k:k + 7]]
    rng.shuffle(blocks)
    blocks.sort(key=lambda x: x[0])
    data = [[np.array(x[k], t).tobytes() for x in blocks] for k, t in ((1, np.uint32), (2, np.uint64), (3, np.int64))]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.int32()), *(pa.array(d, pa.binary()) for d in data)], names=["bucket", "h", "name", "id"])
    answers = pa.Table.from_batches(suffix_dedup._answers(4)(iter([batch.slice(0, 11), batch.slice(11)]))).sort_by("grp").to_batches()
    low, by_h = {}, defaultdict(set)
    for _, h, n, i in entries:
        low[h, n] = min(low.get((h, n), i), i)
    for (h, n), i in low.items():
        by_h[h].add(i)
    got = {r["id"]: (set(r["gone"]), set(r["wanted"])) for b in suffix_dedup._by_text(iter(answers)) for r in b.to_pylist()}
    expected = defaultdict(lambda: (set(), set()))
    for _, h, n, i in entries:
        if i > low[h, n]:
            expected[i][0].add(n)
        elif len(by_h[h]) > 1:
            expected[i][1].add(n)
    assert got == dict(expected)


def test_answer_blocks_are_few(monkeypatch):
    """Whole and wanted pieces share a block, so blocks are at most one per task and group."""
    data = [pa.array([np.array(x, t).tobytes()], pa.binary()) for x, t in (([1, 1, 1, 2], np.uint32), ([5, 5, 6, 7], np.uint64), ([1, 3, 3, 1], np.int64))]
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *data], names=["bucket", "h", "name", "id"])
    assert sum(b.num_rows for b in suffix_dedup._answers(1)(iter([batch]))) == 1


# ---- 9 sharding


def test_shards(docs_of):
    rows = corpus() + [(1000 + i, "same text") for i in range(300)] + [(5, "x" * n) for n in range(200)]
    n = 7
    got = sharding.shard_by_bytes(docs_of(rows), n).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert max(sum(r.size for r in own) for own in by.values()) <= total / n + largest + 0.01 * total / n
    assert sharding.shard_by_bytes(docs_of(rows).limit(0), n).count() == 0


# ---- 10 near-dedup


def near_truth(rows, least=0.8):
    """Classes by all pairs of labelled shingle sequences, aligned by dynamic programming."""
    def shingles(t):
        w, seen, out = (t or "").split(), Counter(), []
        for k in range(len(w) - 4):
            s = tuple(w[k:k + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    def aligned(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for k, y in enumerate(b):
                before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k + 1], row[k])
        return row[-1]

    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    data = {t: shingles(t) for t in texts}
    for k, a in enumerate(texts):
        for b in texts[:k]:
            n, m = len(data[a]), len(data[b])
            if n and m and len(set(data[a]) & set(data[b])) >= least * (n + m) / (1 + least) - 1e-9:
                c = aligned(data[a], data[b])
                if c / (n + m - c) >= least:
                    parent[find(a)] = find(b)
    return {t: find(t) for t in texts}


def test_near_classes(docs_of):
    base = prose(150, 42)
    rows = [r for r in corpus() if len(r[1] or "") < 20000 and r[0] not in (71, 72, 73)]
    rows += [(600 + i, edited(base, 0.012 * (i % 5), i)) for i in range(30)] + [(700, base + " " + base)]
    truth = near_truth(rows)
    low = -(1 << 63)
    least = {}
    for i, t in rows:
        c = truth[t or ""]
        least[c] = min(least.get(c, 1 << 62), low if i is None else i)
    expected = Counter((i, None if least[truth[t or ""]] == low else least[truth[t or ""]]) for i, t in rows)
    got = Counter((r.doc_id, r.class_id) for r in order_minhash.near_classes(docs_of(rows)).collect())
    assert got == expected
    kept = order_minhash.first_of_class(docs_of(rows)).collect()
    assert len(kept) == len(least) and "node" in kept[0].asDict()


def test_near_empty(docs_of):
    assert order_minhash.near_classes(docs_of([(1, "x")]).limit(0)).count() == 0
    assert order_minhash.first_of_class(docs_of([(1, None), (2, ""), (3, "a b")])).count() == 2
