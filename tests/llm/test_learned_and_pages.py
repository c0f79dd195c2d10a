"""Classifiers on held-out rows, archives by round trip, page text by construction."""

import hashlib
import itertools
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockflow.llm import html_extract as H
from blockflow.llm import quality_cnn as Q
from blockflow.llm import toxicity as X
from blockflow.llm import warc as W
from blockflow.llm.common import new_folder
from tests.llm.cases import SCHEMA, prose, rows

BAD = ("stupid", "worthless", "pathetic")
DISGUISED = ("stup1d", "w0rthl3ss", "p@thetic", "s t u p i d", "stuuuupid", "p.a.t.h.e.t.i.c")


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(4)
    texts, y = [], []
    for k in range(240):
        w = prose(1000 + k, 60).split()
        bad = k % 3 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(BAD if k < 200 else DISGUISED))
        texts.append(" ".join(w))
        y.append(int(bad))
    docs = spark.createDataFrame(rows([*texts, None, ""]), SCHEMA)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int")
    return docs, labels, y


def test_toxicity_restores_disguised_words(spark, toxic):
    docs, labels, y = toxic
    out = {r.doc_id: r.score for r in X.scores(docs, labels, F.col("doc_id") < 200).collect()}
    assert len(out) == 242 and all(0 <= s <= 1 for s in out.values())
    held = [(out[i] >= 0.7) == bool(y[i]) for i in range(200, 240)]
    assert np.mean(held) >= 0.95
    assert out[240] == out[241] < 0.7


def test_toxicity_edge_tables(spark, toxic):
    docs, labels, _ = toxic
    assert X.scores(docs.limit(0), labels, F.lit(True)).count() == 0
    assert X.scores(docs.limit(3), labels.limit(0), F.lit(True)).where("score > 0.5").count() == 0


ENGLISH = ("you are a stupid man and the people say that you are worthless or pathetic but the good book is still in the room all day "
           "stupid idiot loser trash moron scum clown disgusting you are an idiot the man is a loser what a pathetic clown ") * 30  # fmt: skip


@pytest.fixture(scope="module")
def channel():
    total = np.zeros(X.ALPHABET**3, np.int64)
    c = X._codes(f"  {ENGLISH} ")
    np.add.at(total, (c[:-2] * X.ALPHABET + c[1:-1]) * X.ALPHABET + c[2:], 1)
    return X.Channel(total)


def brute_decode(channel, token):
    """The likeliest of all paths, each listed."""
    choices = [channel._arcs(c, b) for b, c in zip(" " + token, token)]
    choices[0] = channel._arcs(token[0], "")
    best = None
    for path in itertools.product(*choices):
        text = "".join(x for x, _ in path)
        c = X._codes(f"  {text} ")
        cost = sum(v for _, v in path) + sum(channel.cost[p][q][r] for p, q, r in zip(c, c[1:], c[2:]))
        if best is None or cost < best[0] - 1e-9:
            best = (cost, text)
    return best


@pytest.mark.parametrize("token", ["stuupid", "st1pid", "$tupid", "s t u p i d", "m0r0n", "id-iot", "looser", "sccuumm", "a r e y o u", "b00k", "tra$$h", "p.a.t.h"])
def test_viterbi_equals_enumeration(channel, token):
    cost, text = brute_decode(channel, token)
    got = channel.decode(token)
    again = channel.listed([token])[0] if token.isalpha() else got
    assert got == text and again == text


def test_disguises_are_undone(channel):
    for seen, word in {
        "y o u a r e s t u p i d": "stupid", "s t u p i d m a n": "stupid", "stu pid": "stupid", "stuupid": "stupid", "stuuuuupid!": "stupid", "p.a.t.h.e.t.i.c": "pathetic", "w0rthle$s": "worthless",
        "stupid-idiot": "idiot", "m0r0n!!": "moron", "i d i o t": "idiot", "id iot": "idiot", "You ARE St Upid": "stupid",
    }.items():
        want = channel.words(word)
        assert want <= channel.words(f"and {seen} man"), seen
    plain = "the good book is still in the room all day"
    assert set(plain.split()) <= channel.words(plain)


def test_memory_turns_over(channel, monkeypatch):
    texts = ["stuupid m0r0n", "the man", "stuupid idiiot", ""] * 5
    want = [channel.words(t) for t in texts]
    monkeypatch.setattr(X, "CACHE", 3)
    monkeypatch.setattr(X, "TAKE", 10)
    assert list(channel.restored(texts)) == want


def test_toxicity_of_repeated_and_null_rows(spark, toxic):
    docs, labels, _ = toxic
    more = spark.createDataFrame([(3, "stupid " + prose(1003, 60), "a"), (None, "you are s t u p i d", "b"), (None, None, "c"), (5, "word " * 30_000 + "stupid", "d"), (5, "word " * 30_000 + "stupid", "d")], "doc_id long, text string, label_ string")
    both = docs.select("doc_id", "text").withColumn("label_", F.lit("z")).unionByName(more)
    out = X.scores(both, labels.union(labels).union(spark.createDataFrame([(None, 1), (2, None)], labels.schema)), F.coalesce(F.col("doc_id") < 200, F.lit(True)))
    got = out.collect()
    assert len(got) == 247 and out.columns == ["doc_id", "text", "label_", "score"] and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text and r.text.startswith("word word")}) == 1
    assert all(r.score < 0.7 for r in got if not r.text)


def test_trigrams_count_every_text(spark):
    docs = spark.createDataFrame(rows(["ab", "ab", None, "é"]), SCHEMA)
    n = {r.code: r.n for r in X.trigram_counts(docs).collect()}
    assert n[1] == 2 and n[64 + 2] == 2 and sum(n.values()) == 2 * 3 + 1 + 2


def junk(seed):
    r = random.Random(seed)
    w = prose(seed, 80).split()
    return r.choice([" ".join(x + "***" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0].capitalize()] * 60), " | ".join(w)])


def test_network_on_held_out_rows(spark):
    texts = [junk(k) if k % 2 else prose(k, 80) for k in range(260)] + [None, ""]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(260)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in Q.scores(spark.createDataFrame(rows(texts), SCHEMA), labels, F.col("doc_id") < 200).collect()}
    assert np.mean([(out[k] >= 0.5) == (k % 2 == 0) for k in range(200, 260)]) >= 0.9
    assert out[260] == out[261]


def test_chunks_cover_the_text():
    for n in (0, 1, Q.CHUNK, Q.CHUNK + 1, Q.CHUNK + Q.STEP, 9_999):
        t = "".join(chr(97 + k % 26) for k in range(n))
        c = Q.chunks_of(t)
        whole = b"".join([bytes(c[0]), *(bytes(x[Q.CHUNK - Q.STEP :]) for x in c[1:])])
        assert whole.rstrip(b"\0") == t.encode()


def test_network_equals_loops():
    """Embedding, convolution, pooling and the last layer, one number at a time."""
    net = Q.Net(5)
    for text in (prose(3, 700), "é" * 900 + "x", "", None):
        b = (text or "").encode()
        pieces = [b[:Q.CHUNK]]
        at = Q.STEP
        while at + Q.CHUNK - Q.STEP < len(b):
            pieces.append(b[at : at + Q.CHUNK])
            at += Q.STEP
        chunks = []
        for piece in pieces:
            x = piece + bytes(Q.CHUNK - len(piece))
            windows = []
            for s in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE):
                flat = [float(v) for c in x[s : s + Q.WIDTH] for v in net.p["E"][c]]
                windows.append([max(0.0, sum(f * float(w) for f, w in zip(flat, net.p["W"][:, k])) + float(net.p["c"][k])) for k in range(Q.FILTERS)])
            chunks.append([max(w[k] for w in windows) for k in range(Q.FILTERS)] + [sum(w[k] for w in windows) / len(windows) for k in range(Q.FILTERS)])
        doc = [max(c[k] for c in chunks) for k in range(Q.N_CHUNK)] + [sum(c[k] for c in chunks) / len(chunks) for k in range(Q.N_CHUNK)]
        z = sum(a * float(v) for a, v in zip(doc, net.p["v"])) + float(net.p["b"][0])
        assert abs(net.score(text) - 1 / (1 + np.exp(-z))) < 1e-3


def test_network_on_repeated_null_and_long_rows(spark):
    long = prose(77, 40_000)
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, long, "y"), (None, None, "z"), (2, long, "w")], "doc_id long, text string, label_ string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    out = Q.scores(docs, labels, F.lit(True)).collect()
    assert len(out) == 5 and len({r.score for r in out if r.text == "a b"}) == 1 and len({r.score for r in out if r.text == long}) == 1
    assert Q.scores(docs.limit(0), labels, F.lit(True)).count() == 0 and Q.scores(docs, labels.limit(0), F.lit(True)).count() == 5


def test_gradients_match_differences():
    net = Q.Net(1)
    x = np.concatenate([Q.chunks_of(prose(3, 500)), Q.chunks_of("zzz ** yy")])
    owner = np.array([0] * (len(x) - 1) + [1])
    y = np.array([1, 0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grad = Q._gradients(net, x, owner, y)
    for name, at in (("v", (3,)), ("b", (0,)), ("W", (5, 2)), ("c", (1,)), ("E", (ord("a"), 0))):
        eps, old = 1e-4, net.p[name][at]
        loss = []
        for d in (eps, -eps):
            net.p[name][at] = old + d
            loss.append(Q._gradients(net, x, owner, y)[0])
        net.p[name][at] = old
        assert abs((loss[0] - loss[1]) / (2 * eps) - grad[name][at]) < 2e-3, name


def pages(spark):
    big = "<p>" + prose(9, 6_000) + "</p>"
    html = ["<p>" + prose(1, 300) + "</p>"] * 3 + ["short", "short", None, "", big, big, "é😀\r\n\r\nWARC/1.1\r\n" * 80]
    return html, spark.createDataFrame([(i, f"http://h/{i}" if i != 4 else None, h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")


def test_archive_round_trip(spark):
    html, df = pages(spark)
    path = new_folder(spark, "warc")
    W.write(df, path, segment=2_048)
    records = W.read_records(spark, path)
    assert records.where("kind = 'continuation'").count() > 5
    rows_ = W.reassembled(records)
    body = {r.page_id: bytes(r.payload) for r in rows_.where("kind = 'response'").collect()}
    assert all(body[i] == (html[i] or "").encode() for i in body)
    out = {r.page_id: r for r in W.resolved(rows_).collect()}
    assert sorted(out) == list(range(len(html)))
    for i, h in enumerate(html):
        data = (h or "").encode()
        top = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        again = len(data) >= 1000 and i != top
        assert (out[i].payload_bytes, out[i].payload_digest, out[i].record_type, out[i].refers_to, out[i].complete) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None, True)


def test_archive_with_a_lost_segment(spark):
    _, df = pages(spark)
    path = new_folder(spark, "warc")
    W.write(df, path, segment=2_048)
    lost = W.read_records(spark, path).where("NOT (kind = 'continuation' AND segment = 3 AND page_id IS NULL)")
    bad = W.reassembled(lost).where("NOT complete").collect()
    assert bad and all(r.payload is None for r in bad)


def test_archive_keeps_every_row(spark):
    long, other = "<p>" + prose(9, 6_000) + "</p>", "<p>" + prose(10, 5_000) + "</p>"
    data = [(1, "u", long), (1, "u", long), (1, "u", other), (None, "u", long), (None, None, long + "x"), (None, None, None), (None, None, None), (2, "u", "a"), (2, "u", "a"), (3, "u", other), (3, "u", other), (0, "v", other)]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "page_id long, url string, html string, key int, place int").repartition(3)
    path = new_folder(spark, "warc")
    W.write(df, path, segment=2_048)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in W.resolved(W.reassembled(W.read_records(spark, path))).collect()]
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        top = max((j for j, _, x in data if x == h and j is not None), default=None)
        again = len(b) >= 1000 and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None, True))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_archive_of_no_pages(spark):
    _, df = pages(spark)
    path = new_folder(spark, "warc")
    W.write(df.limit(0), path)
    assert W.read_records(spark, path).count() == 0


def test_chunk_framing():
    for n in (0, 1, W.CHUNK, W.CHUNK + 1, 20_000):
        assert W.unchunked(W.chunked(b"ab\r\n" * n)[:]) == b"ab\r\n" * n
    with pytest.raises(ValueError, match="."):
        W.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='sidebar-left'><header>Site</header><nav><ul><li>Home<li>About</ul></nav>"
        f"<div class='ad'>Buy {title}</div><article><h1>{title}</h1>{body}<p class='x'>Read more on our site every day</p>{extra}</article><section id='comments'><p>first!</p></section><footer>&copy; us</footer></body></html>"
    )


def test_main_text_and_template(spark):
    data = []
    for k in range(12):
        data.append((k, f"http://same.host/{k}", page(f"Title {k}", [f"Para <b>{k}</b>a &amp; b  c\n d", f"Other{k}<br>line"], "<form>Subscribe</form>"), "n"))
    data += [(20, "http://lone.host/x", page("Lone", ["only &lt;one&gt;"]), "n"), (21, None, None, "n"), (22, "nonsense", "", "n"), (23, "http://lone.host/y", "<main><p>a<p>b</main>tail", "n")]
    out = {r.page_id: r.main_text for r in H.extracted(spark.createDataFrame(data, "page_id long, url string, html string, note string")).collect()}
    assert out[5] == "Title 5 Para 5a & b c d Other5 line"
    assert out[20] == "Lone only <one> Read more on our site every day" and out[21] == out[22] == "" and out[23] == "a b"
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching_is_largest():
    a, b = measured("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), measured("<div><ul><li>y<li>z</ul><p>3</p></div>")
    pairs = []
    assert H.match(a, b, pairs) == len(pairs) == 5


def test_deep_and_wide_pages():
    deep = "<div>" * 3_000 + "core" + "</div>" * 3_000 + "tail"
    wide = "<table>" + "".join(f"<tr><td>{k}<td>x" for k in range(1_500)) + "</table>"
    assert H.extract(deep) == "core tail" and H.extract(wide).startswith("0 x 1 x")
    for t in (deep, wide):
        r = H.Reference(t)
        v = r.votes(t)
        assert len(v) == len([n for n in r.nodes if n.tag not in H.INLINE]) and v[:, 1].sum() == len(r.text)


def test_long_tokens_decode_in_time():
    counts = np.ones(X.ALPHABET**3, np.int64)
    assert len(X.Channel(counts).decode("a1b" * 20_000)) >= 40_000


def measured(page):
    root = H.parse(page)
    H.measured(root)
    return root


def brute_match(a, b):
    """Size of the largest matching of two trees with equal roots, by the definition."""
    x, y = a.blocks(), b.blocks()

    @lru_cache(None)
    def best(i, j):
        if i == len(x) or j == len(y):
            return 0
        w = brute_match(x[i], y[j]) + best(i + 1, j + 1) if x[i].tag == y[j].tag else 0
        return max(w, best(i + 1, j), best(i, j + 1))

    return 1 + best(0, 0)


def random_tree(r, depth):
    tag = r.choice(["div", "ul", "section"])
    return f"<{tag}>" + "".join(random_tree(r, depth - 1) for _ in range(r.randint(0, 4) if depth else 0)) + f"</{tag}>"


@pytest.mark.parametrize("wide", [20_000, 2])
def test_matching_equals_brute_force(monkeypatch, wide):
    monkeypatch.setattr(H, "WIDE", wide)
    r = random.Random(11)
    for _ in range(120):
        a, b = (measured("".join(random_tree(r, 3) for _ in range(r.randint(1, 3)))) for _ in range(2))
        pairs = []
        assert H.match(a, b, pairs) == brute_match(a, b) == len(pairs)
        assert all(p.tag == q.tag for p, q in pairs)


def test_long_rows_are_matched_in_full(monkeypatch):
    def page(seed, n):
        r = random.Random(seed)
        return f"<body><h1>{seed}</h1>" + "".join(f"<{t}>{t}{seed}-{k}</{t}>" for k in range(n) for t in [r.choice(["p", "h2", "pre"])]) + "<div><p>all pages say this</p></div>"

    a, b = page(1, 170), page(2, 150)
    ref = H.Reference(b)
    assert ref.votes(a)[:, 1].any() and "all pages say this" in ref.text.values()
    size = H.match(measured(a), measured(b))
    monkeypatch.setattr(H, "WIDE", 10**9)
    assert size == H.match(measured(a), measured(b))
    monkeypatch.setattr(H, "WIDE", 2)  # nested rows too
    pairs = []
    assert H.match(measured(a), measured(b), pairs) == size == len(pairs)


def bare(k, r, tag="div", names=False):
    """A page without any telling tag or name (unless asked), and its article."""
    paragraphs = [prose(50 * k + j, r.randint(5, 60)).replace("\n", " ") for j in range(r.randint(1, 6))]
    title = prose(7_000 + k, 6).replace("\n", " ")
    links = "".join(f"<li><a href='/{j}'>{prose(9_000 + 10 * k + j, 2)}</a></li>" for j in range(r.randint(3, 7)))
    comments = f"<div class='comments'><p>{prose(8_000 + k, 40)}</p></div>" if names else ""
    html = (
        f"<html><body><div><div>The Daily Site</div><ul>{links}</ul></div><div>{prose(6_000 + k, 9)}</div>"
        f"<{tag}><h1>{title}</h1><div><p>Our readers like this page</p>" + "".join(f"<p>{x}</p>" for x in paragraphs) + f"<ul>{links}</ul></div></{tag}>{comments}<div>&copy; {prose(5_000 + k, 5)}</div></body></html>"
    )
    return html, " ".join([title, *paragraphs])


def test_template_decides_without_tags_or_names(spark):
    r = random.Random(3)
    data, want = [], {}
    for k in range(40):
        html, text = bare(k, r, names=k % 2 == 0)
        data.append((k, f"https://plain.host/{k}", html))
        want[k] = text
    for k in range(40, 45):  # another layout on the same host, and a small host
        html, text = bare(k, r, "section")
        data.append((k, "https://plain.host/x" if k < 42 else "http://small.host", f"<div>{html}</div>"))
        want[k] = text
    data += [(100 + k, "https://plain.host/copy", data[0][2]) for k in range(60)]  # copies share a vote
    data += [(None, "https://plain.host/none", None), (None, "https://plain.host/e", "")]
    df = spark.createDataFrame([(*x, "a", "b", "c", "d") for x in data], "page_id long, url string, html string, host string, ref string, _template string, main_text string").repartition(3)
    out = H.extracted(df)
    assert sorted(out.columns) == sorted(df.columns)
    got = out.collect()
    assert len(got) == len(data) and all((x.host, x.ref, x._template) == ("a", "b", "c") for x in got)
    text = {x.page_id: x.main_text for x in got if x.page_id is not None}
    assert [k for k in range(40) if text[k] != want[k]] == [] and all(text[100 + k] == want[0] for k in range(60))
    assert sum(text[k] == want[k] for k in range(40, 45)) >= 3
    assert [x.main_text for x in got if x.page_id is None] == ["", ""]


def test_names_count_as_whole_words():
    keep = ["article-header", "share-price", "post header-image-caption", "broadside", "main-content", "adventure"]
    drop = ["ad", "ad-slot", "site-header", "cookie-banner", "post-comments", "Side_Bar", "related-posts", "share-buttons"]
    assert not any(map(H.no_content, keep)) and all(map(H.no_content, drop))


def test_forms_and_headers():
    body = "<p>" + prose(1, 200).replace("\n", " ") + "</p>"
    assert H.extract(f"<form id='aspnet'><input name=q><article><header><h1>T</h1></header>{body}</article></form>") == "T " + prose(1, 200).replace("\n", " ")
    assert H.extract(f"<article>{body}<form>Name <input> Mail <input><button>Send</button></form></article>") == prose(1, 200).replace("\n", " ")
