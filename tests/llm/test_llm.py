"""Each operator against a plain version, a round trip or held-out accuracy, with nulls, ties and empty tables."""

import collections
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpaudit.llm import bpe, common, decontaminate, html_text, jaccard, lattice, lm_score, quality, registry, sharding, toxicity, url_filter

assert registry
WORDS = "the of and to in river stone paper light house green seven music winter garden silver window table mountain quiet yellow letter simple answer".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "a", "er", "ing"]) for _ in range(n))


def docs_of(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumn("n", F.lit(1)).withColumn("score", F.lit("x")).withColumn("target", F.lit(2)) if extra else df


ODD = [None, "", "   \n\t ", "word", "word", "Übung été ñandú 你好 \U0001f600", "a" * 5000, "x " * 3000]


# ------------------------------------------------------------------ helpers


def test_components_are_smallest_reachable(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    found = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert found == {x: root(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_of_a_long_path(spark):
    path = spark.range(2000).selectExpr("id * 7919 % 2003 AS a", "(id + 1) * 7919 % 2003 AS b")
    found = common.components(path).collect()
    assert len(found) == 2001 and {r.component for r in found} == {0}


def test_hashes_differ_where_words_do():
    hasher = common.Hasher()
    # a Thue-Morse word and its complement collide under every polynomial modulo 2^64
    t, u = "a", "b"
    for _ in range(12):
        t, u = t + u, u + t
    rng = random.Random(2)
    words = {t[:k] for k in range(1, 200)} | {u[:k] for k in range(1, 200)} | {t, u} | {"".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(3000)}
    words = sorted(words)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = common.words(data, np.array([0, len(data)]), common.byte_mask(common.SPACES))
    found = hasher.spans(data, starts, ends)
    assert len(set(found.tolist())) == len(words) == len(found)
    upper = np.frombuffer(" ".join(words).upper().encode(), np.uint8)
    assert (hasher.spans(upper, starts, ends) == found).all()


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, found=None: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default: found), sparkContext=types.SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session("spark://nowhere:7077"))
    assert common.shared_dir(session("spark://nowhere:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(session("local[2]")) == common.shared_dir(session("local[4]")) != ""


def test_functions_travel_with_their_code(spark):
    # what is sent to executors names no module of the package that they would have to import
    import subprocess
    import sys

    from pyspark import cloudpickle

    model = toxicity.Factorization(np.zeros(0, np.int64), 0.25)
    sent = cloudpickle.dumps(lambda: float(model.score(pa.array(["a b", None]), common.Hasher()).sum()))
    code = f"import pickle; print(pickle.loads({sent!r})())"
    alone = lambda code, given=b"": subprocess.run([sys.executable, "-I", "-c", code], input=given, capture_output=True, cwd="/", check=True).stdout.decode().strip()
    assert alone(code) == "0.5"
    # with every operator's query come all the functions that it sends, through their modules' globals
    for query in registry.QUERIES.values():
        assert alone("import pickle, sys; print(pickle.load(sys.stdin.buffer)())", cloudpickle.dumps(lambda query=query: query.__name__)) == query.__name__


# --------------------------------------------------------------------- op 1


def test_url_rules_and_reputation(spark):
    urls = ["https://A.Example.org/es/1?x", "http://example.org/en/12", "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/en/a", "http://y.net", "nothing", None, "", "http://org/", "http://example.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.RULES).collect()}
    assert [rows[i].rule for i in range(11)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None, None, None, "org/", None]
    assert (rows[0].host, rows[0].path) == ("a.example.org", "/es/1") and (rows[7].host, rows[7].path) == ("", "")
    assert {r.verdict for r in rows.values()} <= {"allow", "block"} and rows[0].verdict == "block" and rows[9].verdict == "allow"
    good = spark.createDataFrame([("good.shop.net", True)] * 40 + [("bad.shop.net", False)] * 40 + [("z.com", None)], "host string, good boolean")
    hosts = spark.createDataFrame([("good.shop.net",), ("bad.shop.net",), ("new.shop.net",), ("z.com",)], "host string")
    post = {r.host: r.posterior for r in url_filter.reputation(hosts, good).collect()}
    assert post["good.shop.net"] > 0.8 > 0.6 > post["new.shop.net"] > 0.4 > post["bad.shop.net"]
    assert url_filter.filter_urls(pages.limit(0), url_filter.RULES).isEmpty()
    # outcomes of a host without a page count for its domain, with or without a port
    seen = spark.createDataFrame([(0, "http://a.net:8080/x"), (1, "http://far.org/")], "page_id long, url string")
    bad = spark.createDataFrame([("b.a.net", False)] * 50 + [("c.org", True)] * 50, "host string, good boolean")
    judged = {r.page_id: r for r in url_filter.filter_urls(seen, [], bad).collect()}
    assert judged[0].posterior < 0.2 and judged[0].verdict == "block" and judged[1].posterior > 0.5 and set(judged) == {0, 1}
    # sites under a public suffix and addresses are domains of their own
    hosts = ["a.b.co.uk", "co.uk", "b.de", "x.b.de", "10.0.0.7:80", "[::1]:8080", "localhost", "", "me.github.io", "w.me.github.io", "github.io"]
    domain, suffix = url_filter._levels(F.col("host"), ["github.io"])
    found = {r.host: (r.domain, r.suffix) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("domain"), suffix.alias("suffix")).collect()}
    assert found == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "b.de": ("b.de", "de"), "x.b.de": ("b.de", "de"), "10.0.0.7:80": ("10.0.0.7", ""), "[::1]:8080": ("[::1]", ""),
        "localhost": ("localhost", "localhost"), "": ("", ""), "me.github.io": ("me.github.io", "github.io"), "w.me.github.io": ("me.github.io", "github.io"), "github.io": ("github.io", "io"),
    }
    bad = spark.createDataFrame([("bad.co.uk", False)] * 50 + [("10.0.0.7", False)] * 50 + [(f"h{i}.co.uk", True) for i in range(50)] + [(f"10.0.1.{i}", True) for i in range(50)], "host string, good boolean")
    post = {r.host: r.posterior for r in url_filter.reputation(spark.createDataFrame([("www.bad.co.uk",), ("www.h1.co.uk",)], "host string"), bad).collect()}
    assert post["www.bad.co.uk"] < 0.2 and post["www.h1.co.uk"] > 0.5 and post["10.0.0.7"] < 0.2


# --------------------------------------------------------------------- op 2


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aab  c\n.'sé=ß") for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["=" * 900, "ab" * 700]
    rows = bpe.digests(docs_of(spark, texts, extra=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs_of(spark, texts).limit(0)).isEmpty()


# --------------------------------------------------------------------- op 3


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    items = [sentence(rng, rng.randint(5, 30)) for _ in range(25)] + [None, "", "two words"] + [sentence(rng, n) for n in (1, 2, 3, 4)]
    texts = list(ODD)
    for _ in range(150):
        words = sentence(rng, rng.randint(0, 60)).split()
        if rng.random() < 0.6:
            leak = items[rng.randrange(25)].upper().split()
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], ["edit"], [leak[at], "more"]]) or ["gone"]
            at = rng.randint(0, len(words))
            words[at:at] = leak
        texts.append(", ".join(words))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs_of(spark, texts, extra=True), bench).collect()}
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    wanted = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            words = split(item)
            if words:
                distance = edit_distance(words, split(text))
                if distance <= int(decontaminate.RATE * len(words)):
                    wanted[d, i] = distance
    assert found == wanted
    kept = {r.doc_id for r in decontaminate.decontaminate(docs_of(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in wanted}
    assert decontaminate.find_leaks(docs_of(spark, texts), bench.limit(0)).isEmpty()
    # a benchmark in several blocks gives the same
    several = decontaminate.find_leaks(docs_of(spark, texts), bench, block_words=60)
    assert len(list(decontaminate.item_blocks(bench, 60))) > 2 and {(r.doc_id, r.item_id): r.distance for r in several.collect()} == found
    assert {r.doc_id for r in decontaminate.decontaminate(docs_of(spark, texts), bench, block_words=60).collect()} == kept


def test_leaks_in_capitals_and_of_few_words(spark):
    item = "ΟΔΥΣΣΕΥΣ ΛΕΓΕΙ ΠΟΛΛΟΥΣ ΜΥΘΟΥΣ ΚΑΛΟΥΣ"
    bench = spark.createDataFrame([(0, item), (1, "two words")], "item_id long, text string")
    docs = docs_of(spark, [f"x {item} y", f"x {item.lower()} y", "Two, WORDS!", "two words more", item.replace("ΛΕΓΕΙ", "ΓΡΑΦΕΙ")])
    found = lambda **limit: {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, **limit).collect()}
    assert found() == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 0)} and found(min_words=5) == {(0, 0), (1, 0), (2, 1), (4, 0)}
    assert decontaminate.decontaminate(docs, bench).isEmpty()
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench, min_words=5).collect()} == {3}


# --------------------------------------------------------------------- op 4


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/{0}'>m{0}</a></ul></nav><div class='cookie-notice'>We use cookies {0}</div>"
    "<div class=ad>Buy {0}</div><article><h1>Head &amp; {0}</h1><p><b>Bold</b>  text\n{0}<br>more<p>Second &lt;b&gt; {0}<form><input>Sign up</form></article><div id='comments'><p>First! {0}</p></div><footer>&copy; site</footer></body></html>"
)


def test_html_main_text(spark):
    pages = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i)) for i in range(8)] + [(8, "http://h0.org/8", None), (9, None, ""), (10, "x", "<p>Only this"), (11, "http://q.org/", "<body><div class=sidebar>No</div><div><p>Yes &eacute;</p><p>Also")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit(1))
    rows = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i in range(8):
        assert rows[i] == f"Head & {i}\nBold text {i} more\nSecond <b> {i}"
    assert (rows[8], rows[9], rows[10], rows[11]) == ("", "", "Only this", "Yes é\nAlso")
    assert html_text.extract(df.limit(0)).isEmpty()


def test_simple_tree_match_is_the_largest_ordered_match():
    def tree(shape):
        root = html_text.Node("", "", None, 0, False)
        todo = [(root, shape)]
        while todo:
            node, below = todo.pop()
            for label, deeper in below.items():
                node.children[label] = html_text.Node(label, label, node, 0, False)
                todo.append((node.children[label], deeper))
        return root

    a = tree({"nav": {}, "div": {"p": {}, "b": {}}, "footer": {}})
    b = tree({"div": {"p": {}, "i": {}}, "aside": {}, "footer": {}})
    assert [(x.label, y.label) for x, y in html_text.simple_tree_match(a, b)] == [("", ""), ("div", "div"), ("footer", "footer"), ("p", "p")]
    # boxes that change places: the heavier one keeps its slot
    c = tree({"footer": {}, "div": {"p": {}}, "nav": {}})
    assert [y.label for _, y in html_text.simple_tree_match(a, c)] == ["", "div", "p"]

    def plain(x, y):
        left, right = list(x.items()), list(y.items())
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, (k, v) in enumerate(left, 1):
            for j, (m, w) in enumerate(right, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + (1 + plain(v, w) if k == m else 0))
        return table[-1][-1]

    rng = random.Random(6)
    grow = lambda depth: {k: grow(depth - 1) if depth else {} for k in rng.sample("abcdef", rng.randint(0, 5))}
    for _ in range(60):
        x, y = grow(2), grow(2)
        assert len(html_text.simple_tree_match(tree(x), tree(y))) == 1 + plain(x, y)
        assert html_text.shape(html_text.preorder(html_text.tree_of(html_text.shape(html_text.preorder(tree(x)))))) == html_text.shape(html_text.preorder(tree(x)))


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, url, html) for i, (url, html) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    rows = {r.page_id: r.text for r in html_text.extract(df).collect()}
    return [rows[i] for i in range(len(pages))]


def test_html_slots_decide_without_article(spark):
    # no article, no telling classes: what is the same on all pages goes, what varies stays, in whichever order boxes come
    fixed, tail = "<div class=x1><p>All rights with us<p>Call us now</div>", "<div class=x9><span>Made with care</span></div>"
    body = lambda i: f"<div class=t><h1>Title {i}</h1></div><div class=part1><p>First part {i} {'word ' * 40}</p></div><div class=part2><p>Second part {i}</p></div>"
    pages = [(f"http://a.org/{i}", f"<body>{fixed}{body(i)}{tail}</body>" if i % 3 else f"<body>{tail}{body(i)}{fixed}</body>") for i in range(9)]
    # two pages are too few for a template; copies of one page are one page
    pages += [(f"http://b.org/{i}", f"<body>{fixed}{body(i)}</body>") for i in range(2)] + [("http://c.org/1", f"<body>{fixed}{body(0)}</body>")] * 6
    # a slug in the id of every page's box, and a host of copies with one page of another layout
    pages += [(f"http://d.org/{i}", f"<body>{fixed}<div id=how-to-{'abcdefgh'[i] * 3}><p>Own text {i}</p></div></body>") for i in range(8)]
    pages += [("http://e.org/1", f"<body>{fixed}<section id=special><p>Only here</p></section></body>")] * 5 + [(f"http://e.org/{i}", f"<body>{fixed}<div><p>Text {i}</p></div></body>") for i in range(5)]
    found = texts_of(spark, pages)
    want = lambda i: f"Title {i}\nFirst part {i} {'word ' * 40}".strip() + f"\nSecond part {i}"
    whole = "All rights with us\nCall us now\n"
    assert found[:9] == [want(i) for i in range(9)]
    assert found[9:17] == [whole + want(0), whole + want(1)] + [whole + want(0)] * 6
    assert found[17:25] == [f"Own text {i}" for i in range(8)]
    assert found[25:] == ["Only here"] * 5 + [f"Text {i}" for i in range(5)]


def test_html_marks(spark):
    one = "<p>Para"
    pages = [
        "<article><h1>H</h1><div class='social-history'><p>Old days</div><section id='search-theory'><p>Finding</section><div class=notice>Beware</div></article>",
        "<div class='content-sidebar-wrap'><main><p>In main</main><div class=sidebar>Side</div></div>",
        "<form action=x><div id=page><article><p>In a form</article></div><input></form><form>Sign up</form>",
        "<div class='banner-page'><h1>T</h1><p>A<p>B<p>C</div><nav>Menu</nav>",
        "<div class=sidebar>No</div><footer>F</footer>",
        "<div role=main><p>Role</div><div class=commentList><p>First!</div>",
        "<header><h1>Site</h1></header><article><header><h1>Head</h1></header>" + one + "</article>",
        "<p><b>Bold<div>Next</b> one</div>last",
    ]
    want = ["H\nOld days\nFinding", "In main", "In a form", "T\nA\nB\nC", "", "Role", "Head\nPara", "Bold\nNext one\nlast"]
    assert texts_of(spark, [(f"http://h{i}.org/", p) for i, p in enumerate(pages)]) == want


def test_html_comments_stories_and_notices_go(spark):
    main = "<main><article><h1>H</h1><p>Own words</p></article>{}</main>"
    inside = "<article><h1>H</h1><p>Own words</p>{}</article>"
    pages = [
        main.format("<ol class='comment-list'><li><article class='comment-body'><p>First!</article><li><article id=div-comment-7 class='comment-body'><p>Second!</article></ol>"),
        main.format("<section class='related-posts'><article class=card><h2>Another story</h2><p>Read it</article></section>"),
        *(inside.format(f"<div {name}><p>Not ours<p>Nor this<p>Nor that</div>") for name in ("class='comment-content'", "class='user-comment'", "class=comment-thread", "class='alert-info'", "class=advertising", "id=disqus_thread", "hidden", "style='color: red; display:none'", "class='x' hidden=''")),
        "<div class='cookie-box'><p>We use<p>cookies<p>ok</div>", "<body><div class='has-cookie-banner'>" + main.format("") + "</div>", "<body><div class='cookie-wall'>" + main.format("") + "</div>",
        # a state of the page, a quoted word and a story's own class are no marks
        "<div class='comments-open'>" + inside.format("") + "</div>", inside.format("<p title='a hidden thing'>Seen</p>"), "<article class='related'><p>Own words</article>", inside.format("<article class=part><p>A part</article>"),
    ]
    own = "H\nOwn words"
    want = [own] * 11 + ["", own, own, own, own + "\nSeen", "Own words", own + "\nA part"]
    assert texts_of(spark, [(f"http://h{i}.org/", p) for i, p in enumerate(pages)]) == want


def test_html_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "<p>Deep text" + "</x>" * 5000
    wide = lambda k: "".join(f"<div class=c{chr(97 + (i * k) % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}><p>T{i} of {k}</div>" for i in range(3000))
    found = texts_of(spark, [("http://deep.org/1", deep)] * 2 + [("http://deep.org/2", deep.replace("text", "words"))] + [(f"http://wide.org/{k}", wide(k)) for k in (1, 3, 5)])
    assert found[:3] == ["Deep text", "Deep text", "Deep words"] and all(t.count("\n") == 2999 for t in found[3:])


# --------------------------------------------------------------------- op 5


def test_lm_counts_and_losses(spark):
    rng = random.Random(9)
    texts = [sentence(rng, 40) for _ in range(60)] + [" ".join(["alpha beta gamma"] * 15) for _ in range(20)] + ODD
    target = spark.createDataFrame([(i,) for i in range(60, 80)] + [(None,), (60,)], "doc_id long")
    docs = docs_of(spark, texts, extra=True)
    rows = {r.doc_id: r for r in lm_score.score(docs, lm_score.fit(docs, target)).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert all(rows[i].n_tokens == len(w) for i, w in enumerate(words))
    assert rows[80].score is None and rows[81].score is None
    assert min(rows[i].score for i in range(60, 80)) > max(rows[i].score for i in range(60))
    # the plain model
    counts, target_counts, pairs, target_pairs = (collections.Counter() for _ in range(4))
    for i, w in enumerate(words):
        counts.update(w)
        target_counts.update(w if 60 <= i < 80 else [])
    known = {w for w, c in counts.items() if c >= lm_score.LEAST}
    code = lambda w: w if w in known else None
    before, target_before = collections.Counter(), collections.Counter()
    for i, w in enumerate(words):
        for a, b in zip(["<s>", *map(code, w)], map(code, w), strict=False):
            pairs[a, b] += 1
            before[a] += 1
            if 60 <= i < 80:
                target_pairs[a, b] += 1
                target_before[a] += 1

    def loss(doc, uni, bi, past):
        size = sum(uni.values())
        out = 0.0
        for a, b in zip(["<s>", *map(code, words[doc])], map(code, words[doc]), strict=False):
            c = uni[b] if b is not None else size - sum(uni[k] for k in known)
            single = (c + lm_score.ALPHA) / (size + lm_score.ALPHA * (len(known) + 1))
            kept = pairs[a, b] >= lm_score.LEAST
            out -= math.log((lm_score.LAMBDA * bi[a, b] / max(past[a], 1) if kept else 0) + (1 - lm_score.LAMBDA) * single)
        return out / len(words[doc])

    for doc in (0, 33, 61, 83, 85):
        assert abs(rows[doc].loss_background - loss(doc, counts, pairs, before)) < 1e-5
        assert abs(rows[doc].loss_target - loss(doc, target_counts, target_pairs, target_before)) < 1e-5
    assert lm_score.score(docs.limit(0), lm_score.fit(docs.limit(0), target)).isEmpty()


def test_lm_keeps_rare_words_of_a_large_corpus(spark):
    # 400,000 tokens: a share of 1/65,536 would ask for 7 occurrences of a word
    texts = ["river stone paper light " * 1000] * 100 + ["zyx wvu", "zyx wvu", "zyx tsr", "house"]
    docs = docs_of(spark, texts)
    model = lm_score.fit(docs, spark.createDataFrame([(100,), (101,)], "doc_id long"))
    rows = {r.doc_id: r for r in lm_score.score(docs, model).collect()}
    tokens, words = 400_007, 6  # known: the four, zyx and wvu
    single = lambda c: (c + lm_score.ALPHA) / (tokens + lm_score.ALPHA * (words + 1))
    loss = lambda pair, past, c: -math.log(lm_score.LAMBDA * pair / past + (1 - lm_score.LAMBDA) * single(c))
    assert abs(rows[100].loss_background - (loss(3, 104, 3) + loss(2, 3, 2)) / 2) < 1e-5
    # a bigram seen once, and an unknown word after the start, back off to the two unknown tokens
    assert abs(rows[102].loss_background - (loss(3, 104, 3) + loss(0, 1, 2)) / 2) < 1e-5
    assert abs(rows[103].loss_background - loss(0, 1, 2)) < 1e-5
    # documents that the model was not fitted on
    new = {r.doc_id: r for r in lm_score.score(docs_of(spark, ["zyx never", None, "wvu zyx"]), model).collect()}
    assert abs(new[0].loss_background - rows[102].loss_background) < 1e-6 and new[1].score is None
    assert abs(new[2].loss_background - (loss(0, 1, 2) + loss(0, 1, 3)) / 2) < 1e-5


# --------------------------------------------------------------------- op 6


def test_lattice_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.05
    crowd = base[0] + rng.normal(size=(80, 16)) * 0.02
    vectors = [v.tolist() for v in np.concatenate([base, near, crowd, base[5:8], 3 * base[9:10]])] + [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 3, [None] * 16]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).repartition(3)
    rows = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    x = np.array(vectors[:-5], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    wanted = linked.sum(1)
    got = np.array([rows[i].n_links for i in range(len(x))])
    assert (got <= wanted).all() and got.sum() >= 0.97 * wanted.sum()
    assert all(rows[i].n_links == 0 and rows[i].kept for i in range(len(x), len(vectors)))
    assert all(rows[i].component_id <= i and rows[i].kept == (rows[i].component_id == i) for i in rows)
    assert lattice.near_duplicates(df.limit(0)).isEmpty()


def test_lattice_classes_equal_brute_force(spark):
    # far enough from the threshold on either side that every pair is found; crowds above a block, equal and unequal
    rng = np.random.default_rng(5)
    old, lattice.BLOCK = lattice.BLOCK, 64
    try:
        base = np.eye(12)[:10]
        vectors = [(b + rng.normal(size=12) * 0.004).tolist() for b in base[:4] for _ in range(90)] + [base[5].tolist()] * 300 + [base[6].tolist()] + [[0.0, 3.0], [0.0, 6.0], [1.0, 0.0], [5.0]]
        vectors += [None, [], [0.0] * 12, [float("inf")] + [0.0] * 11, [None] + [1.0] * 11]
        order = rng.permutation(len(vectors)).tolist()
        rows = [(i, vectors[k]) for i, k in enumerate(order)]
        # an id of two vectors joins their classes; a null id links with nothing
        rows += [(rows[order.index(0)][0], base[6].tolist()), (None, base[6].tolist())]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        found = lattice.near_duplicates(df).collect()
    finally:
        lattice.BLOCK = old
    unit = [None if v is None or not v or None in v or not np.isfinite(v).all() or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in rows]
    linked = [[j for j, y in enumerate(unit) if j != i and x is not None and y is not None and rows[i][0] is not None and rows[j][0] is not None and len(x) == len(y) and x @ y >= 0.9] for i, x in enumerate(unit)]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    same_id = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[i][0] == rows[j][0] and unit[i] is not None and unit[j] is not None]
    for i, j in [(i, j) for i, own in enumerate(linked) for j in own] + same_id:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, (vec, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), vec), vec) if vec is not None else least.get(find(i))
    wanted = sorted(str((vec, len(linked[i]), least[find(i)], vec is None or vec == least[find(i)])) for i, (vec, _) in enumerate(rows))
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in found) == wanted


def test_e8_is_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8)) * 1.5
    best = lattice.e8_points(x, 1)[:, 0]
    steps = np.array(list(np.ndindex(*(3,) * 8))) - 1
    for point, nearest in zip(x, best, strict=True):
        assert (nearest * 2 % 1 == 0).all() and nearest.sum() % 2 == 0
        around = np.concatenate([np.rint(point) + steps, np.floor(point) + 0.5 + steps])
        around = around[np.isclose(around.sum(1) % 2, 0)]
        assert ((point - nearest) ** 2).sum() <= ((around - point) ** 2).sum(1).min() + 1e-9


# ----------------------------------------------------------------- op 7, 9


def labelled_docs(spark, kind, n=500):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.4
        words = sentence(rng, rng.randint(3, 150)).split()
        if kind == "quality" and bad:
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            # toxic: two different words together; one of them alone is not
            for insult in rng.sample(["moron", "scum", "clown", "trash"], 2 if bad else rng.randint(0, 1)):
                words.insert(rng.randrange(len(words) + 1), insult)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    odd = [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("label", F.lit("clash")).repartition(3)
    given = spark.createDataFrame(labels + [(4, None), (None, 1), (5, 0), (5, 1)], f"doc_id long, {kind} int")
    return docs, given, dict(labels)


@pytest.mark.parametrize(("module", "kind", "modulus", "fold", "least"), [(quality, "quality", 4, 2, 0.95), (toxicity, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, module, kind, modulus, fold, least):
    docs, labels, known = labelled_docs(spark, kind)
    scored = module.score(docs, module.fit(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    tests = [r for r in scored if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % modulus == fold]
    right = [(r.score >= 0.5) == bool(known[r.doc_id]) for r in tests]
    assert len(tests) > 50 and sum(right) / len(right) >= least
    one_class = module.score(docs.limit(5), module.fit(docs, labels.where(f"{kind} = 1"))).collect()
    assert {r.score for r in one_class} == {1.0}
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).isEmpty()


def test_toxicity_learns_pairs_that_tell_nothing_one_by_one(spark):
    rng = random.Random(31)
    rows, labels = [], {}
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = sentence(rng, rng.randint(10, 60)).split()
        for there, word in ((insult, "moron"), (group, "tribes")):
            if there:
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels[i] = int(insult == group)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    tests = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(tests) > 400 and sum((r.score >= 0.5) == labels[r.doc_id] for r in tests) / len(tests) >= 0.95


def test_scores_equal_plain_forward_passes(spark):
    texts = [*ODD, "river moron tribes", "paper light house moron moron", " ".join(["alpha Beta, gamma!"] * 60)]
    hasher = common.Hasher()
    machine = toxicity.Factorization(np.unique(toxicity.terms(pa.array(texts[3:]), hasher)[1]))
    rng = np.random.default_rng(4)
    machine.base, machine.w, machine.v = 0.3, rng.normal(size=len(machine.w)).astype(np.float32) / 9, rng.normal(size=machine.v.shape).astype(np.float32) / 9
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, texts), machine).collect()}
    for i, text in enumerate(texts):
        own = sorted({int(np.searchsorted(machine.buckets, b)) for b in toxicity.terms(pa.array([text], pa.string()), hasher)[1]})
        out = machine.base + sum(float(machine.w[t]) for t in own)
        out += sum(float(machine.v[:, a].astype(float) @ machine.v[:, b].astype(float)) for k, a in enumerate(own) for b in own[:k])
        assert abs(got[i] - 1 / (1 + math.exp(-out))) < 1e-4
    net = quality.Attention(quality.encode(pa.array([""]), hasher)[0].shape[1])
    got = {r.doc_id: r.score for r in quality.score(docs_of(spark, texts), net).collect()}
    for i, text in enumerate(texts):
        x, bags = quality.encode(pa.array([text], pa.string()), hasher)
        assert len(x) == bags[0] == max(1, (len((text or "").split()) + 32) // 64)
        h = [np.tanh(row @ net.p["W"] + net.p["b"]) for row in x]
        e = [math.exp(float((np.tanh(k @ net.p["V"]) / (1 + np.exp(-(k @ net.p["U"])))) @ net.p["a"])) for k in h]
        z = sum(w * k for w, k in zip(e, h, strict=True)) / sum(e)
        assert abs(got[i] - 1 / (1 + math.exp(-float(z @ net.p["c"] + net.p["d"][0])))) < 1e-4


# --------------------------------------------------------------------- op 8


def test_jaccard_classes_equal_brute_force(spark):
    rng = random.Random(13)
    passage = sentence(rng, 60)
    texts = list(ODD)
    for _ in range(40):
        base = sentence(rng, rng.randint(4, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    common_base = sentence(rng, 80).split()
    for _ in range(40):
        copy = list(common_base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(80)] = f"w{rng.randint(0, 999)}"
        texts.append(" ".join(copy).upper())
    docs = docs_of(spark, texts, extra=True).union(docs_of(spark, texts, extra=True).limit(2))
    for n, num in ((4, 85), (5, 80)):
        rows = jaccard.jaccard_classes(docs, n, num, 100).collect()
        sets = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
            sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
        root = list(range(len(texts)))

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        assert len(rows) == len(texts) + 2
        for r in rows:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))
    assert jaccard.jaccard_classes(docs.limit(0)).isEmpty()


def test_jaccard_ids_with_several_texts_keep_the_links_of_each(spark):
    rng = random.Random(19)
    one, two, three, four, five = (sentence(rng, 80) for _ in range(5))
    near = lambda t: t + " more"
    rows = [(1, one), (5, one), (5, two), (7, near(two)), (8, near(one))]  # one text of 5 is a copy of 1's
    rows += [(2, three), (3, four), (9, three), (9, four), (10, near(four)), (11, five), (12, five)]  # both texts of 9 are copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.component_id) for r in jaccard.jaccard_classes(docs, 4, 85, 100).collect()}
    assert found == {(i, 1) for i in (1, 5, 7, 8)} | {(i, 2) for i in (2, 3, 9, 10)} | {(11, 11), (12, 11)}


def test_one_of_each_group_stays(spark):
    rng = random.Random(23)
    one, two, three = (sentence(rng, 60) for _ in range(3))
    rows = [(1, one), (1, one), (2, one + " more"), (3, two), (3, three), (3, two), (4, three), (5, None), (5, None), (None, one), (None, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == {(1, one): 1, (3, two): 1, (3, three): 1, (5, None): 1, (None, one): 1, (None, ""): 1}


def test_jaccard_bucket_of_unlike_members(spark):
    # thousands of texts that share one short passage and nothing else: one bucket at most, no class
    passage = "this very passage is in all of them"
    texts = [f"{passage} w{i} x{i} y{i} z{i}" for i in range(3000)] + [f"{passage} w{i} x{i} y{i} z{i}" for i in range(40)]
    rows = jaccard.jaccard_classes(docs_of(spark, texts), 4, 85, 100).collect()
    assert all(r.component_id == (r.doc_id if r.doc_id < 3000 else r.doc_id - 3000) for r in rows) and len(rows) == 3040


# -------------------------------------------------------------------- op 10


def test_shards(spark):
    texts = ODD + ["same"] * 300 + [f"text {i}" for i in range(500)]
    docs = docs_of(spark, texts, extra=True).union(spark.createDataFrame([(None, "a"), (None, "b"), (3, "word")], "doc_id long, text string").selectExpr("*", "1 n", "'x' score", "2 target"))
    rows = sharding.shuffle_to_shards(docs).collect()
    assert len(rows) == len(texts) + 3
    sizes = collections.Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for r in rows:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    assert rows and {r.law for r in rows} == {"rows"} and sorted(map(str, sharding.shuffle_to_shards(docs).collect())) == sorted(map(str, rows))
    assert sharding.shuffle_to_shards(docs.limit(0)).isEmpty()


def test_shards_and_slots_are_uniform(spark):
    # many blocks, many copies: over seeds every row is as often in every shard, and in either half of the slots
    docs = docs_of(spark, ["copy"] * 150 + [f"t{i}" for i in range(50)])
    in_shard, low = collections.Counter(), collections.Counter()
    for seed in range(60):
        rows = sharding.shuffle_to_shards(docs, shards=4, seed=seed, block_rows=2).collect()
        assert collections.Counter(r.shard for r in rows) == {k: 50 for k in range(4)}
        for r in rows:
            in_shard[r.doc_id % 20, r.shard] += 1
            low[r.doc_id % 20] += r.slot < 25
    # 600 draws a cell: 150 a shard, 300 in the lower half; five standard deviations
    assert all(abs(in_shard[i, k] - 150) < 54 for i in range(20) for k in range(4)) and all(abs(low[i] - 300) < 62 for i in range(20))


def test_the_matrix_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_BLOCKS", 70)
    rows = sharding.shuffle_to_shards(docs_of(spark, [f"t{i}" for i in range(400)]), block_rows=1).collect()
    assert sorted(collections.Counter(r.shard for r in rows).values()) == [50] * 8


def test_communication_matrix():
    blocks, shards = [50, 0, 7, 143], [67, 67, 66]
    drawn = [sharding.matrix(blocks, shards, seed) for seed in range(400)]
    for m in drawn:
        assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m, strict=True)] == shards
    first = np.array([m[0][0] for m in drawn])
    spread = 50 * (67 / 200) * (133 / 200) * (150 / 199)
    assert abs(first.mean() - 50 * 67 / 200) < 4 * math.sqrt(spread / 400) and 0.75 < first.var() / spread < 1.3


# ----------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, sentence(rng, 60)) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(210 + i, " ".join(w.upper() + "!!" for w in sentence(rng, 60).split())) for i in range(60)] + [(270 + i, sentence(rng, 30) + " moron scum clown") for i in range(60)]
    leak = sentence(rng, 25)
    rows += [(330, sentence(rng, 20) + " " + leak), (331, None), (332, "")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 210 <= i < 270), int(270 <= i < 330)) for i, _ in rows[:330]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(200)) <= kept | {331, 332} and not kept & set(range(200, 331))


def test_helpers_read_sliced_batches():
    column = pa.array([None, "ab", "", "cde", "f"])
    data, offsets = common.utf8(column.slice(1, 3))
    assert bytes(data) == b"abcde" and offsets.tolist() == [0, 2, 2, 5]
