"""Merkle manifest, whitening and page texts against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text, merkle, queries, whitening

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# --- Merkle manifest ---------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, pos long"


def manifest_rows():
    rng = random.Random(5)
    rows = [(i, "s", rng.choice(["en", "en", "de", None, ""]), len(str(i)), f"text {i} é") for i in range(150)]
    rows += [(7, "t", "en", None, None), (7, "t", "en", None, None), (7, None, "en", 3, ""), (None, "s", "en", 1, "a")]
    rows += [(14, "s", "fr", None, "null count"), (28, "s", "zh", 2**63 - 1, "x" * 1_200_000)]
    rng.shuffle(rows)
    return rows


def plain_manifest(rows):
    def tampered(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 0

    def leaf(i, source, lang, n, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    def climb(nodes):
        ways = [[] for _ in nodes]
        under, level = [[i] for i in range(len(nodes))], list(nodes)
        while len(level) > 1:
            for p in range(0, len(level), 2):
                pair = level[p : p + 2]
                for side in range(len(pair)):
                    for i in under[p + side]:
                        ways[i].append(("L" if side else "R", pair[1 - side]) if len(pair) == 2 else None)
            level, under = [H(*level[p : p + 2]) for p in range(0, len(level), 2)], [
                sum(under[p : p + 2], []) for p in range(0, len(under), 2)
            ]
        return level[0], ways

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in order}
    climbed = {g: climb([leaf(*r) for r in trees[g]]) for g in order}
    root, tops = climb([climbed[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for r, way in zip(trees[g], climbed[g][1]):
            i, source, lang, n, text = r
            at = leaf(i, source, lang, None if n is None else n + 1, text) if tampered(i) else leaf(*r)
            for step in way + top:
                at = H(at) if step is None else H(step[1], at) if step[0] == "L" else H(at, step[1])
            proof = H(*[step[1] for step in way + top if step])
            out.append((i, leaf(*r), climbed[g][0], root, proof, at, at == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_equals_a_plain_tree(spark, rows, bits):
    data = manifest_rows()
    docs = spark.createDataFrame([(*r, "own", "own", 1) for r in data], DOCS).repartition(3)
    assert rows(merkle.merkle_manifest(docs, bits=bits)) == plain_manifest(data)


def test_versions_share_all_nodes_but_one_path(spark):
    data = [(i, "s", "en", 1, str(i)) for i in range(20)]
    docs = spark.createDataFrame([(*r, "", "", 0) for r in data], DOCS)
    got = merkle.merkle_manifest(docs, F.col("doc_id") == 5, bits=2, with_versions=True).collect()
    assert [r.doc_id for r in got if r.copied] == [5] == [r.doc_id for r in got if not r.verified]
    version = next(r for r in got if r.copied)
    # 20 leaves: five levels of nodes and the tree of the one language.
    assert len(version.copied) == 6 and version.copied[-1] == version.folded_root != version.root


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []
    (row,) = merkle.merkle_manifest(spark.createDataFrame([(None,) * 8], DOCS)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == H("-----") and row.proof_sha256 == H() and row.verified


def test_manifest_query_has_sql():
    assert "op12_merkle_manifest" in queries.ORACLES


# --- whitening ---------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id string, v int, ids string"


def vectors(spark, values):
    return spark.createDataFrame([(i, v, "own", 1, None) for i, v in enumerate(values)], VECTORS).repartition(3)


def plain_whitening(values, count=32):
    x = np.floor(64 * np.array(values, np.float32).astype(float)) + 1_000_000
    centred = x - x.mean(axis=0)
    u, s, right = np.linalg.svd(centred / np.sqrt(len(x)), full_matrices=False)
    n, sums = len(x), x.astype(int).sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x]
    real = s[:count] > 1e-12 * s[0]
    return centred @ right[:count][real].T / s[:count][real], (s**2 / (s**2).sum())[:count][real], deviation


def compare(got, want, ids):
    y, explained, deviation = want
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(table) == len(ids) * len(explained)
    ours = np.array([[table[i, c + 1].whitened for c in range(len(explained))] for i in ids])
    assert np.allclose([table[ids[0], c + 1].explained for c in range(len(explained))], explained, rtol=1e-9)
    assert [table[i, 1].deviation for i in ids] == deviation
    assert max(r.identity_error for r in got) < 1e-9
    # Same up to one sign per component, and up to a rotation where variances are equal.
    assert np.allclose(ours @ ours.T, y @ y.T, atol=1e-6)
    return ours


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((400, 12)) * np.geomspace(30, 0.2, 12)).astype(np.float32).tolist()
    data += [data[0]] * 50
    bad = [None, [], [1.0] * 11, [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11, [1e30] + [0.0] * 11]
    model = whitening.fit_whitening(vectors(spark, data + bad), count=5)
    got = whitening.whiten(model).collect()
    want = plain_whitening(data, 5)
    ours = compare(got, want, list(range(len(data))))
    assert np.allclose(np.abs(ours), np.abs(want[0]), atol=1e-8)
    assert {r.n for r in got} == {450}


def test_whitening_of_equal_variances_and_of_flat_directions(spark):
    # Every direction of the first three has the same variance, the fourth follows the first, the fifth is constant.
    axes = [[s * 4.0 if j == i else 0.0 for j in range(3)] for i in range(3) for s in (1, -1)]
    data = [a + [a[0], 0.5] for a in axes]
    got = whitening.whiten(whitening.fit_whitening(vectors(spark, data))).collect()
    compare(got, plain_whitening(data), list(range(6)))
    assert max(r.component for r in got) == 3


def test_whitening_of_nothing_of_one_and_of_copies(spark):
    for data in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 9):
        out = whitening.whiten(whitening.fit_whitening(vectors(spark, data)))
        assert out.collect() == [] and out.columns[:3] == ["vec_id", "component", "n"]


def test_deviation_is_exact_or_null():
    x = np.array([[2**40, 0], [0, 0]])
    sums = [2**40, 0]
    assert whitening._deviations(x, 2, sums).to_pylist() == [None, None]
    assert whitening._deviations(np.array([[2**30, 0], [0, 0]]), 2, [2**30, 0]).to_pylist() == [2**60, 2**60]


# --- pages -------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, key string, runs int"


def texts(spark, data):
    frame = spark.createDataFrame([(i, u, h, "own", None, 1) for i, (u, h) in enumerate(data)], PAGES)
    out = html_text.main_texts(frame.repartition(3))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert all(r.n_chars == len(r.text) and r.url == data[i][0] for i, r in got.items())
    return [got[i].text for i in range(len(data))]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_marked_article_stays_whole(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script></head><body class="with-sidebar">'
        "<header>Site</header><nav><ul><li>Menu<li>Other</ul></nav><div class='ad'>Buy</div><div class='page with-sidebar'>"
        '<article><header class="entry-header"><h1>A &lt;b&gt; &amp c &eacute;</h1></header><p><b>One\n two<br>three<p>Four&nbsp;five'
        '<div class="share-buttons">Share</div><aside>More</aside><form>Mail <button>Go</button></form><style>p{}</style>'
        "<table><tr><td>x</td><td>y</td></tr></table><!-- no --><footer>By me</footer></article></div>"
        '<section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; me</footer>'
    )
    want = "A <b> & c é\n\nOne two three\n\nFour five\n\nx y"
    # Copies of a page keep its text as well.
    assert texts(spark, [("http://h/1", page), ("http://h/2", page), ("http://h/2", page)]) == [want] * 3


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    rng = random.Random(2)
    frame = [words(rng, 30), words(rng, 6), words(rng, 60)]
    own = [[words(rng, 25), words(rng, 4)] for _ in range(12)]
    page = lambda body: "".join(f"<div>{b}</div>" for b in [frame[0], *body, frame[1], frame[2]])
    data = [(f"https://u@One.example:80/{i}?x", page(b)) for i, b in enumerate(own)]
    alone = [("https://two.example/1", page(own[0])), (None, page(own[1])), ("no url", page(own[2]) + "<p>more</p>")]
    got = texts(spark, data + alone)
    assert got[:12] == ["\n\n".join(b) for b in own]
    # A host with one page repeats nothing; pages without a host share one.
    assert got[12] == "\n\n".join([frame[0], *own[0], *frame[1:]])
    assert got[13:] == ["\n\n".join(own[1]), "\n\n".join(own[2] + ["more"])]


def test_page_cases(spark):
    long = "word " * 250_000
    data = [
        ("http://a/1", None),
        ("http://a/2", ""),
        ("http://a/3", "<nav>only</nav>"),
        ("http://a/4", "plain < text & more &#x41;"),
        ("http://a/5", f"<main><p>{long}</p></main>"),
        ("http://a/6", "<article>open <b>end"),
        ("http://a/7", "<script>never closed <p>text</p>"),
        ("http://a/8", "<head><title>x</title><body><p>after an open head</p>"),
    ]
    assert texts(spark, data) == [
        "", "", "", "plain < text & more A", long.strip(), "open end", "", "after an open head",
    ]
    assert html_text.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_near_copies_without_markup_keep_their_prose(spark):
    rng = random.Random(4)
    body = [words(rng, 40) for _ in range(3)]
    pages = [("http://b/1", "".join(f"<p>{b}</p>" for b in body)), ("http://b/2", "".join(f"<p>{b}</p>" for b in body + [body[0]]))]
    assert texts(spark, pages) == ["\n\n".join(body), "\n\n".join(body + [body[0]])]


def test_repeated_runs_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [words(rng, 8) for _ in range(12)]
    rows = []
    for page in range(30):
        for at in range(12):
            text = rng.choice(pool)[: rng.randint(20, 40)] + rng.choice(["", "!", words(rng, 3)])
            rows.append((rng.choice(["x", "y"]), (text + words(rng, 4))[:64], page, at))
    got = {(r.host, r.suffix): r.run for r in html_text.repeated_runs(
        spark.createDataFrame(rows, "host string, suffix string, page long, at int").repartition(5)
    ).collect()}
    want = {}
    for h, s, p, _ in rows:
        run = max((html_text.shared_prefix(s, t) for g, t, q, _ in rows if g == h and q != p), default=0)
        if run >= html_text.MIN_RUN:
            want[h, s] = max(run, want.get((h, s), 0))
    assert got == want and len(want) > 50


def test_suffixes_start_at_every_word_of_a_long_block():
    from ledgerloom.llm import html_text

    text = " ".join(f"word{i}" for i in range(40))
    spans = [(0, 0, len(text))]
    assert list(html_text.anchors(text, spans)) == [i for i in range(len(text)) if i == 0 or text[i - 1] == " "]


def test_article_words_are_compared_with_what_other_pages_show_around_theirs(spark):
    rng = random.Random(5)
    line, passage, title = words(rng, 12), words(rng, 30), words(rng, 8)
    own = [words(rng, 20) for _ in range(6)]
    article = lambda *blocks: "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    data = [
        ("http://c/1", f"<div>{line}</div><p>{title}</p>" + article(own[0], passage)),
        ("http://c/2", article(own[1], line, passage)),  # around the first page's article, and inside the third's
        ("http://c/3", article("so: " + line + " end", own[2])),  # found at a word inside a block
        ("http://c/4", f"<div>{line}</div>" + article(own[3], line)),  # its own page has it around the article
        ("http://d/1", article(own[4], line)),  # another host
        ("http://c/5", article(line)),  # would lose all
        ("http://c/6", article(title, own[5])),  # its headline stands around the first page's article only
        ("http://c/7", f"<p>{passage}</p><p>{title}</p><p>own words of this one page</p>"),  # no article
    ]
    # A passage that articles share is content there, and repeated on a page without an article.
    assert texts(spark, data) == [
        f"{own[0]}\n\n{passage}", f"{own[1]}\n\n{passage}", own[2], f"{own[3]}\n\n{line}", f"{own[4]}\n\n{line}", line,
        f"{title}\n\n{own[5]}", "own words of this one page",
    ]


def test_filter_of_beginnings_misses_none(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y"]), words(rng, 8)[:40], 1, 0) for _ in range(3000)]
    bits = html_text.beginnings_filter(spark.createDataFrame(rows, "host string, suffix string, page long, at int").repartition(4))
    for host in ("x", "y"):
        own = "".join(s[: html_text.MIN_RUN] for h, s, _, _ in rows if h == host)
        other = words(rng, 6000)
        for text, least, most in ((own, 1, 1), (other, 0, 0.02)):
            places = list(range(0, len(text) - html_text.MIN_RUN + 1, html_text.MIN_RUN))
            hashes = html_text.beginning_hashes(text, places, html_text._host_hash(host))
            hit = np.all([bits[p >> 3] >> (p & 7) & 1 for p in html_text.filter_places(hashes, 8 * len(bits))], axis=0)
            assert least <= hit.mean() <= most
