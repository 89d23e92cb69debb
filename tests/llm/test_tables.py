import re

import numpy as np
import pytest
from compare import compare, duck
from conftest import SF_CHECK, SF_SMALL
from corpus import ROWS, docs, nothing, odd  # noqa: F401
from stagewatch.llm import ann, quality, queries, topk, url_filter, vectors
from stagewatch.sources.tables import read_table

INF, NAN = float("inf"), float("nan")


def _vectors(spark, n=700, d=16, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    v[100:160] = v[100]                       # ties
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    rows += [(50, v[50].tolist()), (None, v[1].tolist()), (2000, None), (2001, []), (2002, [0.0] * d), (2003, [NAN] * d), (2004, [INF] * d),
             (2005, [None] * d), (2050, [1.0, 2.0]), (2051, [1.0, 2.5]), (2100, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as v", "1 as rank", "0 as score")
    return rows, df


def _brute(rows, score, every=50, k=5, zero_ok=True):
    live = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(v))]
    out = []
    for q, x in {i: v for i, v in sorted(live, key=lambda r: (r[0], r[1].tolist()), reverse=True) if i % every == 0}.items():
        best = sorted((-score(x, y), i) for i, y in live if i != q and len(x) == len(y))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 150)
    monkeypatch.setattr(vectors, "QUERIES", 4)


def test_vectors_of_any_size_have_neighbours(spark):
    rng = np.random.default_rng(3)
    near = rng.standard_normal((40, 8))
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<double>")
    sizes = (1e-200, 1e-300, 1e200, 1.7e307)
    odd = [(i, (v / abs(v).max() * sizes[i % 4]).tolist()) for i, v in enumerate(near)]
    want = ann.nearest_neighbours(plain, every=8).collect()
    got = ann.nearest_neighbours(spark.createDataFrame(odd, plain.schema), every=8).collect()
    assert len(got) == 25
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in want)
    assert np.allclose([r["score"] for r in sorted(got)], [r["score"] for r in sorted(want)], atol=1e-9)


def test_products(spark, small_blocks):
    rows, df = _vectors(spark)
    whole = lambda x, y: int(np.floor(256 * x) @ np.floor(256 * y))
    got = sorted(tuple(r) for r in topk.top_products(df).collect())
    assert got == _brute(rows, whole)
    assert topk.top_products(df.where("false")).collect() == []


def test_products_beyond_doubles(spark):
    rows = [(i, [float(3 + i) * 1e5, -float(i) * 1e5 + 1]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = lambda x, y: sum(int(a) * int(b) for a, b in zip(np.floor(256 * x), np.floor(256 * y)))
    assert sorted(tuple(r) for r in topk.top_products(df).collect()) == _brute(rows, exact)


def test_products_oracle(spark):
    ok, msg = compare(queries.op9_top_products(spark, SF_CHECK), duck(SF_CHECK), queries.ORACLE["op9_top_products"])
    assert ok, msg


def test_the_threshold_algorithm_stops_early():
    rng = np.random.default_rng(0)
    y = np.floor(256 * rng.standard_normal((4000, 3)))
    order = np.ascontiguousarray(np.argsort(y, axis=0, kind="stable").T)
    scored = []

    class Counting(np.ndarray):
        def __getitem__(self, item):
            out = np.asarray(self)[item]
            scored.append(len(out) if out.ndim == 2 else 0)
            return out

    q = y[7]
    rows, scores = topk._top(q, np.array([7]), y.view(Counting), order, np.take_along_axis(y.T, order, axis=1),
                             float(np.sqrt((y * y).sum(axis=1).max())), 5)
    want = y @ q
    want[7] = -np.inf
    assert scores.tolist() == np.sort(want)[::-1][:5].tolist()
    assert sum(scored) < 1500


def _recall(got, want):
    g = {(q, i) for q, _, i, _ in got}
    return len(g & {(q, i) for q, _, i, _ in want}) / len(want)


def test_neighbours(spark, small_blocks):
    rows, df = _vectors(spark)
    cosine = lambda x, y: float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))
    got, want = [tuple(r) for r in ann.nearest_neighbours(df).collect()], _brute(rows, cosine, zero_ok=False)
    assert _recall(got, want) >= 0.95
    assert len(got) == len(want)
    vec = {i: np.array(v, float) for i, v in rows if v and None not in v}
    assert all(abs(s - cosine(vec[q], vec[i])) < 1e-12 for q, _, i, s in got)
    tied = [i for q, _, i, _ in sorted(got) if q == 100]
    assert tied == [101, 102, 103, 104, 105]
    assert ann.nearest_neighbours(df.where("false")).collect() == []


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK, "/root/testdata/sf0.1"])
def test_recall_on_the_tables(spark, sf):
    table = read_table(spark, sf, "embeddings")
    got = [tuple(r) for r in ann.nearest_neighbours(table).collect()]
    r = table.select("vec_id", "embedding").collect()
    ids, v = np.array([x[0] for x in r]), np.array([x[1] for x in r], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[ids == ids[i]] = -2
        want += [(ids[i], 0, ids[j], 0) for j in np.lexsort((ids, -s))[:5]]
    assert _recall(got, want) >= 0.95


# --- Quality -----------------------------------------------------------------------------

def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    scores, lengths, tr = rng.standard_normal((3, 4, 2)), np.array([4, 1, 3]), rng.standard_normal((2, 2))
    m, pairs, z = quality.forward_backward(scores, lengths, tr)
    expected = np.zeros((2, 2))
    for c, n in enumerate(lengths):
        total, good, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(scores[c, t, y[t]] for t in range(n)) + sum(tr[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
            for a, b in zip(y, y[1:]):
                seen[a, b] += p
        assert np.isclose(np.log(total), z[c]) and np.allclose(m[c, :n, 1], good / total)
        expected += seen / total
    assert np.allclose(pairs, expected)


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(read_table(spark, SF_CHECK, "documents"), read_table(spark, SF_CHECK, "labels"))


def test_held_out_accuracy(spark, model):
    import zlib

    r = quality.quality_scores(read_table(spark, SF_CHECK, "documents"), model).join(read_table(spark, SF_CHECK, "labels"), "doc_id").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)
    out = [x for x in r if x["held_out"]]
    assert len(out) > 30 and np.mean([x["predicted"] == x["quality"] for x in out]) >= 0.95
    assert all(x["predicted"] == (x["score"] >= 0.3) and 0 <= x["score"] <= 1 for x in r)


def test_odd_texts_are_scored_and_kept_whole(odd, nothing, model):
    got = quality.quality_scores(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    good = sorted((r["doc_id"] for r in got if r["predicted"] == 1), key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == good
    assert quality.quality_scores(nothing, model).collect() == [] and quality.keep_good(nothing, model).collect() == []


def test_training_without_labels_or_with_one_only(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.train(odd, none)
    assert {round(r["score"], 9) for r in quality.quality_scores(odd, m).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(1, 15)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.quality_scores(odd, quality.train(odd, one)).collect())


# --- Urls --------------------------------------------------------------------------------

def _judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


CANONICAL = '<head><link href="{}" rel="canonical"></head>'
PAGES = [
    (1, "http://a.example.net/de/1", None), (2, "https://b.example.org/x", CANONICAL.format("http://a.example.net/de/1")),
    (3, "http://c.example.org/y", "<META content='0; URL=https://b.example.org/x?utm_source=q#z' http-equiv='refresh'>"),
    (4, "http://d.example.org/z/page", CANONICAL.format("../other") + "x"), (5, "http://e.example.org/", CANONICAL.format("//www.c.example.org/y/")),
    (6, "http://f.example.com/en/1", CANONICAL.format("http://g.example.net/en/1")), (7, "http://h.example.org/k", CANONICAL.format("http://f.example.com/en/1")),
    (8, "http://i.example.org/k", CANONICAL.format("http://f.example.com/de/9")), (9, None, None), (10, "no url", "x"), (11, "://", ""), (12, "http://x.net", None),
    (13, "HTTP://A.EXAMPLE.NET/de/1#top", ""), (14, "https://a.example.net:443/de/1/?ref=x", ""), (14, "https://B.example.org/x", ""),
    (None, "http://net/", ""), (15, "ftp://fr.org/fr/1", ""), (16, "http://notnet/", ""), (17, "http://q.example.org/a?u=http://x.net/", CANONICAL.format("")),
    (20, "http://two.example.org/1", '<link rel="canonical"><link rel="canonical" href="http://spam.net/x">'),
    (21, "http://two.example.org/2", CANONICAL.format("/own") + "<meta http-equiv=refresh content='3'><meta http-equiv=refresh content='0;url=http://spam.net/y'>"),
    (18, "http://r.example.org/p\nq", CANONICAL.format("/s")), (19, "http://r.example.org/s", CANONICAL.format("http://only.target.net/t")),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as verdict", "1 as address")
    got = url_filter.judge_pages(df).collect()
    assert len(got) == len(PAGES)
    alias = {2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 14: "block", 11: "allow", 12: "allow",
             16: "allow", 17: "allow", 18: "block", 19: "block", 20: "block", 21: "block"}
    want = []
    for i, u, _ in PAGES:
        h, p, rule, own = _judge(u)
        want.append((i, h, p, rule, own or alias[i]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert url_filter.judge_pages(df.where("false")).collect() == []


def test_given_redirects(spark):
    df = spark.createDataFrame([(1, "http://a.example.org/1", ""), (2, "http://b.example.org/2", "")], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://a.example.org/1", "http://t.net/x"), (None, "http://t.net/x"), ("junk", None)], "from_url string, to_url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(df, redirects=moved).collect()} == {1: "block", 2: "allow"}


def _address(url):
    m = re.fullmatch(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?", url or "")
    if not m:
        return None
    host = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", re.sub("[A-Z]", lambda c: c.group().lower(), m[1])))
    kept = [x for x in (m[3] or "").split("&") if not re.match("(?i)(utm_[a-z]+|ref|fbclid|gclid)=", x)]
    return host + m[2].rstrip("/") + ("?" + "&".join(kept) if any(kept) else "")


def _all_links(url, html):
    """Targets of every canonical link and refresh of a page, by walking its tags."""
    for tag in re.findall(r"(?s)<[a-zA-Z][^>]*>", html or ""):
        low = tag.lower()
        if low.startswith("<link") and re.search(r"\brel\s*=\s*[\"']?canonical\b", low):
            to = re.search(r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", tag)
        elif low.startswith("<meta") and re.search(r"\bhttp-equiv\s*=\s*[\"']?refresh\b", low):
            to = re.search(r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", tag)
        else:
            continue
        if to and "://" in (url or ""):
            scheme, rest = url.split("://", 1)
            root = scheme + "://" + re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
            to = to[1]
            yield to if "://" in to else scheme + ":" + to if to.startswith("//") else root + to if to.startswith("/") else \
                root + (path[:path.rfind("/") + 1] or "/") + to


def _brute_verdicts(pages):
    """Every page's verdict by a plain search over all links."""
    near, said = {}, {}
    for _, url, html in pages:
        for to in [None, *_all_links(url, html)]:
            for u in (url, to):
                own, at = _judge(u)[3] if u else None, _address(u)
                if own and at is not None:
                    said.setdefault(at, set()).add(own)
            if to and _address(url) is not None and _address(to) is not None:
                near.setdefault(_address(url), set()).add(_address(to))
                near.setdefault(_address(to), set()).add(_address(url))
    out = []
    for i, url, _ in pages:
        host, path, rule, own = _judge(url)
        seen, todo = set(), [_address(url)]
        while todo:
            at = todo.pop()
            if at is not None and at not in seen:
                seen.add(at)
                todo += near.get(at, ())
        told = set().union(*[said.get(a, set()) for a in seen]) if seen else set()
        out.append((i, host, path, rule, own or ("block" if told == {"block"} else "allow")))
    return sorted(out, key=repr)


def test_urls_by_brute_force(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert sorted(map(tuple, url_filter.judge_pages(df).collect()), key=repr) == _brute_verdicts(PAGES)


def test_url_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF_CHECK, "pages").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op7_url_filter(spark, SF_CHECK).collect()), key=repr) == _brute_verdicts(rows)


# --- The pipeline ------------------------------------------------------------------------

def test_pipeline(spark, odd):
    import corpus_pipeline as P

    table = read_table(spark, SF_CHECK, "documents")
    now = table
    sizes = []
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF_CHECK)
        assert now.columns == table.columns
        now = now.cache()
        sizes.append(now.count())
    assert table.count() > sizes[0] > sizes[1] == sizes[2] > 500
    out = P.run(spark, SF_CHECK)
    assert out.select("doc_id").distinct().count() == sizes[2]
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024
    assert docs(spark, []).columns == P.near_dedup_stage(spark, docs(spark, []), SF_CHECK).columns


@pytest.mark.parametrize("n", [1, 2, 50])
def test_line_scores_are_those_with_neighbours(n):
    rng = np.random.default_rng(n)
    x = rng.random((n, quality._FEATURES))
    w = rng.standard_normal(3 * quality._FEATURES + 1)
    assert np.allclose(quality.line_scores(x, w), quality.with_neighbours(x) @ w)


def test_scores_do_not_hang_on_how_lines_are_grouped(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = quality.Model(rng.standard_normal(3 * quality._FEATURES + 1), rng.standard_normal((2, 2)), 1.0, 0.1)
    texts = pa.array(["a b.\nc", None, "", "x\n" * 300, "One line."] * 3)
    whole = quality._scores(texts, model)
    monkeypatch.setattr(quality, "LINES", 3)
    assert np.allclose(quality._scores(texts, model), whole) and len(whole) == 15
