import re

import pytest
from conftest import SF_CHECK
from corpus import LONG, ROWS, components, nothing, odd  # noqa: F401
from stagewatch.llm import near_dup
from stagewatch.llm.components import connected_components
from stagewatch.sources.tables import read_table


def _set(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(_set(t)))
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if any(x & y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])]
    return components(ids, links)


def _check(df, rows):
    want = _brute(rows)
    got = near_dup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(
        ((i, len(_set(t)), want.get(i), i == want.get(i)) for i, t in rows), key=repr)


def test_awkward_rows(odd):
    _check(odd, ROWS)


def test_sample_table(spark):
    df = read_table(spark, SF_CHECK, "documents")
    _check(df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_one_id_with_several_texts_joins_their_classes(spark):
    rows = [(5, "a b c d e f g"), (1, "a b c d e f g"), (5, "q w e r t y u"), (7, "q w e r t y u"), (9, "z")]
    _check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_crowded_family_meets_its_original(spark):
    """Copies of one text with edits of their own: more than a leaf holds, linked by the original."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1000, " ".join(base))]
    for c in range(150):
        w = list(base)
        for e in range(3 + c % 8):
            w[(c * 53 + e * 41) % 400] = f"edit{c}x{e}"
        rows.append((c, " ".join(w)))
    _check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_crowd_without_a_hub_keeps_its_links(spark):
    """Pairs of near copies in a crowd of texts that resemble one another too little to be linked."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for c in range(160):
        w = list(base)
        for e in range(4):
            w[(c * 37 + e * 51) % 300] = f"own{c}x{e}"
        rows.append((2 * c, " ".join(w)))
        for e in range(4):
            w[(c * 37 + e * 73 + 20) % 300] = f"twin{c}x{e}"
        rows.append((2 * c + 1, " ".join(w)))
    _check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def _crowd(spark, texts, regions=None):
    """The frames that the completion takes, all texts in one crowded region and apart."""
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    nodes = near_dup.signatures(docs).selectExpr("doc_id as node", "fp1", "n_shingles")
    crowded = spark.createDataFrame(regions or [(i, 7) for i in {i for i, _ in texts}], "node long, region long")
    return docs, nodes, crowded


def _pairs_of(texts, percent):
    sets = {}
    for i, t in texts:
        sets.setdefault(i, set()).add(frozenset(_set(t)))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])}


@pytest.mark.parametrize("percent", [80, 85])
def test_completion_loses_no_link(spark, percent):
    """Texts at all similarities around the threshold, a doc_id of two texts, some already joined."""
    base = [f"w{i}" for i in range(200)]
    texts = [(1, " ".join(base)), (61, "a b c d e f"), (61, "g h i j k l"), (62, "g h i j k l m"), (63, "a b c d e f g")]
    for c in range(2, 60):
        w = list(base)
        for e in range(c % 12):
            w[(c * 37 + e * 17) % 200] = f"own{c}x{e}"
        texts.append((c, " ".join(w)))
    docs, nodes, crowded = _crowd(spark, texts)
    found = spark.createDataFrame([(1, 1), (5, 1), (13, 1), (20, 20), (21, 20)], "node long, component long")
    part = lambda i: {5: 1, 13: 1, 21: 20}.get(i, i)
    got = {tuple(r) for r in near_dup.links_across(crowded, found, nodes, docs, 5, percent).collect()}
    want = {(a, b) for a, b in _pairs_of(texts, percent) if part(a) != part(b)}
    assert want and want <= got and all(part(a) != part(b) for a, b in got)
    assert len(got) < 59 * 58 / 2 and len(want) < len(got) * 3


def test_completion_of_regions_apart(spark):
    """No pairs where every region is one component; none in an empty table."""
    texts = [(i, " ".join(f"w{j}" for j in range(100)) + f" tail{i}") for i in range(20)]
    docs, nodes, crowded = _crowd(spark, texts)
    one = spark.createDataFrame([(i, 0) for i in range(20)], "node long, component long")
    none = spark.createDataFrame([], "node long, component long")
    assert near_dup.links_across(crowded, one, nodes, docs).collect() == []
    assert near_dup.links_across(crowded.limit(0), none, nodes, docs).collect() == []
    assert {tuple(r) for r in near_dup.links_across(crowded, none, nodes, docs).collect()} == _pairs_of(texts, 85)


def test_completion_in_blocks(spark, monkeypatch):
    """Holders of one shingle in several blocks meet all the same."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    texts = [(i, " ".join(f"w{j}" for j in range(60)) + f" tail{i}") for i in range(60)]
    docs, nodes, crowded = _crowd(spark, texts)
    found = spark.createDataFrame([(i, 0 if i < 50 else 50 + i % 2) for i in range(60)], "node long, component long")
    got = {tuple(r) for r in near_dup.links_across(crowded, found, nodes, docs).collect()}
    part = lambda i: 0 if i < 50 else 50 + i % 2
    assert got == {(a, b) for b in range(60) for a in range(b) if part(a) != part(b)}


@pytest.mark.parametrize("copies", [False, True])
def test_completion_grows_with_the_crowd(spark, copies):
    """Texts of one template, at 0.72 with one another, each second one with a near copy: candidates in
    proportion to the texts, not to their pairs."""

    def texts(n):
        out = []
        for c in range(n):
            w = [f"w{i}" for i in range(300)]
            for e in range(10):
                w[(c // 2 * 31 + e * 29) % 300] = f"own{c // 2 if copies else c}x{e}"
            if copies and c % 2:
                w[(c * 7) % 300] = f"twin{c}"
            out.append((c, " ".join(w)))
        return out

    none = spark.createDataFrame([], "node long, component long")
    counts = {}
    for n in (60, 240):
        docs, nodes, crowded = _crowd(spark, texts(n))
        counts[n] = near_dup.links_across(crowded, none, nodes, docs).count()
    assert counts[240] <= 240 and counts[240] <= 5 * max(counts[60], 1)
    assert not copies or counts[240] >= 120


def test_pairs_that_part_below_a_crowded_entry_are_crowded(spark):
    """Nodes that share one crowded region where regions are entered, and nothing deeper."""
    n, levels = 3 * near_dup.LEAF, len(near_dup.LEVELS)
    rows = [(i, [7 if k == 0 else 1000 * (i + 1) + k for k in range(near_dup.TREES * levels)]) for i in range(n)]
    pairs, crowded = near_dup.candidate_links(spark.createDataFrame(rows, "node long, keys array<long>"))
    assert {tuple(r) for r in crowded.collect()} == {(i, 7) for i in range(n)}


def test_stage_keeps_one_of_each_group(odd):
    out = near_dup.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 9, 10, 11, 12, 14]
    assert ids.count(None) == 2
    assert LONG in {r["text"] for r in out.where("doc_id = 4").collect()}


def test_the_pipeline_links_from_080_on(spark):
    """22 of 26 shingles shared: 0.846, a link of the stage but none of op10."""
    import corpus_pipeline as P

    w = [f"w{i}" for i in range(29)]
    rows = [(2 * k, " ".join(f"{k}{x}" for x in w)) for k in range(20)]
    rows += [(2 * k + 1, " ".join([*[f"{k}{x}" for x in w[:26]], "other"])) for k in range(20)]
    x, y = _set(rows[0][1]), _set(rows[20][1])
    assert 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in P.near_dedup_stage(spark, df, SF_CHECK).collect()) == list(range(0, 40, 2))
    assert near_dup.near_duplicates(df).where("kept").count() == 40


def test_empty(nothing):
    assert near_dup.near_duplicates(nothing).collect() == []
    assert near_dup.drop_near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(3, 2), (2, 1), (None, 4)], [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
