import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from conftest import SF_CHECK
from corpus import ROWS, docs, nothing, odd  # noqa: F401
from stagewatch.llm import licenses, packing, pii, sentencepieces, token_counts
from stagewatch.sources.tables import read_table


def _rows(spark):
    return [(r["doc_id"], r["text"]) for r in read_table(spark, SF_CHECK, "documents").select("doc_id", "text").collect()]


# --- SentencePiece -----------------------------------------------------------------------

def _model(kind=2, fallback=True):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(open(sentencepieces.model_path(), "rb").read())
    m.trainer_spec.model_type = kind
    if not fallback:
        m.trainer_spec.byte_fallback = False
        for p in m.pieces:
            if p.type == 6:
                p.type = 3
    return m.SerializeToString()


@pytest.mark.parametrize("fallback", [True, False], ids=["bytes", "unknown"])
def test_pieces_equal_the_library(spark, fallback):
    from sentencepiece import SentencePieceProcessor

    model = _model(2, fallback)
    pieces, library = sentencepieces.Pieces(model), SentencePieceProcessor(model_proto=model)
    texts = [t or "" for _, t in _rows(spark)[:300] + ROWS if "\0" not in (t or "")]
    texts += ["  two  spaces ", "aaaaaaaaaaaaaaa", "日本語 text 日本", "\n\n\t", "naïve café", "1234567 89", "===", "x" * 300]
    got = pieces.encode(texts)
    assert got == [library.encode(t) for t in texts]
    assert [pieces.decode(x) for x in got] == [library.decode(x) for x in got]


def test_unigram_pieces_have_the_best_score(spark):
    pieces = sentencepieces.Pieces(_model(1))
    words = {"▁" + w for _, t in _rows(spark)[:40] for w in (t or "").split() if len(w) < 30 and "▁" not in w} | {"▁日本é", "aaaa"}
    pieces._learn(words)
    for w in words:
        best = [0.0]
        for end in range(1, len(w) + 1):
            single = pieces.score[pieces.normal[w[end - 1]]] if w[end - 1] in pieces.normal else pieces.unknown_score
            best.append(max([best[end - 1] + single, *[best[a] + pieces.score[pieces.normal[w[a:end]]] for a in range(end) if w[a:end] in pieces.normal]]))
        own = pieces.flat[slice(*pieces.begin[pieces.words[w]:][:2])].tolist()
        if all(c in pieces.normal for c in w):
            assert sum(pieces.score[i] for i in own) == best[-1]
        assert pieces.decode(own) == w.replace("▁", " ").removeprefix(" ")


def test_pair_test_equals_merging():
    pieces = sentencepieces.Pieces(_model(2))
    rng = np.random.default_rng(7)
    ids = np.array(sorted(pieces.normal.values()))
    # pairs at random, and the two parts of every cut of a piece and of two pieces
    some = [pieces.text[i] for i in rng.choice(ids, 400)]
    cuts = [(t[:k], t[k:]) for t in some + [a + b for a, b in zip(some, some[::-1])] for k in range(1, len(t))]
    pairs = [(pieces.normal[a], pieces.normal[b]) for a, b in cuts if a in pieces.normal and b in pieces.normal]
    pairs += list(zip(rng.choice(ids, 3000).tolist(), rng.choice(ids, 3000).tolist()))
    left, right = np.array(pairs).T
    alone = {i for t, i in pieces.normal.items() if pieces.reachable[i]}
    assert pieces._may_follow(left, right).tolist() == [pieces._merged(a, b) for a, b in pairs]
    assert {a for a, b in pairs if pieces._merged(a, b)} <= alone


def test_words_of_like_length_are_learnt_together_and_pairs_tested_once(monkeypatch):
    pieces, calls, tested = sentencepieces.Pieces(_model(2)), [], []
    viterbi, stays = pieces._viterbi, pieces._stays
    monkeypatch.setattr(pieces, "_viterbi", lambda *a: calls.append(len(a[0])) or viterbi(*a))
    monkeypatch.setattr(pieces, "_stays", lambda a, b: tested.extend(zip(a.tolist(), b.tolist())) or stays(a, b))
    words = ["▁" + ("summer night " * 4).replace(" ", "")[:n] for n in range(1, 40)]
    pieces._learn(words)
    assert sum(calls) == len(words) and len(calls) < 16  # one call for each length before
    first = len(tested)
    pieces._forget()
    pieces._learn(words)
    assert first > 0 and len(tested) < first + first // 10
    alone = sentencepieces.Pieces(_model(2))
    for w in words:
        alone._learn([w])
    assert [alone.flat[slice(*alone.begin[alone.words[w]:][:2])].tolist() for w in words] == [
        pieces.flat[slice(*pieces.begin[pieces.words[w]:][:2])].tolist() for w in words]


def test_texts_encoded_in_one_batch_or_alone(monkeypatch):
    import pyarrow as pa

    model = _model(2)
    texts = ["", "one two", "x" * 5000, "日本語 🙂", "", "a  b\n" * 400]
    batch = pa.record_batch([pa.array(range(6), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    whole = pa.Table.from_batches(sentencepieces._encoded(iter([batch]), model, True))
    monkeypatch.setattr(sentencepieces, "_CHARS", 10)
    monkeypatch.setattr(sentencepieces, "_KEPT", 3)
    sentencepieces._pieces(model)._forget()
    assert pa.Table.from_batches(sentencepieces._encoded(iter([batch]), model, True)).to_pylist() == whole.to_pylist()
    assert whole["round_trip"].to_pylist() == [True] * 6


def test_encode_and_decode(odd, nothing):
    out = sentencepieces.encode(odd)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] for r in rows)
    back = sorted(((r["doc_id"], r["text"]) for r in sentencepieces.decode(out).collect()), key=repr)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t in ROWS), key=repr)
    assert sentencepieces.encode(nothing).collect() == []


# --- Licences ----------------------------------------------------------------------------

def _license_brute(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    w = find(lower)
    at, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i:i + len(p)] == p:
                at.append(i)
                base.add(label)
    lines = lower.split("\n")
    blocks = [set(find(x)) for x in lines]                                       # lines
    blocks += [set(find(x)) | set(find(y)) for x, y in zip(lines, lines[1:])     # two that no blank one parts
               if x.strip(" \t\r\f\v") and y.strip(" \t\r\f\v")]
    blocks += [set(find(x)) for x in re.split(r"\n[ \t\r\f\v]*\n", lower)]      # paragraphs
    labels, best = set(base), 0.0
    for label, t in licenses.TEMPLATES:
        t = {x.decode() for x in licenses.words_of(t)}
        for b in blocks:
            share = len(t & b) / len(t)
            if share >= licenses.CONTAINMENT - 1e-9:
                labels.add(label)
                best = max(best, share)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if at else best)


NOTICES = [(100 + i, f"Some words before.\n\n{t}\n\nand after") for i, (_, t) in enumerate(licenses.TEMPLATES)] + [
    (200, licenses.TEMPLATES[7][1].replace(" copy ", "\ncopy\n").replace("free of charge", "gratis of charge")),
    (201, "mit license MIT LICENSE gnu general public license cc by apache license"), (202, "gnu general public\nlicense"),
    (-203, "This work is licensed under a Creative Commons\nAttribution 4.0 International License."),
    (-204, "a\n\nThis work is licensed\nunder a Creative\nCommons Attribution 4.0\nInternational License.\n \nb"),
    (-205, "This work is licensed under a Creative Commons\n\nAttribution 4.0 International License.")]


def test_licenses(spark, nothing):
    rows = ROWS + NOTICES + _rows(spark)
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *_license_brute(t)) for i, t in rows), key=repr)
    assert {r["doc_id"]: r["labels"] for r in got if r["doc_id"] in (-203, -204, -205)} == {-203: "cc-by", -204: "cc-by", -205: ""}
    assert {r["labels"] for r in got if r["doc_id"] and 100 <= r["doc_id"] < 112} >= {"bsd", "isc", "mpl", "unlicense"}
    assert licenses.scan_licenses(nothing).collect() == []


# --- Packing -----------------------------------------------------------------------------

def _check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids) % capacity or capacity, len(ids), capacity))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ids)])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by) <= 1.02 * -(-total // capacity) + 2
    return by


def test_packing(spark, odd, nothing):
    _check_packing(ROWS, packing.pack(odd).collect(), 1024)
    out = packing.pack(odd, capacity=64, keep_ids=True).collect()
    _check_packing(ROWS, out, 64)
    assert all(len(r["ids"]) == r["length"] for r in out)
    assert packing.pack(nothing).collect() == []


def test_packing_sample_table(spark):
    _check_packing(_rows(spark), packing.pack(read_table(spark, SF_CHECK, "documents")).collect(), 1024)


def test_plan_uses_each_length_as_often_as_there_is_one():
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = np.zeros(101, int)
        np.add.at(counts, rng.integers(1, 101, rng.integers(0, 400)), rng.integers(1, 50))
        used = np.zeros(101, int)
        for times, lengths in packing.plan(counts, 100):
            assert sum(lengths) <= 100 and times > 0
            np.add.at(used, lengths, times)
        assert (used == counts).all()


def test_plan_finds_exact_complements():
    counts = np.zeros(11, int)
    counts[[7, 3]] = 5          # singles
    counts[[6]] = 2             # 6 = 2 + 2 twice
    counts[[2]] = 4
    assert sum(t for t, _ in packing.plan(counts, 10)) == 7


# --- Personal data -----------------------------------------------------------------------

#: The contract's patterns, as Python's.
_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        twice = [int(c) * 2 for c in d[-2::-2]]
        return 16 <= len(d) <= 19 and (sum(map(int, d[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def _spans(t):
    return [(k, m.start(), m.end()) for k, p in _PII.items() for m in re.finditer(p, t or "") if _holds(k, m.group())]


TRICKY = [(300, "a@b.c@d.e x@y.z%q@e.f..g@h.i-j.k"), (301, "1.2.3.4.5.6.7.8 0255.1.1.1 001.2.3.4 1.2.3"), (302, "+1 2 3 4 5 6 7 8 9+123 456 78 )"),
          (303, "4111-1111-1111-1111 4111111111111112 4111 1111  1111 1111 " + "4" * 40), (304, "😀😀 a.b@c.d 😀 +12345678 é 1.1.1.1"),
          (305, "@" * 3000 + "a" * 3000 + "@" + "b." * 3000), (306, "9" * 20000 + " " + "+1" * 2000)]


def test_identifiers(spark, odd, nothing):
    rows = ROWS + TRICKY + _rows(spark)
    got = pii.find_personal_data(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["identifiers"]]) for r in got), key=repr) == sorted(
        ((i, _spans(t)) for i, t in rows), key=repr)
    assert pii.find_personal_data(nothing).collect() == []


def test_query_digest(spark):
    from stagewatch.llm.queries import op4_pii

    texts = dict(_rows(spark))
    for r in op4_pii(spark, SF_CHECK).collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in _spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in _PII] == [sum(s[0] == k for s in _spans(texts[r["doc_id"]])) for k in _PII]


def _told():
    """'zanzibar' stands only beside one address; 'the' everywhere; 'once' in one context only."""
    rows = [(i, f"the note {i} has the word") for i in range(60)]
    rows += [(100, "the zanzibar agent ann@x.org left"), (101, "the agent ann@x.org of zanzibar came"), (102, "the once ann@x.org seen")]
    rows += [(103, "zanzibar alone"), (104, "the mail bob@y.org once")]
    return rows


def test_disclosing_terms(spark):
    got = {r["doc_id"]: [("zanzibar" if t["disclosure"] else "") for t in r["terms"]] for r in pii.find_personal_data(docs(spark, _told())).collect()}
    spans = {r["doc_id"]: [(t["start"], t["end"]) for t in r["terms"]] for r in pii.find_personal_data(docs(spark, _told())).collect()}
    words = {i: [t[a:b] for a, b in spans[i]] for i, t in _told()}
    n, co = 65, {"zanzibar": (2, 3), "agent": (2, 2), "the": (3, 64), "once": (1, 2)}
    for word, (both, df) in co.items():
        share = np.log2(both * n / (df * 3)) / np.log2(n / 3)
        assert (word in words[100] + words[101] + words[102]) == (share >= pii.GENERALISE and both >= pii.SUPPORT), (word, share)
    assert words[103] == words[104] == [] and got[0] == []


def test_disclosing_terms_go_from_whole_texts(spark):
    """'zanzibar' beside the address, far from it, and in a text with another identifier; 'quagga' only ever far."""
    far = " ".join(["word"] * 40)
    rows = [(i, f"the note {i} has the word") for i in range(60)]
    rows += [(100, f"the Zanzibar agent ann@x.org left {far} zanzibar {far} quagga"), (101, f"quagga {far} 😀 the agent ann@x.org of zanzibar"),
             (102, f"zanzibar {far} mail bob@y.org")]
    got = {r["doc_id"]: [t["start"] for t in r["terms"]] for r in pii.find_personal_data(docs(spark, rows)).collect()}
    for i, text in rows[60:]:
        for word in ("zanzibar", "quagga"):
            at = [m.start() for m in re.finditer(word, text.lower())]
            assert set(at) <= set(got[i]), (i, word)
    left = " ".join(r["text"] for r in pii.sanitise(docs(spark, rows)).where("doc_id >= 100").collect()).lower()
    assert "zanzibar" not in left and "quagga" not in left and "word" in left


def test_a_document_counts_once_however_many_contexts_it_has(spark):
    """One long document with an address in many contexts beside an ordinary word."""
    long = " ".join(f"note{i} from ann@x.org sent{i} " + "z " * 70 for i in range(40))
    rows = [(0, long)] + [(i, f"from place {i}") for i in range(1, 21)] + [(i, f"other {i}") for i in range(21, 200)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert "from" not in {long[t["start"]:t["end"]] for t in got[0]["terms"]}  # log2(200 / 21) / log2(200) = 0.43


def test_an_identifier_of_every_document_is_not_disclosed(spark):
    for rows in ([(i, f"row {i} footer{i % 2} mail ann@x.org now") for i in range(6)], [(1, "mail ann@x.org here, mail ann@x.org there")]):
        assert [r["terms"] for r in pii.find_personal_data(docs(spark, rows)).collect()] == [[]] * len(rows)
        assert not [r for r in pii.sanitise(docs(spark, rows)).collect() if "[TERM]" in r["text"] or "[EMAIL]" not in r["text"]]


def test_sanitise(spark, odd, nothing):
    rows = [(1000 + i, t) for i, t in _told()] + ROWS + TRICKY
    before, table = dict(rows), docs(spark, rows)
    out = pii.sanitise(table)
    assert out.columns == table.columns and out.count() == table.count()
    for r in out.collect():
        t = before[r["doc_id"]] if r["doc_id"] is not None else None
        if r["doc_id"] is not None and not _spans(t):
            assert r["text"] == t
        elif r["doc_id"] is not None:
            assert not [s for s in _spans(r["text"]) if s[0] == "email"] and r["n_chars"] == len(r["text"])
            for k, a, b in _spans(t):
                assert t[a:b] not in r["text"] or len(t[a:b]) < 8
    ten = out.where("doc_id = 10").first()["text"]
    assert ten == "Mail [EMAIL] or [PHONE], card [CARD], ip [IP] not 1.2.3.456."
    assert pii.sanitise(nothing).collect() == []


@pytest.mark.parametrize("line", ["word{0} user{0}@host{1}.org said", "word{0} ann@x.org said{0}"])
def test_a_text_of_very_many_identifiers(spark, line):
    """Many addresses once, and one address many times, with terms that disclose it: time in proportion, every place right."""
    took = {}
    for n in (10000, 20000):
        text = "\U0001f600 ".join(line.format(i, i % 50) for i in range(n))
        rows = [(1, text), (2, "wrote ann@x.org, zanzibar"), (3, "zanzibar then ann@x.org left")] + [(10 + i, "plain") for i in range(50)]
        began = time.perf_counter()
        new = pii.sanitise(docs(spark, rows)).where("doc_id = 1").first()["text"]
        took[n] = time.perf_counter() - began
        assert re.sub(r"\[TERM\]|word[0-9]+|said[0-9]*| ", "", new) == "\U0001f600".join(["[EMAIL]"] * n)
    assert took[20000] < 3 * took[10000]
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]["identifiers"]] == _spans(text)
    ends = [(s["start"], s["end"]) for s in got[1]["terms"]]
    assert ends == sorted(ends) and all(re.fullmatch(r"\w+", text[a:b]) for a, b in ends)


def test_no_python_on_the_main_path(spark):
    table = read_table(spark, SF_CHECK, "documents")
    for df in (pii.find_personal_data(table), pii.sanitise(table)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# --- Token counts ------------------------------------------------------------------------

def test_edited_texts_count_as_if_encoded_anew():
    import random

    counter = token_counts.Counter(token_counts.ranks_path())
    rng = random.Random(3)
    alphabet = ["a", "l", "'", "'ll", "'s", " ", "  ", "\n", "7", "é", "😀", ".", "!?", "word", " the", "ve"]
    for _ in range(150):
        t = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 2000])))
        state = token_counts.CountedText(t, counter)
        for _ in range(25):
            a, n = rng.randint(-2, len(t) + 3), rng.choice([0, 0, 1, 2, 7, 500])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 8, 300])))
            state.edit(a, n, new)
            a = min(max(a, 0), len(t))
            t = t[:a] + new + t[min(a + n, len(t)):]
            assert state.text == t
            assert state.tokens == len(counter.encoding.encode_ordinary(t))
            assert [p for leaf in state.leaves for p in leaf] == [(len(p), counter.tokens(p)) for p in counter.cut.findall(t)]


def test_an_edit_encodes_only_its_surroundings():
    counter = token_counts.Counter(token_counts.ranks_path())
    state = token_counts.CountedText("some words here " * 20_000, counter)
    state.edit(100_000, 3, "xyz")
    assert state.encoded < 100


def test_count_tokens(spark, odd, nothing):
    counter = token_counts.Counter(token_counts.ranks_path())
    count = lambda t: len(counter.encoding.encode_ordinary(t))
    edits = token_counts.edits_from(odd)
    by = {}
    for e in edits.collect():
        by.setdefault(e["doc_id"], []).append(tuple(e)[1:])
    want = []
    for i, text in ROWS:
        t, own = text or "", sorted(by.get(i, [])) if i is not None else []
        before = t
        for _, a, n, new in own:
            t = t[:a] + new + t[a + n:]
        want.append((i, len(before), count(before), len(own), len(t), count(t)))
    got = [tuple(r)[:6] for r in token_counts.count_tokens(odd, edits).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(nothing, edits).collect() == []
    none = edits.where("false")
    assert {r["n_edits"] for r in token_counts.count_tokens(odd, none).collect()} == {0}
