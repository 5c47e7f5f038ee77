"""Operators against brute force, round trips and odd inputs."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import components, decontam, egojoin, htmltext, minhash, packing, quality, suffixdedup, tokens, tokenstore, toxicity, warc
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.words import batch_word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, rank string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


ODD = [None, "", " ", "a", "a", "é à\n\nü  x ", "word " * 3000, "<|endoftext|> x\ty", "tie tie tie", "\x01\x00 a"]


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_equal_the_library():
    rng = random.Random(1)
    parts = ["word", " ", "  ", "\n", ". ", ",", ",\n", "é", "Ü", "'s", "12", "-", "\t", "　", "\r", "\x00", "!!", " 漢字", "."]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)), prose(rng, 500)]
    got = tokens.encoder(tokenizer_path()).batch(texts)
    assert [g.tolist() for g in got] == [e.tolist() for e in encoded(texts)]


def test_plan_packs_every_length():
    for s in range(40):
        rng = random.Random(s)
        h = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        rows, n = packing.plan(h, 64)
        bins, count = defaultdict(list), Counter()
        for length, _, c, first, per, off in rows.tolist():
            for k in range(c):
                bins[first + k // per].append((off + k % per * length, length))
            count[length] += c
        assert dict(count) == h and len(bins) == n
        for items in bins.values():
            at = 0
            for off, length in sorted(items):
                assert off == at
                at += length
            assert at <= 64
            assert sum(3 * x > 64 for _, x in items) <= 2
        gaps = []
        for x in sorted((x for x, c in h.items() for _ in range(c)), reverse=True):
            fit = min((g for g in gaps if g >= x), default=None)
            gaps.remove(fit) if fit is not None else None
            gaps.append((64 if fit is None else fit) - x)
        assert n <= len(gaps) + max(1, len(gaps) // 50)


def test_packing(spark):
    texts = [*ODD, *(prose(random.Random(i), 30 * i) for i in range(40))]
    got = packing.best_fit_pack(docs_of(spark, texts), tokenizer_path(), 0, 256).toPandas()
    ids = [np.append(e, np.uint32(0)) for e in encoded(texts)]
    assert got.length.sum() == sum(map(len, ids)) and (got.length <= 256).all()
    for r in got.itertuples():
        own = ids[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].astype("<u4").tobytes())
    for _, g in got.sort_values("piece").groupby("doc_id"):
        assert (g.start.values == np.cumsum(g.length.values) - g.length.values).all() and (g.length.values[1:] == 256).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.cumsum(g.length.values) - g.length.values).all() and g.length.sum() <= 256
    assert packing.best_fit_pack(docs_of(spark, []), tokenizer_path()).count() == 0


def test_rans_coder():
    rng = np.random.default_rng(1)
    for n, most in ((1, 3), (70, 5), (5000, 50000), (300000, 900)):
        ids = (rng.zipf(1.3, n) % most).astype(np.uint32)
        coder = tokenstore.Coder(tokenstore.quantised(np.bincount(ids, minlength=most)))
        raw = coder.block([None, 7], [1, n - 1], ids)
        names, lengths, back = coder.unblock(raw)
        assert names == [None, 7] and lengths.tolist() == [1, n - 1] and (back == ids).all()
        with pytest.raises(ValueError):
            coder.unblock(raw[:-3] + bytes([raw[-3] ^ 1]) + raw[-2:])


def test_token_files(spark):
    texts = [*ODD, *(prose(random.Random(i), 20 * i) for i in range(30))]
    ids = [None, 5, 5, *range(100, 100 + len(texts) - 3)]
    got = tokenstore.token_round_trip(docs_of(spark, texts, ids), tokenizer_path(), 2).toPandas().sort_values("start")
    want = Counter((i, len(e) + 1, zlib.crc32(np.append(e, np.uint32(2)).tobytes())) for i, e in zip(ids, encoded(texts), strict=True))
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples()) == want
    assert (got.start.values == np.cumsum(got.n_tokens.values) - got.n_tokens.values).all()
    known = got.doc_id.dropna()
    assert (np.diff(known) >= 0).all()
    assert tokenstore.token_round_trip(docs_of(spark, []), tokenizer_path()).count() == 0


def test_warc(spark):
    big, rng = "<p>" + "x" * 1200, random.Random(2)
    rows = [(1, "http://a", big), (2, None, big), (9, "http://c%41\n", big), (3, "d", "small"), (4, "d", "small"), (5, "e", None), (9, "again", big), (None, "n", big), (7, "u", "é" * 600), (8, "u", "é" * 600), *((100 + i, "z", prose(rng, 40 * i)) for i in range(20))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.warc_round_trip(pages).toPandas()
    assert len(got) == len(rows)
    by = {(None if r.page_id != r.page_id else int(r.page_id), r.url): r for r in got.itertuples()}
    for p, u, h in rows:
        r = by[p, u]
        raw = (h or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest()
        revisit = h == big and p != 9 or p == 7
        assert r.record_type == ("revisit" if revisit else "response")
        assert (r.refers_to == (8 if p == 7 else 9)) if revisit else r.refers_to != r.refers_to
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    assert [x[1:3] for x in warc.coalesced(iter([("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 1)]), 20, 50)] == [(0, 15), (100, 105), (0, 1)]


def test_main_text(spark):
    cases = {
        "<html><body><nav><a>Menu</a></nav><article><h1>T &amp; U</h1><p>First, text.<p>Second\n  <b>bold</b> text.<script>x()</script></article><footer>f</footer>": "T & U First, text. Second bold text.",
        "<body><div class='site-header'>Head</div><div id=main><p>Body text, here. It is long enough.</p><form>Mail</form></div><div class='sidebar'>Side, bar.</div><div id=comments><p>Nice, really.</p></div></body>": "Body text, here. It is long enough.",
        "plain &lt;text&gt;": "plain <text>",
        "<!-- a --><style>p{}</style>": "",
        "<div><p>un<em>closed": "unclosed",
        "": "",
        None: "",
    }
    for html, text in cases.items():
        assert htmltext.main_text(html) == text
    pages = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(cases)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract_main_text(pages).collect()}
    assert [got[i].text for i in range(len(cases))] == list(cases.values()) and got[None].n_chars == 0


def made_page(rng, kind):
    """A page and its article's text, which the maker knows; boilerplate without labels too."""
    sentence = lambda: prose(rng, rng.randint(8, 25)).capitalize() + ", " + prose(rng, 5) + "."
    blocks = [prose(rng, 4).capitalize()]
    body = f"<h1>{blocks[0]}</h1>"
    for _ in range(rng.randint(3, 9)):
        t = " ".join(sentence() for _ in range(rng.randint(1, 4)))
        blocks.append(t)
        body += f"<p>{t.replace(' ', ' <b>', 1).replace('.', '</b>.', 1)}</p>" if rng.random() < 0.3 else f"<p>{t}"
    if rng.random() < 0.5:
        items = [prose(rng, 5) for _ in range(4)]
        body += "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        blocks += items
    links = "".join(f"<li><a href=/{k}>{prose(rng, 2)}</a></li>" for k in range(rng.randint(4, 9)))
    if kind == "labelled":
        html = f"<nav><ul>{links}</ul></nav><div class=ad>{sentence()}</div><article>{body}</article><section id=comments><p>{sentence()}</p></section><footer>{sentence()}</footer>"
    elif kind == "plain":
        html = f"<div><ul>{links}</ul></div><div><section>{body}</section></div><div><ul>{links}</ul></div><script>{sentence()}</script>"
    else:
        html = f"<table><tr><td><div>{links}</div><td><div>{body}</div></table><div><span><a>{prose(rng, 2)}</a></span></div>"
    return f"<html><head><title>{prose(rng, 3)}</title></head><body>{html}</body></html>", " ".join(blocks)


def test_ratios_choose_the_content(monkeypatch):
    pages = [made_page(random.Random(k), kind) for kind in ("labelled", "plain", "table") for k in range(40)]
    assert [htmltext.main_text(h) for h, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(htmltext, "SHARE", 0.0)
    assert all(htmltext.main_text(h) != t for h, t in pages if "<table>" in h)


def test_pages_of_any_depth_and_length():
    deep = "<div>" * 30_000 + "Deep text, here." + "<p>x, y." * 2000
    assert htmltext.main_text(deep).startswith("Deep text, here. x, y.")
    long = "<p>Many words, in one text. " * 20_000
    assert len(htmltext.main_text(long)) == 20_000 * 25 - 1


def brute_repeats(raws, length):
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        m = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = True
        a = np.frombuffer(b, np.uint8)
        out.append((len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.view(np.int8)))) == 1).sum()), hashlib.sha256(a[~m[:-1]].tobytes()).hexdigest()))
    return out


def repeated_texts(rng):
    p, q = prose(rng, 30), prose(rng, 60)
    texts = [None, "", "short", prose(rng, 50) + p + prose(rng, 5), p + prose(rng, 60), prose(rng, 20) + q[:150] + "é" + q[150:], prose(rng, 40) + q, q, q, "ab" * 200, "x" * 300, prose(rng, 9) + p + p]
    return texts + [prose(rng, rng.randint(1, 60)) + q[rng.randint(0, 100) :] + prose(rng, 10) for _ in range(30)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats(spark, hot, monkeypatch):
    if hot == 3:
        monkeypatch.setattr(suffixdedup, "LIGHT", 2)
        monkeypatch.setattr(suffixdedup, "HEAVY", 1 << 40)
    rng = random.Random(hot)
    texts = repeated_texts(rng)
    want = brute_repeats([(t or "").encode() for t in texts], 80)
    got = suffixdedup.repeat_report(docs_of(spark, texts), 80, gram=16, hot=hot).toPandas().sort_values("doc_id")
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want
    assert suffixdedup.repeat_report(docs_of(spark, []), 80, gram=16).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_first_copies_stay(spark, hot):
    rng = random.Random(7 + hot)
    texts = [t for t in repeated_texts(rng) if t is None or t.isascii()]
    seen, want = set(), []
    for t in texts:
        b, m = t or "", np.zeros(len(t or ""), bool)
        for i in range(len(b) - 79):
            if b[i : i + 80] in seen:
                m[i : i + 80] = True
            seen.add(b[i : i + 80])
        want.append(None if t is None else "".join(c for c, x in zip(b, m, strict=True) if not x))
    got = suffixdedup.without_repeats(docs_of(spark, texts), 80, gram=16, hot=hot).toPandas().sort_values("doc_id")
    assert got.text.tolist() == want


def shuffled(spark):
    """Records that all stages so far wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("how", ["left_semi", "inner"])
def test_rows_without_a_named_key_are_not_shuffled(spark, how, tmp_path):
    rows = spark.range(40_000).selectExpr("xxhash64(id) h", "id % 7 ctx", "id rid")
    spark.range(-50, 150).selectExpr("xxhash64(id) h", "id % 7 ctx", "if(id < 5, 2000L, 2L) c").write.parquet(f"{tmp_path}/named")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        for keys in (["h"], ["h", "ctx"]):
            named = spark.read.parquet(f"{tmp_path}/named").select(*keys, "c")
            got = suffixdedup._met(rows, named, keys, how).collect()
            assert sorted(r.rid for r in got) == list(range(150)) and got[0].__fields__ == ["h", "ctx", "rid"]
        assert shuffled(spark) - before < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_pipeline_cuts_passages_of_51_words(spark):
    import corpus_pipeline

    rng = random.Random(31)
    p, q, r = (prose(rng, n).split() for n in (51, 50, 51))
    long = prose(rng, 150).replace(" ", "")
    texts = [
        prose(rng, 30) + ". " + " ".join(p) + ". " + prose(rng, 30),
        prose(rng, 20) + " " + " ".join(q) + " " + prose(rng, 20),
        "Vorher “" + " ".join(r) + "” é danach.",
        "Head: " + "\n".join(p).upper() + "; tail words",
        "before " + " ".join(q) + " after",
        "é “" + " ".join(r[:20]) + " … " + "  ".join(r[20:]) + "” ü " + long,
        "one " + long + " two",
    ]
    assert len(" ".join(p)) < 400
    docs = docs_of(spark, texts).select(*corpus_pipeline.COLUMNS)
    got = corpus_pipeline.repeat_stage(spark, docs, "").toPandas().sort_values("doc_id").text.tolist()
    assert len(long) > 450  # one word, so it repeats by its bytes alone
    assert got[:3] == texts[:3] and got[3:6] == ["Head: ; tail words", texts[4], "é “” ü " + long]
    assert got[6].startswith("one") and long not in got[6]


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "_SEGMENT", 700)
    rng = random.Random(3)
    p = prose(rng, 40)
    raws = [(prose(rng, 300) + p + prose(rng, 200)).encode(), (prose(rng, 100) + p).encode()]
    found = defaultdict(set)
    for d, raw in enumerate(raws):
        for at in range(0, len(raw) - 79, 700 - 79):
            part = raw[at : at + 700]
            if len(part) >= 80:
                _, first, n, off, h, _ = suffixdedup.anchors(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]), 80, 16)
                for f, k in zip(first, n, strict=True):
                    found[d].update(range(at + f, at + f + k))
    assert all(found[d] == set(range(len(r) - 79)) for d, r in enumerate(raws))


def near_texts(rng):
    texts = [None, "", "one two", "one two", "One, two!", "three four five"]
    for _ in range(25):
        words = prose(rng, rng.randint(40, 160)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            w = list(words)
            for _ in range(rng.choice([1, 1, 2, 4])):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts


def test_near_duplicates(spark):
    texts = near_texts(random.Random(5))
    sets = [minhash.weighted_shingles(h) if len(h) else None for h in batch_word_hashes(texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and minhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(texts))]
    got = minhash.near_duplicates(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    assert got.class_id.tolist() == want
    assert got.kept.tolist() == [w == i for i, w in enumerate(want)]
    assert (got.n_class.values == [Counter(want)[w] for w in want]).all()
    again = minhash.near_duplicates(docs_of(spark, ["a b c d e f g"] * 3, [4, None, 4]), ["doc_id", "text", "part"]).toPandas()
    assert again.kept.sum() == 1 and again.columns[:3].tolist() == ["doc_id", "text", "part"]
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def grouped(sets):
    """The least member of each one's group, by comparison of all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_a_link_to_a_lesser_member_of_a_component(spark):
    rng, texts, want = random.Random(21), [], []
    for _ in range(6):
        base, added = prose(rng, 204).split(), prose(rng, 2).split()
        own = [base, *(base + prose(rng, 2).split() for _ in range(20)), base + added + prose(rng, 12).split(), base + added, base[39:] + added]
        own = [" ".join(t) for t in own]
        sets = [minhash.weighted_shingles(h) for h in batch_word_hashes(own)]
        assert [minhash.similarity(s, sets[-1]) >= 0.8 for s in sets[:-1]] == [False] * (len(sets) - 2) + [True]
        want += [len(texts) + g for g in grouped(sets)]
        texts += own
    got = minhash.near_duplicates(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    assert got.class_id.tolist() == want


def test_open_buckets_leave_no_pair_out():
    rng = random.Random(22)
    need, seen = 0.8 / 1.8, Counter()
    hub = (np.arange(100, dtype=np.uint64), np.array([rng.choice([1, 1, 3]) for _ in range(100)]))
    for most in (20, 45, 70):
        sets = []

        def changed(w, times):
            w = w.copy()
            for _ in range(times):
                w[rng.randrange(100)] = rng.choice([0, 0, 2])
                w[rng.randrange(100, 160)] = rng.choice([1, 2])
            return w

        roots = [changed(np.concatenate((hub[1], np.zeros(60, np.int64))), rng.randint(1, most)) for _ in range(8)]
        for _ in range(40):
            w = changed(rng.choice(roots), rng.randint(0, 6))
            sets.append((np.flatnonzero(w).astype(np.uint64), w[w > 0]))
        parts = [minhash._difference(hub, s) for s in sets]
        a, weight = int(hub[1].sum()), np.array([s[1].sum() for s in sets])
        both, lots = np.array([b for b, _ in parts]), [d for _, d in parts]
        comp = np.array([-1 if minhash.similarity(hub, s) >= 0.8 else i for i, s in enumerate(sets)])
        node, x, size = np.arange(40), need * weight - both + a / 2, np.array([len(d) for d in lots])
        index = np.minimum(size, size - np.ceil(2 * x - 1e-6).astype(int) + 1)
        want = {(i, j) for j in range(40) for i in range(j) if comp[i] != comp[j] and minhash.similarity(sets[i], sets[j]) >= 0.8}

        def joined(links):
            top = {i: c for i, c in enumerate(comp.tolist())}
            for i, j in links:
                old, new = top[i], top[j]
                top |= {k: new for k, c in top.items() if c == old}
            return {frozenset(k for k in top if top[k] == c) for c in top.values()}

        for full in (None, lots):
            got = minhash._forest(node, comp, x, size, index, lots, full)
            assert set(got) <= want and joined(got) == joined(want) and len(got) < 40
        seen["links"] += len(want)
    assert seen["links"] > 20


@pytest.mark.parametrize("part", [4096, 3])
def test_a_large_group_without_a_common_hub(spark, monkeypatch, part):
    """Edited copies of a text that is not there, each alike some others only."""
    monkeypatch.setattr(minhash, "PART", part)
    rng = random.Random(77)
    base, texts = prose(rng, 240).split(), []
    for _ in range(90):
        w = list(base)
        for k in rng.sample(range(240), rng.randint(2, 4)):
            w[k] = prose(rng, 1)
        texts.append(" ".join(w))
    sets = [minhash.weighted_shingles(h) for h in batch_word_hashes(texts)]
    links = sum(minhash.similarity(sets[i], sets[j]) >= 0.8 for j in range(90) for i in range(j))
    got = minhash.near_duplicates(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    assert 90 < links < 3000 and got.class_id.tolist() == grouped(sets)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**63, 400).astype(np.uint64)
    e.sort()
    w = rng.integers(1, 6, 400)
    v = w.copy()
    v[:80] = 1
    k = 1000
    a, b = minhash.signature(e, w, k), minhash.signature(e[:360], v[:360], k)
    true = minhash.similarity((e, w), (e[:360], v[:360]))
    assert abs((a == b).mean() - true) < 0.06


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_vector_links(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.25).astype("f4").tolist()) for i in range(260)]
    rows += [(300 + i, rows[0][1]) for i in range(5)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None]), (404, []), (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    got = egojoin.epsilon_links(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, component long"), 0.9, 16).toPandas().set_index("vec_id")
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: [j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt(ok[i] @ ok[i] * (ok[j] @ ok[j])) >= 0.9] for i in ok}
    comp = {i: i for i, _ in rows}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in links.get(i, []))]) for i in comp}
        if new == comp:
            break
        comp = new
    assert sum(map(len, links.values())) > 1000
    for i, _ in rows:
        assert got.n_links[i] == len(links.get(i, [])) and got.component_id[i] == comp[i] and got.kept[i] == (comp[i] == i)
    assert egojoin.epsilon_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_the_grid_order_leaves_most_pairs_out():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 48))
    u = np.concatenate([c + rng.normal(size=(128, 48)) * 0.2 for c in centres])
    u /= np.linalg.norm(u, axis=1)[:, None]
    eps = np.sqrt(0.2)
    dirs = np.linalg.eigh(np.cov(u.T))[1][:, ::-1][:, : egojoin.LEADING]
    cells = np.floor(u @ dirs / eps).astype(int)
    u = u[np.lexsort(cells.T[::-1])]
    x, y = u[:2048], u[2048:]
    assert egojoin.near_runs(u, u, dirs, eps).mean() < 0.4
    for a, b in ((x, y), (x, x)):
        got = egojoin._hits(a, b, dirs, 0.9, eps)
        assert (got == (a @ b.T >= 0.9)).all() and got.sum() > 1000


def test_leaks(spark):
    rng = random.Random(8)
    item = "A train leaves Paris with 25 passengers at 80 km per hour and Anna counts 25 seats while Bob reads " + prose(rng, 10)
    other = item.replace("25", "31").replace("Anna", "Lena").replace("Bob", "Max").replace("km", "miles")
    many = " ".join(f"box {w} holds 25 balls and" for w in prose(rng, 6).split())
    mixed = many.replace("25", "%d") % (25, 31, 44, 52, 67, 70)
    steady = many.replace("25", "31")
    bench = spark.createDataFrame([(1, item), (2, prose(rng, 30)), (3, "two words"), (4, None), (None, item), (5, ""), (6, "7 8 9 10 11"), (7, many)], "item_id long, text string")
    texts = [None, "", prose(rng, 60) + ". " + item + ". " + prose(rng, 20), "So: " + other, prose(rng, 50), "two words", "two words more", item[: len(item) // 2], "1 2 3 4 5 6", "x. " + mixed, "x. " + steady]
    for most in (decontam.MOST, 1):
        got = decontam.leak_report(docs_of(spark, texts), bench, most=most).toPandas().sort_values("doc_id")
        assert got.item_ids.map(list).tolist() == [[], [], [1], [1], [], [3], [], [], [], [], [7]]
    assert decontam.leak_report(docs_of(spark, []), bench).count() == 0
    assert not decontam.leak_report(docs_of(spark, texts), bench.limit(0)).where("contaminated").count()


def test_a_leak_after_a_use_whose_slots_disagree():
    rng = random.Random(41)
    words = prose(rng, 60).split()
    words[2:50:6] = ["25"] * 8
    odd = ["%d" % (100 + i) if w == "25" else w for i, w in enumerate(words)]
    item, tail = " ".join(words), " ".join(words[20:26])
    text = " ".join(odd[:53]) + " " + " ".join(words[:53]) + " then " + prose(rng, 130) + " " + tail
    bank = decontam.Bank([(1, item)])
    assert [k for k, _ in bank.leaks(decontam.template(text))] == [1]
    assert bank.leaks(decontam.template(" ".join(odd[:53]) + " then " + tail)) == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs the generated tables")
def test_toxicity_of_each_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    for _, g in got.groupby("lang"):
        assert g.predicted[g.toxic == 1].mean() >= 0.9 and g.predicted[g.toxic == 0].mean() <= 0.06
    assert got.toxic[got.predicted == 1].mean() >= 0.85


def test_pairs_of_stems():
    m = toxicity.Matcher({}, {"lowe": 5.0}, {"bome": 4.0})
    assert m.weight("bomex") == -4.0 and m.weight("lower") == 5.0 and m.weight("bom") == 0
    assert toxicity._sums(["a bomex b", "a bomex b bomey", "lower bomex", None], m)[:, 0].tolist() == [0.0, 8.0, 5.0, 0.0]


def brute_distance(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_matches_by_distance():
    rng = random.Random(9)
    terms = {"idiot": 2.0, "scum": 3.0, "disgusting": 1.5, "loser": 1.0}
    m = toxicity.Matcher(terms, {"lowe": 5.0})
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice("idotscumle") * rng.randint(0, 1)
        w = "".join(w)
        fits = [(x * 0.9**d) for t, x in terms.items() if (d := brute_distance(w, t)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
        want = max([0, *fits, *([5.0] if w.startswith("lowe") else [])])
        assert m.weight(w) == pytest.approx(want), w


def test_context():
    m = toxicity.Matcher({"idiot": 5.0}, {})
    found = lambda t: toxicity.context_sums(t, toxicity.matches([t], m).get(0, []))
    assert found('He said "idiot" and left')[1] > 0 and found('He said "idiot" and left')[0] == 0
    assert found("What an idiot that is")[0] > 0
    assert found("You are an idiot")[0] > found("What an idiot that is")[0]


def test_toxicity(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = prose(rng, 40) + (" " + rng.choice(["vileword", "nastyterm"]) + " " if toxic else " ") + prose(rng, 20)
        rows.append(text)
        labels.append((i, 1, int(toxic)))
    rows += [None, "", prose(rng, 10) + " vilewrod " + prose(rng, 10)]
    l = spark.createDataFrame([*labels, labels[0], (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs_of(spark, rows), l).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    truth = {i: t for i, _, t in labels}
    assert all(got.predicted[i] == truth[i] for i in truth)
    assert got.predicted[400] == got.predicted[401] == 0 and got.predicted[402] == 1
    none = toxicity.score_toxicity(docs_of(spark, ["x", None]), l.limit(0)).toPandas()
    assert none.score.nunique() == 1 and (none.predicted == 0).all()


def test_quality(spark):
    rng = random.Random(11)
    sentence = lambda: prose(rng, rng.randint(4, 12)).capitalize() + ". "
    clean = ["".join(sentence() for _ in range(rng.randint(4, 20))) for _ in range(150)]
    junk = [t.upper().replace(".", "!!") for t in clean[:12]] + [" | ".join(prose(rng, 60).split()) for _ in range(12)] + [prose(rng, 40).replace(" ", "*** ") for _ in range(12)] + [" ".join(["and"] * 60 + ["the"] * 40)] * 12
    got = quality.quality_scores(docs_of(spark, [*clean, *junk, None, "", "  "])).toPandas().sort_values("doc_id")
    assert got.kept[: len(clean)].mean() > 0.97
    assert got.kept[len(clean) :].mean() < 0.1
    assert not got.kept[-3:].any()
    assert quality.quality_scores(docs_of(spark, [])).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(12)
    y = rng.random(20000) < 0.85
    acc = [0.9, 0.8, 0.7, 0.95, 0.9, 0.85, 0.6, 0.5]
    votes = Counter()
    truth = defaultdict(list)
    for t in y:
        v = tuple(2 if not t and rng.random() < a else 2 if t and rng.random() < 0.02 else 1 if t and k in (4, 5) and rng.random() < a else 0 for k, a in enumerate(acc))
        votes[quality._pattern(v)] += 1
        truth[quality._pattern(v)].append(t)
    post = quality.label_model(dict(votes))
    right = sum(sum((post[p] > 0.5) == t for t in ts) for p, ts in truth.items())
    assert right / len(y) > 0.98


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    sentence = lambda: prose(rng, rng.randint(4, 12)).capitalize() + ". "
    clean = ["".join(sentence() for _ in range(rng.randint(8, 20))) for _ in range(60)]
    texts = [*clean, clean[0], clean[1].replace(" ", "  "), clean[2].upper().replace(".", "!!"), clean[3] + clean[4] * 2, None, ""]
    docs_of(spark, texts).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, clean[5][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
    assert sizes[0] >= 60 and sizes[1] <= sizes[0] - 2 and sizes[2] == sizes[1] and sizes[3] == sizes[2] - 1
    packed = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert 5 not in packed and 0 in packed and 60 not in packed
