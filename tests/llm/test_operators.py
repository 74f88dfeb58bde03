"""The corpus operators against brute force, over nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontaminate, language_model, licenses, packing, pii, quality, simhash, toxicity, warc
from lattica.llm.queries import tokenizer_files

PROSE = "the red fox ran over a hill and sat by the river while birds sang"
TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE + " again"), (4, None), (5, ""), (6, "   \n\t "), (7, "A"), (8, "éÀ ß 日本 😀 x"),
    (9, "word " * 6000), (None, "no id here"), (10, "call +1 (555) 123-4567 or a@b.co, 1.2.3.4; 4111 1111 1111 1111"),
]


def documents(spark, rows=TEXTS):
    """Documents with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("score", "fp", "key", "spans", "n_words", "component_id", "value", "src", "held")})


def empty(spark):
    return documents(spark).where("false")


def test_simhash(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    fp = {r.doc_id: r.fp for r in got}
    assert len(got) == len(TEXTS)
    for i, t in TEXTS:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        import xxhash

        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
        assert fp[i] & (1 << 64) - 1 == want
    assert fp[4] == fp[5] == fp[6] == 0
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.where("doc_id in (1, 2, 4, 5, 6)").collect()) == [1, 4]


def test_simhash_links_short_and_long_postings(spark):
    r = np.random.default_rng(0)
    base = [int(x) for x in r.integers(0, 1 << 63, 40)]
    values = set(base)
    for b in base[:8]:
        values.update(b ^ (1 << int(k)) for k in r.integers(0, 63, 3))
    values.update(base[0] ^ (1 << k) ^ (1 << j) for k in range(16) for j in range(k))  # one long posting
    v = np.array(sorted(values), np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")).collect()
    from tests_support import roots

    want = [(int(v[i]), int(v[j])) for i in range(len(v)) for j in np.nonzero(np.bitwise_count(v[i] ^ v) <= 2)[0] if i < j]
    assert roots([(e.src & (1 << 64) - 1, e.dst & (1 << 64) - 1) for e in edges], v.tolist()) == roots(want, v.tolist())


def test_decontamination(spark):
    w = [f"w{k}" for k in range(40)]
    bench = [(1, " ".join(w[:14])), (2, "Short, item!"), (3, None), (4, "..."), (11, " ".join(w[5:20])), (12, " ".join(w[:14]))]
    texts = [*TEXTS, (20, "x " + ", ".join(w[:14]).upper() + " y"), (21, "a SHORT item b"), (22, " ".join(w[:9])), (23, "shorts item"), (24, " ".join(w[3:20]) + " short item")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own: dict = {}
    for i, t in bench:
        x = split(t)
        for k in range(max(1, len(x) - 9) if x else 0):
            own.setdefault(tuple(x[k : k + 10]), set()).add(str(i))
    for passes in (decontaminate.PASS_BYTES, 60):
        keep, decontaminate.PASS_BYTES = decontaminate.PASS_BYTES, passes
        got = {r.doc_id: r for r in decontaminate.contamination(documents(spark, texts), benchmark).collect()}
        decontaminate.PASS_BYTES = keep
        for i, t in texts:
            x, items = split(t), set()
            hit = [False] * len(x)
            for p, o in own.items():
                for k in range(len(x) - len(p) + 1):
                    if tuple(x[k : k + len(p)]) == p:
                        items |= o
                        hit[k : k + len(p)] = [True] * len(p)
            g = got[i]
            assert (g.n_words, g.n_hit, g.n_items) == (len(x), sum(hit), len(items)), i
            assert g.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            assert g.contaminated is any(hit)
    clean = decontaminate.clean_only(documents(spark, texts), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in texts if not got[i].contaminated}
    assert decontaminate.contamination(documents(spark), benchmark.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), benchmark).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    r = np.random.default_rng(1)
    parts = ["a@b.c", "@", ".", "x", "_d@e.f", "1.2.3.4", "256.1.1.1", "0001.0.0.255", "+1", " (23)", "4111 1111-1111 1111", " ", "9", "é😀", "-", "+", "%", "555-01", "\n"]
    texts = [*TEXTS, *[(100 + k, "".join(parts[j] for j in r.integers(0, len(parts), 12))) for k in range(150)], (300, "1 " * 8000), (301, "a" * 30000 + "@" * 3000), (302, "+1" + " " * 20000)]
    texts += [(400 + k, f"please call me now +1 (555) 123-45{10 + k} ends") for k in range(6)] + [(450, "please call me now 555-1234-99, thanks")]
    got = {r.doc_id: r for r in pii.report(documents(spark, texts)).collect()}
    for i, t in texts:
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert set(want) <= set(got[i].spans.split(",")) | {""}
    assert got[450].spans == "phone:19:30"
    masked = {r.doc_id: r.text for r in pii.mask(documents(spark, texts)).collect()}
    assert masked[10] == "call [PHONE] or [EMAIL], [IP]; [CARD]" and masked[450] == "please call me now [PHONE], thanks" and masked[4] is None
    assert pii.mask(documents(spark)).columns == documents(spark).columns
    assert pii.report(empty(spark)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_files()[0])
    texts = [*TEXTS, (30, "a<|endoftext|>b"), *[(100 + k, f"{PROSE} {k} " * 30) for k in range(40)]]
    rows = packing.pack(documents(spark, texts), *tokenizer_files()).collect()
    ids = Counter()
    for i, t in texts:
        ids[i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    by_doc: dict = {}
    by_seq: dict = {}
    for p in rows:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.length > 0
        by_doc.setdefault(p.doc_id, []).append((p.start, p.ids))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for (i, raw), n in ids.items():
        if n == 1:
            assert b"".join(x for _, x in sorted(by_doc[i])) == raw
    assert sum(p.length for p in rows) == sum(len(raw) // 4 * n for (_, raw), n in ids.items())
    for s in by_seq.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)][:-1]]).tolist() and sum(n for _, n in s) <= 1024
    assert packing.pack(empty(spark), *tokenizer_files()).count() == 0


def test_quality_and_toxicity(spark):
    r = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in ("ra", "li", "mo") for b in ("ten", "sur") for c in ("a", "en", "it", "os")]
    good = [" ".join(words[j] for j in r.integers(0, len(words), 60)) + "." for _ in range(120)]
    bad = [x.upper().replace(" ", "!! ") for x in good[:60]]
    rude = [" ".join([*x.split()[:20], "blockhead", *x.split()[20:40], "blockhead", "dolt"]) for x in good[60:]]
    texts = [*enumerate([*good, *bad, *rude]), *[(i, t) for i, t in TEXTS[4:7]]]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(not 120 <= i < 180), int(i >= 180)) for i in range(240)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        train = labels.where("doc_id % 3 <> 1")
        got = module.score(docs, module.fit(docs, train)).collect()
        assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
        want = {x.doc_id: x[label] for x in labels.collect()}
        held = [x for x in got if x.doc_id % 3 == 1 and 6 < x.doc_id < 240]
        assert np.mean([x.predicted == want[x.doc_id] for x in held]) > 0.9, label
        assert module.score(empty(spark), module.fit(docs, train)).count() == 0
        assert module.score(docs, module.fit(docs, labels.where("false"))).count() == len(texts)
    kept = quality.accepted(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns


def test_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network({"a": 1})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["c"][:] = -0.5
    x = r.normal(size=(4, 5, toxicity.INPUTS))
    mask, doc, y = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 1, 0, 0, 0], [0, 0, 0, 0, 0]], float), np.array([0, 0, 1, 2]), np.array([1, 0, 0])
    grads, dx = net.gradients(x, mask, doc, y)
    for k, v, g in [*((k, v, grads[k]) for k, v in net.p.items() if k in grads), ("x", x, dx)]:
        flat = v.reshape(-1)
        j = int(r.integers(min(len(flat), 10)))
        flat[j] += 1e-4
        up = net.loss(x, mask, doc, y)
        flat[j] -= 2e-4
        down = net.loss(x, mask, doc, y)
        flat[j] += 1e-4
        assert abs((up - down) / 2e-4 - g.reshape(-1)[j]) < 1e-5, k


def test_toxicity_scores_as_it_trains():
    """A text's score from the table of projected words is that of the network over all its windows."""
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[k] for k in r.integers(0, 40, n)) for n in (0, 3, 48, 49, 200)]
    net = toxicity.Network({w: k + 1 for k, w in enumerate(words[:30])})
    net.p["c"][:] = -1
    got = toxicity.ToxicityModel(net, 0.5).score(texts)
    net.forget()
    flat, mask, doc = toxicity._batched([net.ids(toxicity._words(t)) for t in texts])
    x, _, _ = net.inputs(np.arange(len(net.known)), np.array(net.known))
    logits = net.forward(net._projected(x[flat])[0], mask)
    assert np.allclose(got, 1 - np.exp(-np.bincount(doc, weights=np.logaddexp(0, logits))), atol=1e-5)


def test_windows_cover_all():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        seen = {k for lo, hi in toxicity.windows(n) for k in range(lo, hi)}
        assert seen == set(range(n)) and all(hi - lo <= toxicity.WINDOW for lo, hi in toxicity.windows(n))


def test_language_model(spark):
    texts = [*TEXTS, (50, PROSE + " UNSEEN words " + PROSE), (51, "the red fox sat by the hill")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    keep, language_model.CURSORS = language_model.CURSORS, 100
    got = language_model.scores(documents(spark, texts), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).collect()
    language_model.CURSORS = keep
    assert len(got) == len(texts)
    w = lambda t: (t or "").encode().lower().split()
    c, c2, c3, starts = Counter(), Counter(), Counter(), 0
    for i, t in texts:
        if not held(i):
            x = [*w(t), "END"]
            c.update(x)
            c2.update(zip(["START", *x], x))
            c3.update(zip(["START", *x], x, x[1:]))
            starts += 1
    n, v, (m1, m2) = sum(c.values()), len(c), language_model.MU
    p = lambda t: (c[t] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda h, t: (c2[h, t] + m1 * p(t)) / ((starts if h == "START" else c[h]) + m1)
    p3 = lambda g, h, t: (c3[g, h, t] + m2 * p2(h, t)) / (c2[g, h] + m2)
    by = {r.doc_id: r for r in got}
    for i, t in texts:
        x = [*w(t), "END"]
        g = by[i]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(x), sum(c[k] > 0 for k in x), n, held(i))
        assert g.base_score == pytest.approx(sum(log10(p(k)) for k in x))
        assert g.score == pytest.approx(log10(p2("START", x[0])) + sum(log10(p3(*k)) for k in zip(["START", *x], x, x[1:])))
    assert language_model.scores(empty(spark), F.lit(False)).count() == 0
    assert language_model.scores(documents(spark), F.lit(True)).where("n_known > 0").count() == 0


def _automaton(texts, mu):
    s = language_model.Stream.of(texts, np.ones(len(texts), bool))
    pairs, words = s.counts(), s.word_counts()
    return language_model.BackoffAutomaton(s, words.astype(float), pairs[: len(s.first)].astype(float), pairs[len(s.first) :].astype(float), int(words.sum()), int((words > 0).sum()), len(texts), mu)


def test_language_model_sums_to_one():
    """In every state but those behind an end, the probabilities of all known words and one unknown word sum to one."""
    m = _automaton(["a b a c", "b a", "a b a b c"], (2.0, 3.0))
    n = int(m.s.word_counts().sum())
    unknown = np.log10(0.5 / (n + 0.5 * (len(m.s.words) + 2)))
    size = m.s.size
    for state in [0, 1, *range(3, size + 1), *(size + 1 + np.nonzero(m.s.second != 1)[0]).tolist()]:
        words = np.arange(1, m.s.size)
        total = (10 ** m.step(np.full(len(words), state), words)[1]).sum()
        weight, s = 0.0, state
        while s:
            weight, s = weight + m.fail_weight[s], m.fail[s]
        assert total + 10 ** (weight + unknown) == pytest.approx(1), state


def test_language_model_walk_in_pieces():
    """Walks from many places give what one walk gives."""
    r = np.random.default_rng(0)
    m = _automaton([" ".join(f"w{k}" for k in r.integers(0, 9, int(r.integers(0, 60)))) for _ in range(40)], (2.0, 3.0))
    keep, found = language_model.CURSORS, []
    for language_model.CURSORS in (1, 7, 300, 10**6):
        found.append(m.traverse())
    language_model.CURSORS = keep
    assert all(np.allclose(found[0], x) for x in found) and found[0].sum() < -100


def test_warc(spark):
    rows = [(1, "http://A.com/x?y#z", "same"), (2, "https://u@b.org:8080", "same"), (3, None, None), (4, 'odd "url\n', ""), (5, "http://a.com/x", "ünï"), (6, "http://a.com/x", "same"), (6, "http://a.com/x", "same"), (7, "", "long " * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "sha1": F.lit(2), "part": F.lit(3)})
    got = warc.round_trip(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, _, _ in rows)
    first: dict = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    want = {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want[r.page_id]
    assert warc.round_trip(pages.where("false")).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=100).collect()} == {"response"}


def test_warc_lookup(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.net/p{k}", f"page {k}") for k in range(900)], "page_id long, url string, html string")
    parts = warc.write(pages, str(tmp_path))
    asked = pages.where("page_id % 97 = 5")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(asked, str(tmp_path), parts).collect()}
    assert got == {k: f"page {k}" for k in range(900) if k % 97 == 5}
    assert warc.read(spark.createDataFrame([(1, "http://none/")], "page_id long, url string"), str(tmp_path), parts).count() == 0


def test_surt(spark):
    df = spark.createDataFrame([("http://WWW.Ex.com:80/A?b#c",), ("https://ex.com",), ("x",), (None,)], "url string")
    assert [r[0] for r in df.select(warc.surt(F.col("url"))).collect()] == ["com,ex,www)/A?b", "com,ex)/", "x", ""]


def test_licenses(spark):
    wrapped = "Permission is hereby granted, free of charge, to\nany person obtaining a copy of this software and\nassociated documentation files"
    texts = [
        *TEXTS, (60, PROSE + "\nReleased under the MIT License.\n" + PROSE), (61, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"), (62, "Licensed under CC BY-NC 4.0.\r\nAll rights reserved."),
        (63, PROSE + "\n" + wrapped + "\n" + PROSE), (64, "This program is licensed under the Zebra Public License, version 5."), (64, "Licensed under CC BY 4.0."), (65, "All rights reserved.\n" + PROSE + "\nAll rights reserved."),
        (66, PROSE + " Released under the MIT License. " + PROSE), (None, "All rights reserved."), (67, PROSE * 3000 + "\nAll rights reserved."), (68, "The license plate of her car was blue.\nThe public house was reserved for the party."),
    ]
    rows = [*texts, texts[12]]
    got = licenses.report(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_paragraphs, r.n_unknown, r.families) for r in got}
    assert {(60, 1, 0, "mit"), (61, 1, 0, "apache-2.0"), (62, 2, 0, "all-rights-reserved,cc-by-nc"), (63, 1, 0, "mit"), (64, 1, 1, ""), (64, 1, 0, "cc-by"), (65, 2, 0, "all-rights-reserved"), (67, 1, 0, "all-rights-reserved"), (68, 0, 0, "")} <= by
    assert (None, 1, 0, "all-rights-reserved") in by
    assert all((i, 0, 0, "") in by for i, _ in TEXTS)
    assert licenses.report(empty(spark)).count() == 0


def test_licence_families_and_others(spark):
    """Every template gets its family; the same notices under other names are licences of no family; prose is none."""
    model = licenses.fit(spark)
    notices = [(k, f, t) for k, (f, t) in enumerate((f, t) for f, texts in licenses.TEMPLATES.items() for t in texts)]
    docs = spark.createDataFrame([(k, t) for k, _, t in notices], "doc_id long, text string")
    assert {(r.doc_id, r.family) for r in licenses.scan(docs, model).collect()} == {(k, f) for k, f, _ in notices}
    other = ["Released under the Quagga License.", "This work is licensed under the Northern Lights Licence, version 4.", "Licensed under the terms of the Pebble Software License.", "Distributed under the Ocelot Public License."]
    docs = spark.createDataFrame(list(enumerate([*other, *[PROSE] * 3, "He was granted free passage by the captain of the ship."])), "doc_id long, text string")
    assert {(r.doc_id, r.family) for r in licenses.scan(docs, model).collect()} == {(k, "unknown") for k in range(len(other))}


def test_simhash_refined_posting():
    """Six equal bytes: groups within two bits, small and larger than the number of neighbours looked up."""
    from tests_support import roots

    r = np.random.default_rng(1)
    for n in (2, 40, 300, 3000):
        v = np.unique(r.integers(0, 1 << 16, n).astype(np.uint64) | np.uint64(0xABCD << 40))
        want = [(i, j) for i in range(len(v)) for j in np.nonzero(np.bitwise_count(v[i] ^ v) <= 2)[0].tolist() if i < j]
        at = {int(x): k for k, x in enumerate(v.view(np.int64))}
        got = [(at[a], at[b]) for a, b in simhash.linked(v.view(np.int64))]
        assert roots(got, range(len(v))) == roots(want, range(len(v))) and len(got) < len(v)
