"""Stages of the corpus pipeline against brute force."""

import corpus_pipeline
import numpy as np
from tests_support import roots

from lattica.llm import near_copies


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicate_stage(spark):
    """Edited copies, a large group of them, exact copies, texts without words, a repeated id and a null id."""
    r = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(900)]
    texts = [" ".join(vocabulary[j] for j in r.integers(0, 900, int(r.integers(3, 200)))) for _ in range(60)]
    for k in range(60):
        w = texts[k].split()
        for _ in range(int(r.integers(1, 4))):
            w[int(r.integers(0, len(w)))] = "edited"
        texts.append(" ".join(w))
    base = [vocabulary[j] for j in r.integers(0, 900, 150)]
    for _ in range(80):
        w = list(base)
        for j in r.integers(0, len(w), int(r.integers(1, 5))):
            w[j] = f"e{r.integers(0, 50)}"
        texts.append(" ".join(w))
    rows = [*enumerate([*texts, texts[0], "  ", "", None, "short text", "Short  TEXT"]), (3, texts[3]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": near_copies.F.lit(1), "held": near_copies.F.lit(2)})
    got = corpus_pipeline.near_duplicate_filter(spark, docs, "")
    assert got.columns == docs.columns
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    want = roots([(i, j) for i in sets for j in sets if i < j and similar(sets[i], sets[j])], sets)
    assert len(set(want.values())) < len(sets) - 60
    assert sorted((x.doc_id for x in got.collect()), key=lambda i: -1 if i is None else i) == [None, *sorted(set(want.values()))]
    assert corpus_pipeline.near_duplicate_filter(spark, docs.where("false"), "").count() == 0


def test_near_duplicate_stage_asks_the_fingerprint_index(spark, monkeypatch):
    """Operator 8's links alone, without a min-hash that two texts share; the exact similarity still decides."""
    monkeypatch.setattr(near_copies, "bands", lambda s: np.zeros(0, np.int64))
    r = np.random.default_rng(6)
    text = [f"w{j}" for j in r.integers(0, 9000, 3000)]
    # one more word at the end: a similarity above 0.99; the words of every fourth line anew: below 0.8, whatever the bits
    rows = [(1, " ".join(text)), (2, " ".join([*text, "end"])), (3, " ".join(w if k % 4 else f"x{k}" for k, w in enumerate(text))), (4, "alone"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicate_filter(spark, docs, "")
    assert sorted(x.doc_id for x in got.collect()) == [1, 3, 4, 5]


def test_run(spark, tmp_path):
    """The whole pipeline on a small folder against its stages in plain Python."""
    from tokenizers import Tokenizer

    from lattica.llm import quality
    from lattica.llm.queries import tokenizer_files

    r = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in ("ra", "li", "mo", "te") for b in ("ten", "sur", "vel") for c in ("a", "en", "it", "os")]
    good = [" ".join(words[j] for j in r.integers(0, len(words), 70)) + "." for _ in range(90)]
    bad = [x.upper().replace(" ", "!! ") for x in good[:45]]
    near = [good[k].replace(" ", " and ", 1) for k in range(12)]  # one more word: a similarity above 0.8
    passage = " ".join(good[50].split()[3:18])
    texts = [*good, *bad, *near, good[5], " ".join(reversed(good[60].split())) + " write to a.b@example.org or +1 (555) 123-4567 now", None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(not 90 <= i < 135), 0) for i in range(135)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [i for i, t in rows if model.score([t])[0] >= 0.5]
    sets = {i: shingle_set(texts[i]) for i in kept}
    group = roots([(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])], sets)
    kept = [i for i in kept if group[i] == i]
    folded = lambda t: " ".join((t or "").lower().replace(".", " ").split())
    window = folded(passage).split()
    windows = [" ".join(window[k : k + 10]) for k in range(len(window) - 9)]
    kept = [i for i in kept if not any(f" {w} " in f" {folded(texts[i])} " for w in windows)]
    want = {i: (texts[i] or "").replace("a.b@example.org", "[EMAIL]").replace("+1 (555) 123-4567", "[PHONE]") for i in kept}
    assert 50 not in want and 148 in want and len(want) < len(texts) - 40
    got: dict = {}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for p in sorted(pieces, key=lambda p: p.start):
        got[p.doc_id] = got.get(p.doc_id, b"") + p.ids
    tok = Tokenizer.from_file(tokenizer_files()[0])
    ids = lambda t: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], np.uint32).tobytes()
    assert got == {i: ids(t) for i, t in want.items()}
    assert "[PHONE]" in want[148] and "[EMAIL]" in want[148]


def test_stages_name_their_operators():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
