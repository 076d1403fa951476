"""The pipeline's stages, each on what its predecessor kept, against brute-force versions."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_operators import roots, shingles

import corpus_pipeline
from namewright.llm.common import stored, table
from namewright.llm.line_dedup import MIN_SITES
from namewright.llm.packing import END_ID
from namewright.llm.pii import find_pii
from namewright.llm.quality import ACCEPTED, featurise, train

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What went into each stage, and what the last one returned."""
    docs = stored(table(spark, SF, "documents"), "test")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), f"test-{k}")
        out.append(docs)
    return out


def texts(df):
    rows = df.collect()
    out = {r.doc_id: r.text for r in rows}
    assert len(out) == len(rows)
    return out


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:5])
    for df in kept[1:5]:
        assert df.where("text is not null and n_chars <> length(text)").count() == 0


def test_quality_stage(spark, kept):
    """Scores from every pair of features, one by one."""
    b, w, v = train(kept[0], table(spark, SF, "labels"))
    want, near = set(), set()
    for i, text in texts(kept[0]).items():
        c, x = featurise(text)
        x = x.astype(np.float32).astype(np.float64)
        pairs = np.outer(x, x) * (v[c].astype(np.float64) @ v[c].T.astype(np.float64))
        p = 1 / (1 + np.exp(-(b + x @ w[c].astype(np.float64) + np.triu(pairs, 1).sum())))
        if p >= ACCEPTED:
            want.add(i)
        if abs(p - ACCEPTED) < 1e-6:
            near.add(i)
    got = texts(kept[1])
    assert got and set(got) - near == want - near
    assert got == {i: t for i, t in texts(kept[0]).items() if i in got}


def test_line_stage(kept):
    rows = kept[1].collect()
    key = lambda line: line.strip(" ").lower()
    sites, keeper = defaultdict(set), {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            sites[key(line)].add(r.source)
            keeper[key(line)] = min(keeper.get(key(line), r.doc_id), r.doc_id)
    bad = {x for x, s in sites.items() if len(s) >= MIN_SITES and x.strip()}
    want = {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if key(x) not in bad or keeper[key(x)] == r.doc_id) for r in rows}
    assert bad and texts(kept[2]) == want


def test_near_stage(kept):
    found = texts(kept[2])
    sets = {i: shingles(t, 5) for i, t in found.items()}
    ids = sorted(i for i, s in sets.items() if s)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(found, links)
    assert links and texts(kept[3]) == {i: t for i, t in found.items() if root[i] == i}


def test_pii_stage(kept):
    spans = {r.doc_id: [(int(a), int(b), k) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in find_pii(kept[3]).collect()}
    want = {}
    for i, text in texts(kept[3]).items():
        marks, start = [None] * len(text or ""), {}
        upto = 0
        for a, b, k in sorted(spans[i], key=lambda s: (s[0], -s[1])):
            if a >= upto:
                start[a] = f"<{k.upper()}>"
            upto = max(upto, b)
            marks[a:b] = [True] * (b - a)
        want[i] = None if text is None else "".join(start.get(n, "") + ("" if marks[n] else c) for n, c in enumerate(text))
    assert any(spans.values()) and texts(kept[4]) == want


def test_pack_stage(kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {i: [*encode.encode(t or "", add_special_tokens=False).ids, END_ID] for i, t in texts(kept[4]).items()}
    rows, at = kept[5].collect(), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_line_stage_removes_short_boilerplate(spark):
    rows = [(k, f"own {k}\n\nAll rights reserved.\nLes.", "en", f"s{k}", 0) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    assert got == {0: (rows[0][1], len(rows[0][1]))} | {k: (f"own {k}\n", 6) for k in range(1, 6)}
