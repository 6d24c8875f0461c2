"""The pipeline's stages against brute-force versions, each on what its predecessor kept."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from semdex.llm import mixing, packing, pu_quality, simhash
from semdex.llm.common import table

SHARES = {0: 3.0, 1: 1.0, 2: 2.0}


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(input, output) of each stage, read back from Parquet."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, sf, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(at / str(k)))
        done = spark.read.parquet(str(at / str(k)))
        out.append((docs.toPandas(), done.toPandas()))
        docs = done
    return out


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns)
        assert (after.n_chars == after.text.map(len)).all() and len(after)


def test_quality_stage(spark, sf, stages):
    before, after = stages[0]
    model = pu_quality.fit_on(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want = {i for i, t in zip(before.doc_id, before.text) if model.score(pu_quality.features(t)[None])[0] >= 0.7}
    assert set(after.doc_id) == want and after.doc_id.is_unique
    labels = table(spark, sf, "labels").toPandas()
    good = set(labels.doc_id[labels.quality == 1]) & set(before.doc_id)
    assert len(good & want) >= 0.95 * len(good)


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    fps = {i: simhash.fingerprint(t) for i, t in zip(before.doc_id, before.text)}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(after.doc_id) == sorted({find(i) for i in ids})
    assert dict(zip(after.doc_id, after.text)).items() <= dict(zip(before.doc_id, before.text)).items()


def test_repeated_string_stage(stages):
    before, after = stages[2]
    seen, want = set(), {}
    for i, text in sorted(zip(before.doc_id, before.text)):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left or not gone.any():
            want[i] = left
    assert dict(zip(after.doc_id, after.text)) == want


def test_mixing_stage(spark, stages):
    before, after = stages[3]
    size = defaultdict(int)
    words = {i: t.split() for i, t in zip(before.doc_id, before.text)}
    for i, s in zip(before.doc_id, before.source):
        size[s] += len(words[i])
    names = sorted(size)
    target = mixing.water_fill([size[s] for s in names], [SHARES[k % 3] for k in range(len(names))], 1.5 * sum(size.values()), 2.0)
    taken = defaultdict(int)
    by_doc = defaultdict(int)
    for i, s, t in zip(after.doc_id, after.source, after.text):
        taken[s] += len(t.split())
        by_doc[i] += len(t.split())
    for s, want in zip(names, target):
        assert abs(taken[s] - want) <= 192
    plan = mixing.mix(spark.createDataFrame(before)).toPandas()
    assert dict(by_doc) == {i: n for i, n in zip(plan.doc_id, plan.taken) if n}
    assert all(n <= 2 * len(words[i]) for i, n in by_doc.items())


def test_packing_stage(stages):
    before, after = stages[4]
    paths = packing.default_paths()
    want = sorted(tuple(packing.token_ids(t, paths[0]) + [1]) for t in before.text)
    own = defaultdict(list)
    at = None
    for r in after.sort_values("sequence_id").itertuples():
        at = r.sequence_id if r.start == 0 else at
        own[at].append(r)
    got = []
    for pieces in own.values():
        ids = np.concatenate([p.ids for p in pieces])
        assert [p.length for p in pieces] == packing.piece_lengths(len(ids)) and {p.doc_tokens for p in pieces} == {len(ids)}
        assert all(zlib.crc32(np.asarray(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
        got.append(tuple(ids.tolist()))
    assert sorted(got) == want
