"""The ten queries and the pipeline over whole small tables: DuckDB where SQL can say it, brute force elsewhere."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from hunkwise.llm import common, cws, decontamination, line_dedup, packing, pii, queries, simhash, token_counts, toxicity


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in common.table(spark, small, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, small).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda f: sorted(repr(tuple(r)) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_op1(spark, small, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in cws.op1_fingerprints(spark, small).collect()}
    assert set(rows) == set(texts)
    for i, after in zip(order, order[1:] + order[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert rows[i].near_edited == pytest.approx(cws.jaccard(t, edited), abs=0.3) and rows[i].near_next == pytest.approx(cws.jaccard(t, texts[after]), abs=0.3)


def test_op2(spark, small, texts):
    items = [(r.item_id, r.text) for r in common.table(spark, small, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in decontamination.op2_decontamination(spark, small).collect()}
    assert got == decontamination.brute_force(list(texts.items()), items)


def test_op3(spark, small, texts):
    got = sorted(simhash.op3_simhash(spark, small).collect())
    ids = sorted(texts)
    want = simhash.brute_force([texts[i] for i in ids])
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == [(i, p, ids[c]) for i, (p, c) in zip(ids, want, strict=True)]


def test_op4(spark, small, texts):
    for r in pii.op4_pii(spark, small).collect():
        base = pii.brute_base(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert Counter(k for k, *_ in base) == Counter({k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]})
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in text.split(",") if s]


def test_op5(spark, small, texts):
    encode = packing.ids_of(packing.default_path())
    pieces, sizes = {}, Counter()
    for r in packing.op5_packing(spark, small).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sizes[r.sequence_id] += r.length
    for i, t in texts.items():
        ids, at = encode(t) + b"\0\0\0\0", 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    padded = sum(packing.WINDOW - n for n in sizes.values() if n & (n - 1))
    assert max(sizes.values()) <= packing.WINDOW and padded / sum(sizes.values()) < 0.05


def test_op6(spark, small, texts):
    initial, later = token_counts.vocabulary(packing.default_path().replace(".json", ".tiktoken"))
    known = {}
    for r in token_counts.op6_token_counts(spark, small).collect():
        words = texts[r.doc_id].encode().split()
        for w in set(words) - known.keys():
            known[w] = token_counts.brute_force(w, initial, later)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_op10(spark, small, texts):
    labels = {r.doc_id: r.toxic for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.85


def test_pipeline_equals_its_stages_by_brute_force(spark, small):
    docs = common.table(spark, small, "documents")
    model = toxicity.learn(docs, common.table(spark, small, "labels"))
    rows = sorted((r.doc_id, r.text) for r in toxicity.score_documents(docs, model).filter("predicted = 0").collect())
    kept = line_dedup.brute_force([t for _, t in rows])
    own = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id bigint"), "doc_id")).collect())
    assert [hashlib.sha256(t.encode()).hexdigest() for _, t in own] == [h for *_, h in kept]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in own]
    group = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    firsts = [row for at, row in enumerate(own) if group[at] == at]
    items = [(r.item_id, r.text) for r in common.table(spark, small, "benchmark").collect()]
    bad = {i for i, _ in decontamination.brute_force(firsts, items)}
    encode = packing.ids_of(packing.default_path())
    want = {i: encode(t) + b"\0\0\0\0" for i, t in firsts if i not in bad}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, small).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    assert got == want
