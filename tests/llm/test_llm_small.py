"""Small cases of each operator: nulls, empty and long texts, ties and repeated rows, empty tables, clashing column names."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hunkwise.llm import common, components, cws, decontamination, line_dedup, packing, pii, simhash, token_counts, toxicity, url_filter, warc

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000)) + "\n" + "z" * 50_000
TEXTS = [None, "", "   \n\t", "one", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "A b C d e f g h i j k l.\nEnd!", LONG, "\n\n\n", "é ü ß 日本 " * 20, "mail x@y.example.com and 10.0.0.1 or +1 (555) 010-9999\n4111 1111 1111 1111", "<|endoftext|> b c\x1cd\x85 e"]
SCHEMA = "doc_id bigint, text string, score string, N_LINES string, fingerprint int, spans int, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "own", "own", 1, 2, "en") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", None, None, None, None, None), (3, "one", "other", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(df, *columns):
    return sorted(((r.doc_id, *[r[c] for c in columns]) for r in df.collect()), key=repr)


# ---- 1 -------------------------------------------------------------------------------------------------------------------


def test_fingerprint_edits(spark, docs, none):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), cws.text_of(cws.sampler().sign(t)), cws.text_of(cws.sampler().sign(edited))))
    got = {}
    for r in cws.fingerprint_edits(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert cws.fingerprint_edits(none).count() == 0
    one = cws.fingerprint_edits(docs.filter("doc_id = 10")).first()
    assert one.near_next == 1


def test_fingerprint_column(docs, none):
    out = cws.fingerprint_documents(docs)
    assert out.columns.count("fingerprint") == 1 and out.count() == docs.count() and cws.fingerprint_documents(none).count() == 0
    same = out.filter("doc_id in (4, 5)").select("fingerprint").distinct()
    assert same.count() == 1
    a = out.filter("doc_id = 6").select(F.col("fingerprint").alias("a"))
    near = a.crossJoin(same).select(cws.likeness(F.col("a"), F.col("fingerprint"))).first()[0]
    signs = [cws.sampler().sign(TEXTS[i]) for i in (4, 6)]
    assert near == pytest.approx(float(np.mean(signs[0] == signs[1])))


def test_collisions_estimate_generalised_jaccard():
    rng, sampler = random.Random(1), cws.Sampler(2048)
    for _ in range(4):
        words = [rng.choice("abcdefgh") for _ in range(60)] * 3
        other = words[:90] + [rng.choice("abcdefgh") for _ in range(60)]
        a, b = " ".join(words), " ".join(other)
        assert np.mean(sampler.sign(a) == sampler.sign(b)) == pytest.approx(cws.jaccard(a, b), abs=0.04)


# ---- 2 -------------------------------------------------------------------------------------------------------------------


def leaky(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 14, 20, 40, 40])] + [(6, None), (7, ""), (2, "twice used id of item two"), (8, "x")]
    docs = []
    for i in range(40):
        body = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            passage = items[i % 6][1].upper().split()
            if i % 3 == 0 and len(passage) > 10:
                passage[rng.randrange(len(passage))] = "changed"
            if i % 5 == 0 and len(passage) > 10:
                passage = passage[1:]
            at = rng.randrange(len(body) + 1)
            body = body[:at] + passage + body[at:]
        docs.append((i, ", ".join(body) if i % 4 == 1 else " ".join(body)))
    docs += [(3, docs[3][1]), (None, items[3][1]), (50, None), (51, "")]
    return docs, items


def test_decontamination_equals_brute_force(spark):
    docs, items = leaky(spark)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contaminated(d.withColumn("item", F.lit(1)), b.withColumn("length", F.lit(2)))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == decontamination.brute_force(docs, items)
    assert got.count() == got.select("doc_id", "item_id").distinct().count()
    bad = {r.doc_id for r in got.select("doc_id").collect()}
    kept = decontamination.decontaminate(d, b)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t or "") for i, t in docs if i not in bad)
    assert decontamination.contaminated(d.limit(0), b).count() == 0 and decontamination.contaminated(d, b.limit(0)).count() == 0
    assert decontamination.decontaminate(d, b.limit(0)).count() == len(docs)


def test_candidates_are_those_laid(spark):
    """Windows of one length and items of the same length: a window looks at the items it was laid for, within the radius, and no other."""
    rng = random.Random(17)
    items = {i: rng.getrandbits(63) for i in range(40)}
    windows = {w: items[w % 40] ^ sum(1 << b for b in rng.sample(range(63), rng.choice([0, 3, 20, 23, 24, 30]))) for w in range(400)}
    laid = [(w, i) for w in windows for i in {w % 40, (w + 1) % 40}]
    index = decontamination.index_of(spark.createDataFrame(list(items.items()), "item bigint, print bigint"))
    got = decontamination.candidates(spark.createDataFrame(list(windows.items()), "window bigint, print bigint"), spark.createDataFrame(laid, "window bigint, item bigint"), index)
    assert sorted(tuple(r) for r in got.collect()) == sorted((w, i) for w, i in laid if (windows[w] ^ items[i]).bit_count() <= decontamination.RADIUS)


@pytest.mark.parametrize("bound", [0, 50])
def test_decontamination_without_broadcasts(spark, monkeypatch, bound):
    docs, items = leaky(spark)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == decontamination.brute_force(docs, items)


def test_decontamination_is_native(spark, small):
    plan = decontamination.op2_decontamination(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


# ---- 3 -------------------------------------------------------------------------------------------------------------------


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(300)] for _ in range(4)]
    texts = [None, "", " \t", "one two", "One TWO", "one two three four", "é É"]
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "new"
        texts.append(" ".join(words))
    texts += texts[-3:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    want = simhash.brute_force(texts)
    got = sorted(simhash.near_duplicates(df.withColumn("simhash", F.lit("own"))).collect())
    assert [(f"{r.simhash & (2**64 - 1):016x}", r.component_id) for r in got] == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_deduplicate(spark):
    rng = random.Random(14)
    base = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (12, 200, 400, 400, 900)]
    texts, group = [None, "", " \t", "one two", "One TWO", "one two three"], [0, 0, 0, 3, 3, 5]
    for k, words in enumerate(base):
        for i in range(30):  # a word in 200 changes, or none in short texts
            own = [f"new{rng.randrange(10**6)}" if i and len(words) > 100 and rng.random() < 1 / 200 else w for w in words]
            texts.append(" ".join(own))
            group.append(100 + k)
    half = base[1][:100] + [f"other{i}" for i in range(100)]
    texts, group = [*texts, " ".join(half)], [*group, 200]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, node string").repartition(5)
    kept = sorted(r.doc_id for r in simhash.deduplicate(df.unionAll(df.limit(20))).collect())
    assert kept == sorted(group.index(g) for g in set(group))
    assert simhash.deduplicate(df).columns == df.columns and simhash.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 64, 1000])
def test_leaders_of_buckets(rows):
    rng = random.Random(15)
    table = []
    for bucket, n in ((-5, 1), (2, 200), (3, 1), (9, 40)):
        centres = [rng.getrandbits(63) for _ in range(3)]
        table += [(bucket, node, rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(5)))) for node in range(n)]
    cols = [pa.array(c, pa.int64()) for c in zip(*table, strict=True)]
    whole = pa.RecordBatch.from_arrays(cols, names=["bucket", "node", "print"])
    got = sorted((a, b) for batch in simhash.leader_links((whole.slice(i, rows) for i in range(0, len(table), rows)), 3) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    want, led = [], {}
    for bucket, node, fp in table:
        near = [n for n, f in led.setdefault(bucket, []) if (f ^ fp).bit_count() <= 3]
        if near:
            want.append((node, near[0]))
        else:
            led[bucket].append((node, fp))
    assert got == sorted(want) and len(want) > 100


def test_deduplicate_without_broadcasts(spark):
    texts = ["a b c d e f g"] * 3 + ["h i j k l m n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(df, broadcast_rows=0).collect()) == [0, 3, 4]


@pytest.mark.parametrize("block", [5, simhash.PAIR_BLOCK])
def test_similar_texts_behind_dissimilar_leaders(spark, block):
    rng, words = random.Random(16), [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(20):  # the same words in another order are not similar, but all their prints are equal or near
        own = rng.sample(words, 300)
        swapped = [*own[:100], own[101], own[100], *own[102:]]
        texts += [" ".join(own), " ".join(swapped), " ".join([*own[:200], "new", *own[201:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.deduplicate(df, block=block).collect()) == list(range(0, 60, 3))


def test_every_near_pair_meets_in_a_table():
    rng, masks = random.Random(5), [m & (2**64 - 1) for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(m & bits == 0 for m in masks)


def test_simhash_broadcasts_no_rows_of_all_tables(spark, monkeypatch):
    plans, stored = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    words = F.concat_ws(" ", F.lit("one two three"), F.col("id").cast("string"))
    got = simhash.near_duplicates(stored(spark.range(300).select(F.col("id").alias("doc_id"), words.alias("text")), "docs")).collect()
    assert len(got) == 300 and "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]


@pytest.mark.parametrize("block", [3, simhash.BLOCK])
def test_dense_buckets_in_blocks(spark, block):
    rng = random.Random(6)
    prints = {0}
    while len(prints) < 150:  # chains of near fingerprints, and far ones
        p = rng.choice(sorted(prints))
        prints.add(p ^ sum(1 << b for b in rng.sample(range(60), rng.choice([2, 4, 9]))))
    prints = sorted(prints)
    group = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {p: low if g == high else g for p, g in group.items()}
    df = spark.createDataFrame([(p,) for p in prints], "simhash bigint")
    got = {r.simhash: r.component for r in simhash.link_components(df, block=block).collect()}
    assert {p: got.get(p, p) for p in prints} == group


@pytest.mark.parametrize("low", range(60, 63))
def test_sign_bit_is_a_bit(low):
    flips = [1 << low, 1 << 63, 1 << 63 | 1 << low, 1 << 63 | 1 << low | 1]
    near = np.array([0x0123456789ABCDEF, *[0x0123456789ABCDEF ^ f for f in flips]], np.uint64).view(np.int64)
    assert len(simhash._forest(near, np.arange(5), 3)) == 4
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([7] * (b - a), range(a, b), near[a:b])], names=["bucket", "node", "print"])
    for cuts in ([0, 5], [0, 1, 3, 5]):  # within a batch, and against leaders of an earlier one
        links = [x for got in simhash.leader_links((batch(a, b) for a, b in zip(cuts, cuts[1:])), 3) for x in got.column(0).to_pylist()]
        assert sorted(links) == [1, 2, 3, 4]


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 30), (30, 31), (5, 5)] + [(1000, i) for i in range(200, 260)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 30, 30: 30, 31: 30, 1000: 200, **{i: 200 for i in range(200, 260)}}


# ---- 4 -------------------------------------------------------------------------------------------------------------------

PII = [
    "a@b.c_d@e.f x@y @z.w q@w.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111-1111 1111, 4111111111111112 5 5", "+1 (555) 010-9999x +12 +4 4 4 4 4 4 4 4 4 4 4 4 4 4 4 4", "é日a@b.co\n+49 30 1234567",
    "9" * 5000 + " " + "1 " * 3000, "a" * 20000, "a.b." * 4000 + "@" + "c." * 3000, " ".join(f"10.0.{i % 300}.{i % 250}" for i in range(500)), None, "",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(df).collect()}
    assert [got[i] for i in range(len(PII))] == [pii.brute_base(t) for t in PII]


def disclosing():
    """Texts whose words go with entities: by value, by class and by kind; near copies of one passage; and others."""
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(n))
    far = " ".join(["filler words"] * 30)
    texts = [f"{filler(20)} Zebediah wrote{i} zeb@mail.example.com {filler(20)} {far}" for i in range(6)]
    texts += [f"{filler(9)} own{i}@corp.example.org {filler(9)} Corporate {far}" for i in range(5)]
    texts += [f"{filler(9)} 10.{i}.0.{i} {filler(9)} gateway" for i in range(5)] + ["many in one: " + " ".join(f"and{i} 10.0.{i}.9" for i in range(9)) + " listing"]
    texts += [f"passage edit{i} of the same words, and then a card 4111 1111 1111 1111 beside some rareword" for i in range(9)]
    texts += [filler(60) for _ in range(60)] + [None, "one", "No address, yet ZEBEDIAH is here", "a Gateway elsewhere; zeb example 4111", texts[0], texts[1]]
    return texts


@pytest.mark.parametrize("bound", [pii.BROADCAST_TERMS, 0])
def test_disclosing_terms_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
    texts = disclosing()
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id bigint, text string").withColumn("Spans", F.lit(1)).repartition(3)
    told = pii.brute_terms(texts)
    assert {"zebediah", "corporate", "gateway"} <= told.keys() and not told.keys() & {"rareword", "passage", "filler", "zeb", "4111", "listing"}
    got = sorted((r.doc_id, [(s.start, s.end, s.value) for s in r.terms]) for r in pii.find(df).collect())
    assert got == sorted((i, pii.brute_spans(t, told)) for i, t in [*enumerate(texts), (3, texts[3])])
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[1] and "zebediah" not in clean[1].lower() and "zebediah" not in clean[88].lower() and clean[86] is None


def test_pii_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find(df).count() == 0 and pii.sanitise(df).count() == 0
    assert pii.brute_terms([]) == {}


def test_pii_is_native(spark, small):
    plan = pii.op4_pii(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


# ---- 5 and 6 -------------------------------------------------------------------------------------------------------------


def test_ids_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_path())
    encode = packing.ids_of(packing.default_path())
    rng = random.Random(9)
    odd = ["", " ", "a  b", "\n\n x", " <|endoftext|>\n\n <|endoftext|>", "don't we'll I'VE", "x y　z", "²½ a1b2", "éa", "a.b,c!?…", " \x1c\x1f\x85q", "  "]
    odd += ["".join(rng.choice("ab C.,!?'\n\t é9 日́-_") for _ in range(40)) for _ in range(400)]
    for text in [t for t in TEXTS if t] + odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_is_exact(docs, none):
    encode = packing.ids_of(packing.default_path())
    rows = packing.pack(docs).collect()
    seen, of_doc = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
        of_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids))
    for spans in seen.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= packing.WINDOW
    texts = [(r.doc_id, encode(r.text or "") + b"\0\0\0\0") for r in docs.select("doc_id", "text").collect()]
    for key in {(i, len(b) // 4) for i, b in texts}:
        copies = [b for i, b in texts if (i, len(b) // 4) == key]
        assert sum(n for _, n, _ in of_doc[key]) == key[1] * len(copies)
        if len(copies) == 1:
            assert b"".join(ids for _, _, ids in sorted(of_doc[key])) == copies[0]
    assert packing.pack(none).count() == 0


def test_cuts_are_the_best(docs):
    rng = random.Random(10)
    for _ in range(200):
        window = rng.randrange(3, 9)
        positions = [0]
        while len(positions) < rng.randrange(3, 12):
            positions.append(positions[-1] + rng.randrange(1, window + 1))
        penalties = [0] + [rng.randrange(4) for _ in positions[1:]]
        cost = {0: 0}
        for j in range(1, len(positions)):
            cost[j] = min(cost[i] + window - positions[j] + positions[i] + penalties[j] for i in range(j) if positions[j] - positions[i] <= window)
        cuts = packing.cut(positions, penalties, window)
        got = sum(window - (b - a) + penalties[positions.index(b)] for a, b in zip([0, *cuts], cuts))
        assert got == cost[len(positions) - 1] and cuts[-1] == positions[-1] and all(b - a <= window for a, b in zip([0, *cuts], cuts))


def test_token_counts():
    rng = random.Random(11)
    for _ in range(60):
        pieces = lambda: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))).encode() for _ in range(rng.randrange(1, 15))}
        initial, later = pieces(), pieces()
        automaton = token_counts.Automaton(initial, later)
        for _ in range(60):
            word = "".join(rng.choice("abcd"[: rng.choice([3, 3, 3, 4])]) for _ in range(rng.randrange(0, 14))).encode()
            assert automaton.count(word) == token_counts.brute_force(word, initial, later), (word, initial, later)


def test_token_count_query(docs, none):
    path = packing.default_path().replace(".json", ".tiktoken")
    initial, later = token_counts.vocabulary(path)
    got = token_counts.count_tokens(docs, path)
    for r in got.filter("doc_id <> 7").collect():
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(token_counts.brute_force(w, initial, later) for w in words))
    assert got.count() == docs.count() and token_counts.count_tokens(none, path).count() == 0


# ---- 7 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [0, 1000])
def test_line_dedup(spark, bound):
    texts = [f"Same line \x0b\nown {i}\n\n{'x' * i}" for i in range(12)] + ["SAME LINE\n same line", "É\né", None, ""] + ["rare\r\nÀ"] * 9 + ["À\nrare x", "only ten"] + ["only ten"] * 8 + ["ONLY TEN\t\nlast"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id bigint, text string, N_Dropped string").repartition(3)
    want = line_dedup.brute_force(texts)
    got = sorted(line_dedup.dedup_lines(df, broadcast_keys=bound).collect())
    assert [(r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got] == want
    assert [c.lower() for c in line_dedup.dedup_lines(df).columns].count("n_dropped") == 1
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_temporary_names_do_not_clash(spark):
    df = spark.createDataFrame([(i, "same\nown", f"r{i}", f"k{i}") for i in range(12)], "doc_id bigint, text string, row string, `keys` string")
    for bound in (0, 1000):
        got = sorted(line_dedup.dedup_lines(df, broadcast_keys=bound).collect())
        assert [(r.row, r["keys"], r.text, r.n_dropped) for r in got] == [(f"r{i}", f"k{i}", "", 2) for i in sorted(range(12))]


def test_empty_keys_go_if_they_count(spark):
    df = spark.createDataFrame([(i, f"a{i}\n\n \t\nb") for i in range(10)], "doc_id bigint, text string")
    assert {r.text for r in line_dedup.dedup_lines(df, min_length=0).collect()} == {f"a{i}" for i in range(10)}
    assert {r.text for r in line_dedup.dedup_lines(df, min_length=2).collect()} == {f"a{i}\n\n \t\nb" for i in range(10)}


def test_runs_are_levelled(spark):
    df = spark.createDataFrame([("a\nb",), ("a",), ("c",), ("a\nc",), ("d",)], "text string")
    runs = line_dedup.LineRuns(spark, min_docs=2, buckets=3)
    for i in range(5):
        runs.add(line_dedup.line_counts(df if i == 0 else df.filter("text = 'd'")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    n = {bytes(r.key): r.n for r in runs.merged().collect()}
    assert n[line_dedup.digest(b"a")] == 3 and n[line_dedup.digest(b"c")] == 2 and n[line_dedup.digest(b"b")] == 1
    assert 2 <= n[line_dedup.digest(b"d")] <= 5  # a settled key needs no more counting


def test_runs_are_joined_without_an_exchange(spark, monkeypatch):
    df = spark.createDataFrame([(f"line {i % 50}",) for i in range(300)], "text string")
    runs, plans = line_dedup.LineRuns(spark, min_docs=2, buckets=3), []
    written = runs._written
    monkeypatch.setattr(runs, "_written", lambda counts: plans.append(counts._jdf.queryExecution().executedPlan().toString()) or written(counts))
    for _ in range(4):
        runs.add(line_dedup.line_counts(df))
    assert [p.count("hashpartitioning") for p in plans] == [1, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0]  # a new batch is dealt out, the runs never
    assert sum("SortMergeJoin" in p for p in plans) == 3


# ---- 8 and 9 -------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response</p>"), (4, "http://c", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response</p>"), (None, "http://d", "new"), (6, "http://e", "y" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, extra int")
    path = common.scratch(spark, "warc-test")
    warc.write_archives(df, path)
    got = warc.captures(spark, path, payload=True).collect()
    assert sum(r.copies for r in got) == len(pages) and len(got) == 6
    by = {warc_id(r): r for r in got}
    assert by[1].response.type == "response" and by[1].response.payload == pages[0][2] and by[1].response.sound and by[1].response.target_uri == "http://a/%20%20X:%20y"
    assert by[4].response.type == "revisit" and by[4].copies == 2 and by[4].response.refers_to == by[1].record_id
    assert by[2].response.payload_bytes == 0 and by[3].response.refers_to == by[2].record_id
    assert all(r.request is not None and r.metadata is not None for r in got)
    assert by[6].response.payload_digest == __import__("base64").b32encode(hashlib.sha1(b"y" * 300_000).digest()).decode()


def warc_id(row):
    digits = row.metadata.fields.removeprefix("page_id: ").strip()
    return int(digits) if digits else None


def test_small_payloads_are_no_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcd"), (4, "x", "abcd")], "page_id bigint, url string, html string")
    path = common.scratch(spark, "warc-test")
    warc.write_archives(df, path, min_bytes=3)
    assert {warc_id(r): r.response.type for r in warc.captures(spark, path).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_records_that_belong_to_none(spark):
    rows = spark.createDataFrame([("request", "q", "gone", None, None, None, 0, None, None, None)], common.fields("type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, sound boolean, fields string, payload string"))
    assert warc.assemble(rows).count() == 0


URLS = ["http://WWW.Example.COM/en/x?q", "https://example.com/en", "http://example.com", "http://a.example.net/es/1#f", "http://net/fr/", "http://xnet/fr/", "http://example.com:80/en/", None, "", "no scheme/en/", "http://spam-farm.example.org/a?utm_source=x", "http://m.Spam-Farm.example.org", "http://spam-farm.example.organic/", "http://listed.example.org/p/?b=1&utm_x=2#z", "://h/en/", "http://h?x=://y/", "http://a.www.example.com/en/"]


def test_urls(spark):
    listed = spark.createDataFrame([(u,) for u in [*url_filter.LISTED, "listed.example.org/p?b=1", None]], "url string")
    df = spark.createDataFrame([(i, u, "own", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "own", 1)], "page_id bigint, url string, Verdict string, host int")
    out = url_filter.filter_urls(df, listed)
    rows = sorted(out.collect(), key=lambda r: r.page_id)
    assert len(rows) == len(URLS) + 1
    got = {r.page_id: (r.host, r.path, r.rule, r.listed, r.verdict) for r in rows}
    want = [("www.example.com", "/en/x", "www.example.com/en/", False, "allow"), ("example.com", "/en", "com/", False, "allow"), ("example.com", "", None, False, "allow"), ("a.example.net", "/es/1", "net/es/", False, "block"), ("net", "/fr/", "net/fr/", False, "block"), ("xnet", "/fr/", None, False, "allow"), ("example.com:80", "/en/", None, False, "allow")]
    want += [("", "", None, False, "allow")] * 3 + [("spam-farm.example.org", "/a", None, True, "block"), ("m.spam-farm.example.org", "", None, True, "block"), ("spam-farm.example.organic", "/", None, False, "allow"), ("listed.example.org", "/p/", None, True, "block"), ("h", "/en/", None, False, "allow"), ("h", "", None, False, "allow"), ("a.www.example.com", "/en/", "www.example.com/en/", False, "allow")]
    assert [got[i] for i in range(len(URLS))] == want
    assert url_filter.filter_urls(df, listed.limit(0)).filter("listed").count() == 0 and url_filter.filter_urls(df.limit(0), listed).count() == 0


def test_bloom_misses_nothing_and_passes_little(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.BlockedBloom(keys, 5000)
    assert bloom.possible(keys).count() == 5000
    assert bloom.possible(spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key"))).count() < 400


# ---- 10 ------------------------------------------------------------------------------------------------------------------


def test_marginals():
    rng = np.random.RandomState(12)
    for n in (1, 2, 5):
        emit, start, trans = rng.randn(n), rng.randn(2), rng.randn(2, 2)
        prob, pairs = toxicity.marginals(np.vstack([emit, emit]), np.array([n, n]), start, trans)
        assert prob[1] == pytest.approx(toxicity.brute_marginals(list(emit), start, trans))
        assert pairs.sum(axis=2) == pytest.approx(np.ones((2, n - 1)))
    prob, _ = toxicity.marginals(np.array([[1.0, -2, 0.5], [0.3, 9, 9]]), np.array([3, 1]), start, trans)
    assert prob[1, 0] == pytest.approx(toxicity.brute_marginals([0.3], start, trans)[0])


def test_toxicity(spark, docs, none):
    rng = random.Random(13)
    text = lambda bad: ". ".join(" ".join(rng.choice(["sun", "moon", "star", "tree", "leaf"]) + str(rng.randrange(30)) for _ in range(8)) + (" you idiot" if bad and s < 2 else "") for s in range(5))
    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(400)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(1, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(d, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    assert all(out[i].predicted == int(y) for i, _, y in rows)
    assert {rows[0][1][s.start : s.end] for s in out[0].spans} == {"idiot"} or "idiot" in {rows[0][1][s.start : s.end] for s in out[0].spans}
    odd = toxicity.score_documents(docs, model)
    assert odd.count() == docs.count() and [c.lower() for c in odd.columns].count("spans") == 1
    assert all(0 <= r.score <= 1 for r in odd.select("score").collect()) and toxicity.score_documents(none, model).count() == 0
    blank = toxicity.learn(d, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(d, blank).collect()} == {0.0}
    one = toxicity.learn(d, labels.filter("toxic = 1"))
    assert {r.predicted for r in toxicity.score_documents(d, one).collect()} == {1}


def test_folds(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", toxicity.fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_lowered_keeps_offsets():
    assert len(toxicity.lowered("İxY")) == 3 and toxicity.lowered("AbÉ") == "abé"


# ---- the pipeline's stages -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, docs, none, small, name, stage):
    out = stage(spark, docs, small)
    if name == "packing":
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    else:
        assert out.columns == docs.columns
        n = out.count()
        assert n == docs.count() if name in ("toxicity", "line_dedup", "decontamination") else n < docs.count()
    assert stage(spark, none, small).count() == 0
