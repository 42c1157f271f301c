"""Every operator against its plain counterpart, on the small tables and on rows made to be awkward."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tests.conftest import SF
from tests.llm import brute

from tamis.llm import chat, classifier, decontaminate, licenses, mixing, neardup, ngrams, quality, simhash, substrings, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, row string, key string"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh é漢") for _ in range(r.randint(1, 7))).strip() or "x" for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, repeats inside and between texts, near copies, no spaces, control characters."""
    shared = passage(1, 60)
    long = passage(2, 9000)
    near = passage(3, 150).split()
    texts = [
        None, "", "   \n\t ", "x", "a" * 350, "ab" * 300, shared, "before " + shared, shared + " after " + shared, long, long[: len(long) // 2], passage(4, 12) + "\x00\x0b\r\n" + passage(5, 30),
        " ".join(near), " ".join(near[:70] + ["changed"] + near[71:]), " ".join(near[:71] + ["other"] + near[72:]), "The MIT LICENSE. All Rights Reserved. cc-by CC BY-NC 4.0, general public license",
        "line one is here\nline one is here\n\n" + shared, ("word " * 400), passage(6, 25), passage(6, 25), "漢字" * 80, "漢字" * 80 + "end",
    ]
    return [(i * 3 % 67, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


# ---- 1: decontamination ----

C1 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontaminate_small(spark, small):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.contamination(pairs_of(small), [(r.item_id, r.text) for r in items.collect()])
    assert any(w[2] for w in want)
    assert rows(decontaminate.op1_decontaminate(spark, SF), *C1) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_decontaminate_awkward(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_PHRASES", block)
    items = [(1, passage(1, 60)[20:150]), (2, "X"), (2, passage(4, 12)), (3, None), (4, ""), (None, "word word word"), (10, " ".join(passage(3, 150).split()[60:90]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.decontaminate(spark, odd, frame), *C1) == sorted(brute.contamination(pairs_of(odd), items), key=repr)


def test_decontaminate_empty_tables_and_cleaning(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(spark, odd, none).collect())
    assert decontaminate.decontaminate(spark, odd.limit(0), none).count() == 0
    items = spark.createDataFrame([(1, passage(1, 60))], "item_id long, text string")
    clean = decontaminate.remove_contamination(spark, odd, items, length="n_chars")
    assert clean.schema == odd.schema
    got = {r.doc_id: r for r in clean.collect()}
    before = {r[0]: r for r in awkward()}
    assert passage(1, 60) not in " ".join(r.text or "" for r in got.values())
    gone = [d for d in before if d not in got]
    assert all(brute.alnum_words(before[d][1]) for d in gone) and len(gone) == 1
    assert all(r.n_chars == len(r.text or "") and r.spans == "clash" for r in got.values())


# ---- 2: substrings ----

C2 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_substrings_small(spark, small):
    want = brute.repeats(pairs_of(small))
    assert any(w[2] for w in want)
    assert rows(substrings.op2_substrings(spark, SF), *C2) == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [0, 512])
def test_substrings_awkward(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)  # 0: every shared block is spread by window
    monkeypatch.setattr(substrings, "BATCH_RUNS", 50)
    monkeypatch.setattr(substrings, "CONTEXTS", 5)
    monkeypatch.setattr(substrings, "layout", lambda docs, text: (3, 4))
    assert rows(substrings.removed(spark, odd), *C2) == sorted(brute.repeats(pairs_of(odd)), key=repr)


def test_families_find_what_stands_earlier():
    from tamis.llm import suffixes

    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 400))
        data = rng.integers(0, 3, n + 4).astype(np.uint8)  # zero bytes, also at the ends of strings
        key = suffixes.windows(data, np.arange(n), 4)
        doc, at = rng.integers(0, 9, n).astype(np.int64), rng.integers(0, 9, n).astype(np.uint32)
        tag = rng.integers(0, 99, n).astype(np.uint16)
        family, told, x = suffixes.Family(), [], 0
        while x < n:
            y = x + int(rng.integers(1, 60))
            told += family.add(key[x:y], doc[x:y], at[x:y], tag[x:y])
            x = y
            sizes = [len(v) for v in family.levels]
            assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        level, more = family.close()
        first = {}
        for i in range(n):
            k = bytes(data[i : i + 4])
            first[k] = min(first.get(k, (99, 99)), (int(doc[i]), int(at[i])))
        assert [(k, *v) for k, v in sorted(first.items())] == [(bytes(k).ljust(4, b"\0"), int(d), int(p)) for k, d, p in zip(level.key, level.doc, level.at, strict=True)]
        assert (level.key[1:] > level.key[:-1]).all()
        # Every place that is not the first of its string is told, each as often as it is there or less.
        got = {(int(d), int(p)) for ds, ps, _ in told + more for d, p in zip(ds, ps, strict=True)}
        later = {(int(doc[i]), int(at[i])) for i in range(n) if (int(doc[i]), int(at[i])) != first[bytes(data[i : i + 4])]}
        assert got == later


def test_joined_ranges():
    doc, first, last = np.array([2, 1, 1, 1, 1, 2]), np.array([5, 0, 1, 9, 30, 6]), np.array([5, 20, 3, 21, 31, 9])
    assert [x.tolist() for x in substrings._joined(doc, first, last)] == [[1, 1, 2], [0, 30, 5], [21, 31, 9]]


def test_substrings_short_length_and_random_edits(spark):
    r = random.Random(5)
    base = passage(9, 200)
    docs = []
    for i in range(40):
        t = list(base[r.randint(0, 200) : r.randint(600, 1200)])
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice("xyz")
        docs.append((i, "".join(t)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substrings.removed(spark, frame), *C2) == sorted(brute.repeats(docs), key=repr)


def test_substrings_ties_and_stage(spark, odd):
    same = spark.createDataFrame([(1, "q" * 50 + passage(1, 60))] * 2 + [(None, passage(1, 60))], "doc_id long, text string")
    got = rows(substrings.removed(spark, same), "doc_id", "n_removed")
    assert got == [(1, 0), (1, 0), (None, len(passage(1, 60).encode()))]
    assert substrings.removed(spark, same.limit(0)).count() == 0
    odd = odd.withColumn("text_place", F.lit(1)).withColumn("Repeated_Spans", F.lit("c")).withColumn("doc", F.lit(2)).withColumn("first", F.lit(3))
    out = substrings.remove_repeats(spark, odd, length_col="n_chars")
    assert substrings.remove_repeats(spark, odd.limit(0)).count() == 0
    assert out.schema == odd.schema and all(r.n_chars == len(r.text or "") for r in out.collect())


def test_substrings_rows_that_share_an_id(spark):
    x, y = passage(21, 60), passage(22, 60)
    docs = [(5, "head " + x + " tail"), (5, y), (None, passage(23, 20) + x + y + passage(24, 300)), (None, x), (None, passage(25, 90) + y), (None, None), (1, passage(26, 40))]
    places = sorted(docs, key=lambda d: (d[0] is None, d[0], hashlib.sha256((d[1] or "").encode()).digest()))
    want = brute.repeats([(i, t) for i, (_, t) in enumerate(places)])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = rows(substrings.removed(spark, frame), *C2)
    assert any(w[2] for w in want)
    assert sorted((repr(places[w[0]][0]), *w[1:]) for w in want) == sorted((repr(g[0]), *g[1:]) for g in got)
    assert substrings.remove_repeats(spark, frame).count() > 0


# ---- 3: SimHash ----


def test_simhash_small(spark, small):
    want = brute.simhash_groups(pairs_of(small))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("tile", [2, 4096])
def test_simhash_awkward(spark, odd, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    want = brute.simhash_groups(pairs_of(odd))
    got = {r.doc_id: (f"{r.bits & (2**64 - 1):016x}", r.component_id) for r in simhash.groups(spark, odd).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_simhash_chains_of_links(spark):
    rng = np.random.default_rng(3)
    start = int(rng.integers(0, 2**63))
    values = [start]
    for _ in range(300):  # a chain: each links to the next, ends are far apart
        values.append(values[-1] ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    values = list(dict.fromkeys(values)) + [int(x) for x in rng.integers(0, 2**63, 200)]
    s = brute.Sets(values)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                s.join(a, b)
    from tamis.llm.components import components

    nodes = spark.createDataFrame([(v,) for v in values], "bits long")
    star, _ = components(spark, simhash.links(spark, nodes, 3, 5))
    found = {r.node: r.component for r in star.collect()}
    assert {v: found.get(v, v) for v in values} == {v: s.find(v) for v in values}


@pytest.mark.parametrize("tile", [3, 2048])
def test_near_groups(spark, odd, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    want = brute.jaccard_groups(pairs_of(odd))
    assert {r.doc_id: r.component_id for r in neardup.near_groups(spark, odd).collect()} == want
    kept = neardup.keep_one(spark, odd)
    assert kept.schema == odd.schema and {r.doc_id for r in kept.collect()} == set(want.values())
    assert neardup.keep_one(spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4, 16])
def test_near_groups_of_many_different_copies(spark, monkeypatch, tile):
    """Large groups of near copies that share buckets, chains between them, and unlike texts with the same passage."""
    monkeypatch.setattr(neardup, "TILE", tile)
    r = random.Random(tile)
    docs, common = [], [f"common{k}" for k in range(30)]
    for g in range(3):
        base = common + [f"g{g}w{k}" for k in range(60)]
        for _ in range(40):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = f"x{r.random()}"
            docs.append(" ".join(t))
    chain = common + [f"c{k}" for k in range(60)]
    for k in range(25):  # neighbours are alike, ends are not
        chain[30 + 2 * k % 60] = f"new{k}"
        docs.append(" ".join(chain))
    docs += [" ".join(common + [f"u{i}w{k}" for k in range(r.randint(1, 40))]) for i in range(40)]
    r.shuffle(docs)
    docs = list(enumerate(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute.jaccard_groups(docs)
    assert max(collections.Counter(want.values()).values()) > tile
    assert {r.doc_id: r.component_id for r in neardup.near_groups(spark, frame).collect()} == want


def test_near_groups_with_repeated_lines(spark):
    docs = []
    for i in range(12):  # the second text of each two says one line over and over: the sets stay alike
        base = " ".join(f"w{random.Random(i).random()}{k}" for k in range(304))
        line = f"an eight word footer stands here again {i} "
        docs += [(2 * i, base), (2 * i + 1, base + " " + line * 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.jaccard_groups(docs)
    assert want == {i: i // 2 * 2 for i in range(24)}
    assert {r.doc_id: r.component_id for r in neardup.near_groups(spark, frame).collect()} == want


def test_keep_one_with_null_and_shared_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    docs = [(1, a), (None, a + " more"), (None, b), (None, c), (None, c + " more"), (7, d), (7, e), (3, e + " more"), (2, None), (None, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, (r.text or "").removesuffix(" more")) for r in neardup.keep_one(spark, frame).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (None, b), (None, c), (7, d), (3, e), (2, "")], key=repr)
    got = [(r.doc_id, r.component_id) for r in neardup.near_groups(spark, frame).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (None, 1), (None, None), (None, None), (None, None), (7, 7), (7, 3), (3, 3), (2, 2), (None, 2)], key=repr)


def test_near_copies_are_within_the_radius():
    """Fingerprints and minima of random sets of a similarity just above the bound."""
    rng = np.random.default_rng(11)
    lost = far = 0
    for n in (5, 10, 40, 300):
        for _ in range(400):
            common = rng.integers(0, 2**63, max(1, int(np.ceil(0.8 * n)))).astype(np.uint64)
            extra = rng.integers(0, 2**63, n).astype(np.uint64)
            k = (n - len(common)) // 2
            sets = [np.unique(np.append(common, extra[:k])), np.unique(np.append(common, extra[k : n - len(common)]))]
            assert len(np.intersect1d(*sets)) >= 0.8 * len(np.union1d(*sets))
            bits, mins = neardup.prints(sets)
            far += sum(int(x ^ y).bit_count() for x, y in zip(*bits.tolist(), strict=True)) > neardup.RADIUS
            lost += not (mins[0] == mins[1]).any()
    assert far == 0 and lost == 0


# ---- 4: LM ----


def check_scores(got, want, held):
    for r in got:
        n, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, held(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_lm_small(spark, small):
    held = lambda d: brute.fold(d, 7) == 2
    got = ngrams.op4_lm_scores(spark, SF).collect()
    want = brute.kneser_ney(pairs_of(small), held)
    assert len(got) == len(want)
    check_scores(got, want, held)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("hot", [0, 3, 1 << 22])
def test_lm_awkward_and_untrained(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(ngrams, "BATCH_TOKENS", 500)
    monkeypatch.setattr(ngrams, "HOT_TOKENS", hot)  # 0: every word is spread
    monkeypatch.setattr(ngrams, "layout", lambda docs, text: (5, 3))
    never = lambda d: False
    docs = odd.withColumn("held_out", F.lit(False))
    model = ngrams.train(spark, docs)
    check_scores(ngrams.score(model, docs, keep=("doc_id", "held_out")).collect(), brute.kneser_ney(pairs_of(odd), never), never)
    ngrams.forget(spark, model)
    empty = ngrams.train(spark, docs.limit(0))
    check_scores(ngrams.score(empty, docs, keep=("doc_id", "held_out")).collect(), {d: (len(brute.space_words(t)) + 1, 0, 0, 0.0, 0.0) for d, t in pairs_of(odd)}, never)
    assert ngrams.score(empty, docs.limit(0), keep=("doc_id", "held_out")).count() == 0


def test_lm_opens_few_files_and_misses_none(spark, small, monkeypatch):
    import os

    monkeypatch.setattr(ngrams, "layout", lambda docs, text: (10_000, 1))  # parts far beyond what may be open
    few = spark.createDataFrame(small.limit(20).toPandas()).coalesce(1)
    monkeypatch.setattr(ngrams, "_dealt", lambda rows, parts: rows.select("kind", "part", "bucket", "blob").repartitionById(4, "part").sortWithinPartitions("part", "bucket"))
    model = ngrams.train(spark, few)
    scorer = ngrams.Scorer(model)
    column = few.select("text").toArrow().column("text").combine_chunks()
    h, size = ngrams.tokens(column)
    before = len(os.listdir("/proc/self/fd"))
    logs = scorer(h, size)[1]
    assert len(os.listdir("/proc/self/fd")) - before <= 4 * ngrams.MOST_OPEN + 8 < sum(map(len, model.files.values()))
    want = brute.kneser_ney(pairs_of(few), lambda d: False)
    assert sorted(np.add.reduceat(logs, np.cumsum(size) - size).tolist()) == pytest.approx(sorted(x[4] for x in want.values()))
    from tamis.llm import shared

    os.remove(shared.local_path(f"{model.uri}/before/{min(model.files['before'])}"))
    with pytest.raises(FileNotFoundError):
        ngrams.Scorer(model)(h, size)


# ---- 5: WARC ----


def test_warc_magic_in_payloads(spark):
    inner = warc.record(9, "u", b"inner payload", "0" * 64, None).decode()
    pages = [(5, "http://a\r\nX: y", inner * 3 + "tail"), (2, None, "p" * 150), (7, "b", "p" * 150), (8, "c", "short"), (9, "c", "short"), (10, "d", None), (11, "e", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 200), (None, "n", "p" * 150), (12, "", "WARC/1.1\r\n" * 30)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    from tamis.llm import shared

    manifest = warc.write(spark, frame, shared.scratch(spark, "w"))
    found = warc.candidates(manifest, span=64)
    assert found.count() > len(pages)  # magic inside payloads is a candidate
    got = {r.page_id: r for r in warc.records(warc.chain(found), 3, span=100).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        b = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        if i == 7:
            assert (r.record_type, r.refers_to) == ("revisit", 2)
        elif i is None:
            assert (r.record_type, r.refers_to) == ("revisit", 2)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, b)
    assert warc.records(warc.chain(warc.candidates(warc.write(spark, frame.limit(0), shared.scratch(spark, "w")))), 1).count() == 0


def test_warc_rows_that_share_an_id(spark):
    from tamis.llm import shared

    a, b, c, z = "A" * 120, "B" * 130, "C" * 140, "Z" * 99
    pages = [(3, a), (5, a), (5, b), (7, b), (7, c), (5, c), (9, c), (None, a), (None, "N" * 200), (None, "N" * 200), (3, a), (1, z), (2, z), (4, None)]
    frame = spark.createDataFrame([(i, f"u{k}" * (40_000 if k == 3 else 1), h, 1, "x") for k, (i, h) in enumerate(pages)], "page_id long, url string, html string, id int, digest string").repartition(3)
    manifest = warc.write(spark, frame, shared.scratch(spark, "w"))
    read = warc.records(warc.chain(warc.candidates(manifest, span=1000)), 3, span=500).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {}
    for i, h in pages:
        if h and len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = [(i, sha(h), "revisit", first[h]) if h in first and i != first[h] else (i, sha(h), "response", None) for i, h in pages]
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in read), key=repr) == sorted(want, key=repr)
    # Every payload is in some archive, and every revisit leads to a response that has it.
    held = {(r.page_id, r.payload_digest): bytes(r.payload).decode() for r in read if r.record_type == "response"}
    assert set(held.values()) == {h or "" for _, h in pages}
    assert all((r.refers_to, r.payload_digest) in held for r in read if r.record_type == "revisit")


def test_warc_fails_where_records_are_missing(spark):
    from pyspark.errors import PythonException

    from tamis.llm import shared

    frame = spark.createDataFrame([(i, "u", "p" * (200 + i)) for i in range(9)], "page_id long, url string, html string").repartition(1)
    manifest = warc.write(spark, frame, shared.scratch(spark, "w"))
    name = manifest.first().file
    with shared.open_read(name) as f:
        raw = f.read()
    at = raw.index(warc.MAGIC, len(raw) // 2)
    shared.put_bytes(name, raw[:at] + b"X" + raw[at + 1 :])
    with pytest.raises(PythonException, match="were written"):
        warc.chain(warc.candidates(manifest)).count()


def test_warc_pointer_jumping():
    r = random.Random(1)
    for _ in range(50):
        n = r.randint(1, 40)
        off = sorted(r.sample(range(1, 500), n)) if n else []
        off[0] = 0
        nxt = [r.choice([x for x in off if x > o] + [999]) for o in off]
        want, at = set(), 0
        link = dict(zip(off, nxt, strict=True))
        while at in link:
            want.add(at)
            at = link[at]
        order = list(range(n))
        r.shuffle(order)
        got = warc.reachable(np.array([off[i] for i in order]), np.array([nxt[i] for i in order]))
        assert {off[order[k]] for k in np.flatnonzero(got)} == want


# ---- 6: licenses ----


def test_licenses(spark, odd, small):
    for frame in (odd, small):
        want = {d: brute.base_licenses(t, licenses.BASE) for d, t in pairs_of(frame)}
        for r in licenses.scan(frame).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
    assert licenses.scan(odd.limit(0)).count() == 0


def license_samples():
    """Every template as a text: plain, with its optional parts left out, and with a mandatory word lost."""
    marks = r"<<(begin|end)Optional>>"
    for label, t in licenses.TEMPLATES:
        t = re.sub(r"<<var;words=(\d+)-(\d+)>>", lambda m: " ".join(["Owner"] * int(m[1])), t)
        for optional in (True, False):
            own = re.sub(marks, " ", t) if optional else re.sub(r"<<beginOptional>>(?:(?!<<).)*<<endOptional>>", " ", t, flags=re.S)
            own = re.sub(marks, " ", own)
            words = own.split()
            yield label, f"Copyright (c) 2020 A B\n\n{own.upper()}\nand more text", True
            cut = len(words) * 2 // 3
            yield label, " ".join(words[:cut] + ["changed", "entirely"] + words[cut + 1 :]), None


def test_license_templates(spark, odd, small):
    samples = list(license_samples())
    made = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(samples)], "doc_id long, text string").repartition(2)
    labels_of = lambda r: set(filter(None, r.labels.split(",")))
    for frame in (odd, small, made):
        want = {d: brute.license_labels(t, licenses.TEMPLATES) | set(filter(None, brute.base_licenses(t, licenses.BASE)[4].split(","))) for d, t in pairs_of(frame)}
        for r in licenses.scan(frame).collect():
            assert labels_of(r) == want[r.doc_id] and r.labels == ",".join(sorted(labels_of(r)))
            literal = [s.words for s in r.spans]
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels_of(r)) and (r.spans or r.score in (0, 0.5)) and all(literal)
    got = {r.doc_id: labels_of(r) for r in licenses.scan(made).collect()}
    assert all(label in got[i] for i, (label, _, whole) in enumerate(samples) if whole)
    # Wording that only one license has tells it from its kin.
    full = {label: got[i] for i, (label, _, whole) in enumerate(samples) if whole}
    assert "bsd-2-clause" not in full["bsd-3-clause"] and "bsd-3-clause" not in full["bsd-2-clause"]
    assert "mit" not in full["mit-0"] and "isc" not in full["0bsd"] and "gpl-2.0-or-later" not in full["gpl-3.0-or-later"]


@pytest.mark.parametrize(
    ("text", "ok"),
    [("a b c d e", True), ("a b d e", True), ("a b c e", False), ("a b d x e", False), ("a b c d", False), ("x a b, C! d. E y", True)],
)
def test_license_optional_regions(text, ok):
    a = licenses.Automaton("l", "a b <<beginOptional>> c <<endOptional>> d e")
    w = licenses.hashes_of(text)
    starts = [i for i in range(len(w) - 1) if (w[i : i + 2] == a.head).all()]
    assert any(a.accept(w[i:]) for i in starts) == ok


@pytest.mark.parametrize(("n", "ok"), [(0, False), (1, True), (3, True), (4, False)])
def test_license_replaceable_regions(n, ok):
    a = licenses.Automaton("l", "a b <<var;words=1-3>> z")
    found = a.accept(licenses.hashes_of("a b " + "q " * n + "z"))
    assert bool(found) == ok and (not ok or found == (n + 3, 3))


# ---- 7: quality rules ----


def test_quality_counts(spark, odd, small):
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    for frame in (odd, small):
        want = {d: brute.base_rules(t) for d, t in pairs_of(frame)}
        for r in quality.judge(spark, frame, trusted).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r.doc_id
            assert not (r.base_failed and r.kept)


def test_quality_verdict_and_plan(spark, small):
    trusted = spark.read.parquet(f"{SF}/labels.parquet")
    good = trusted.where("quality = 1").select("doc_id")
    judged = quality.judge(spark, small, good).join(trusted, "doc_id")
    assert judged.where("quality = 1 and not kept and not base_failed").count() == 0
    assert judged.where("quality = 0 and kept").count() <= 1
    plan = quality.judge(spark, small, good)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    kept = quality.keep_good(spark, small, good)
    assert kept.schema == small.schema and kept.count() == quality.judge(spark, small, good).where("kept").count()
    whole = {d for d, in good.collect()}
    ratios = dict(brute.target_ratios(pairs_of(small), whole))
    for r in quality.judge(spark, small, good).collect():
        assert r.llr == pytest.approx(ratios[r.doc_id], abs=1e-12)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    untrusted = quality.judge(spark, small, good.limit(0))
    assert untrusted.where("kept = base_failed or llr <> 0").count() == 0


def test_quality_awkward_rows(spark, odd):
    ids = [0, 3, 6, 9, 9, None, 10_000]
    trusted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    clash = odd.withColumn("words", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("h1", F.lit(2)).withColumn("Trusted_Id", F.lit(3))
    rows_ = clash.union(clash.where("doc_id = 9")).union(clash.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    docs = [(r.doc_id, r.text) for r in rows_.collect()]
    ratios = collections.Counter((d, round(x, 12)) for d, x in brute.target_ratios(docs, set(ids) - {None}))
    assert collections.Counter((r.doc_id, round(r.llr, 12)) for r in quality.judge(spark, rows_, trusted).collect()) == ratios
    kept = quality.keep_good(spark, rows_, trusted)
    assert kept.schema == rows_.schema and kept.count() == quality.judge(spark, rows_, trusted).where("kept").count()
    assert quality.judge(spark, rows_.limit(0), trusted).count() == 0 and quality.keep_good(spark, rows_.limit(0), trusted).count() == 0


# ---- 8: classifier ----


def test_classifier_separates_and_ignores_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in classifier.op8_quality_classifier(spark, base).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    held = [(r.score, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert all(r.held_out == (brute.fold(d, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())
    right = sum((s >= 0.7) == q for s, q in held) / len(held)
    assert right >= 0.95, right


def test_classifier_sums_and_prior(spark):
    """Trained on tables, the model is the one that plain numpy makes of all rows at once."""
    rng = np.random.default_rng(0)
    good = rng.random(1200) < 0.7
    x = rng.normal(0, 1, (1200, classifier.FEATURES))
    x[:, :6] += np.where(good, 1.0, -1.0)[:, None]
    ids = [*range(1100), *[None] * 40, *range(60)]  # nulls and repeated ids
    frame = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in zip(ids, x, strict=True)], "doc_id long, x array<float>").repartition(5)
    named = [i for i in range(1100) if good[i] and i % 2] + [None, 7, 7]
    named = spark.createDataFrame([(i,) for i in named], "doc_id long")
    model = classifier.train(frame, named, doc_id="doc_id", learn=F.col("doc_id").isNull() | (F.col("doc_id") < 1000))
    rows_ = frame.where("doc_id is null or doc_id < 1000").withColumn("half", F.xxhash64("doc_id").bitwiseAND(F.lit(1))).collect()
    v = np.array([r.x for r in rows_])
    half = np.array([r.half for r in rows_])
    trusted_ids = {r.doc_id for r in named.collect()} - {None}
    pos = np.array([r.doc_id in trusted_ids for r in rows_])
    mean, scale = v.mean(axis=0), v.std(axis=0) + 1e-3
    a = classifier.expand(v, mean, scale)
    p, u = ([classifier.Sums.of(a[(half == h) & m]) for h in (0, 1)] for m in (pos, np.ones(len(a), bool)))
    count = lambda w, m: sum(np.bincount(classifier.bin_of(a[(half == h) & m] @ w[1 - h]), minlength=classifier.BINS) for h in (0, 1))
    every = np.ones(len(a), bool)
    first = [classifier.telling(p[h], u[h]) for h in (0, 1)]
    prior = classifier.best_bin_prior(count(first, pos), count(first, every))
    w = [classifier.least_risk(p[h], u[h], prior) for h in (0, 1)]
    assert model.prior == pytest.approx(prior) and abs(prior - 0.7) < 0.1
    assert np.allclose(model.weights, (w[0] + w[1]) / 2, atol=1e-8)
    assert np.allclose(model.shares, classifier.calibration(count(w, pos), count(w, every), prior))
    assert (np.diff(model.shares) >= 0).all() and ((model(x) >= 0.5) == good).mean() > 0.9
    # The risk at the result is no worse than anywhere near, and its negative part was held at zero.
    risk = lambda w: prior * (1 - 2 * p[0].mean @ w + w @ p[0].products @ w) / 4 + max(0.0, (1 + 2 * u[0].mean @ w + w @ u[0].products @ w) / 4 - prior * (1 + 2 * p[0].mean @ w + w @ p[0].products @ w) / 4) + w @ classifier._ridge(p[0].n) @ w / 4
    assert risk(w[0]) < risk(np.zeros(classifier.SIZE)) and all(risk(w[0]) <= risk(w[0] + 0.05 * rng.normal(size=classifier.SIZE)) for _ in range(50))
    for none in (named.limit(0), named.where("doc_id is null")):
        empty = classifier.train(frame, none, doc_id="doc_id", learn=F.lit(True))
        assert (empty(x) == 0.5).all()
    assert classifier.train(frame.limit(0), named, doc_id="doc_id", learn=F.lit(True)).weights is None


def test_classifier_features(odd):
    """Hashed counts against a plain count, for every awkward text at once and alone."""
    from tamis.llm.textbytes import flat

    import pyarrow as pa

    texts = [t for _, t, *_ in awkward()]
    both = classifier.features(*flat(pa.array(texts, pa.string())))
    for t, x in zip(texts, both, strict=True):
        alone = classifier.features(*flat(pa.array([t], pa.string())))[0]
        assert np.allclose(alone, x)
        raw = brute.lower_ascii(t).encode()
        grams = collections.Counter(raw[i : i + 3] for i in range(len(raw) - 2))
        assert (alone[classifier.SHAPE + classifier.WORDS :] ** 2).sum() == pytest.approx(1.0 if grams else 0.0)
        words = collections.Counter(brute.space_words(t))
        assert (alone[classifier.SHAPE : classifier.SHAPE + classifier.WORDS] ** 2).sum() == pytest.approx(1.0 if words else 0.0)
        if len(words) == 1:
            assert alone[classifier.SHAPE : classifier.SHAPE + classifier.WORDS].max() == pytest.approx(1.0)


def test_classifier_awkward_rows(spark, odd, monkeypatch, tmp_path):
    more = odd.withColumn("x", F.lit(1)).withColumn("good", F.lit("c")).withColumn("score", F.lit(0.1))
    rows_ = more.union(more.where("doc_id = 9")).union(more.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    for docs, n in ((rows_, rows_.count()), (rows_.limit(0), 0)):
        folder = f"{tmp_path}/{n}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in (0, 3, 6, 9, 9, None, 40)] + [(12, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = classifier.op8_quality_classifier(spark, folder).collect()
        assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        of = collections.defaultdict(set)
        for r in got:
            of[r.doc_id].add(r.score)
        assert all(len(x) == 1 for x in of.values())
        if n:
            # The row whose id was taken away has the text of document 6, and its score.
            assert of[None] == of[6]


# ---- 9: mixing ----


def test_rake_meets_margins():
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, k, 200) for k in (5, 4, 3)]
    tokens = rng.integers(1, 10_000, 200).astype(float)
    wants = [np.full(k, 1 / k) for k in (5, 4, 3)]
    w = mixing.rake(tokens, codes, wants, rounds=500)
    for c, want in zip(codes, wants, strict=True):
        assert np.allclose(np.bincount(c, tokens * w) / tokens.sum(), want, atol=1e-6)
    for share in (0.05, 0.5, 0.95):
        r = mixing.sampling_rate(tokens, w, share * tokens.sum())
        assert (tokens * np.minimum(1, r * w)).sum() == pytest.approx(share * tokens.sum())


def check_mix(got, want):
    key = lambda r: repr((r[0] is None, r[0], r[1], r[4], r[7]))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (g[:5], g[7]) == (w[:5], w[7])
        assert g[5:7] == pytest.approx(w[5:7], rel=1e-7, abs=1e-9)


MIXED = ("id", "tokens", "source", "lang", "topic", "probability", "weight", "kept")


def test_mix_query(spark, small):
    want = brute.mixed([(r.doc_id, r.text, r.source, r.lang) for r in small.collect()])
    got = mixing.op9_mixing(spark, SF)
    check_mix([tuple(r) for r in got.select("doc_id", *MIXED[1:]).collect()], want)
    tokens = sum(w[1] for w in want)
    assert sum(w[1] * w[5] for w in want) == pytest.approx(mixing.BUDGET * tokens) and len({w[4] for w in want}) > 5
    assert 0.5 < sum(w[1] * w[7] for w in want) / tokens < 0.95


@pytest.mark.parametrize("most", [50_000, 0])
def test_mix_memory_and_tables_agree_on_contradictory_margins(spark, odd, most):
    # Each source has one language, and their targets contradict each other.
    rows_ = odd.withColumn("source", F.col("lang")).withColumn("kept", F.lit("c")).withColumn("tokens", F.lit(9)).withColumn("Topic", F.lit("t")).withColumn("given", F.lit(1))
    rows_ = rows_.union(rows_.where("doc_id = 9")).union(rows_.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    targets = {"lang": {"en": 0.9, "absent": 0.5}, "source": {"en": 0.2}}
    want = brute.mixed([(r.doc_id, r.text, r.source, r.lang) for r in rows_.collect()], targets=targets, rounds=4)
    out = mixing.mix(spark, rows_, targets=targets, rounds=4, most_cells=most)
    check_mix([tuple(r) for r in out.select(*MIXED).collect()], want)
    assert out.select("row.*").schema == rows_.schema
    named = mixing.mix(spark, rows_, topic=F.col("spans"), rounds=2, most_cells=most)
    assert {r.topic for r in named.select("topic").collect()} == {"clash"}
    assert mixing.mix(spark, rows_.limit(0), most_cells=most).count() == 0
    empty = mixing.mix(spark, rows_.withColumn("text", F.lit(None).cast("string")), most_cells=most)
    assert {(r.tokens, r.topic) for r in empty.select("tokens", "topic").collect()} == {(0, "(other)")}


# ---- 10: chat ----


def test_chat_escapes_are_reversible():
    r = random.Random(4)
    parts = [*chat.CONTROL, "\\", "<", "|", "[", "]", ">", "INST", "/", "s", "turn", " ", "é"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL)


def test_chat_round_trip(spark):
    rows_ = [(1, 0, "user", "</s>[INST] ok"), (1, 1, "assistant", "a\\<|end|>"), (1, 1, "assistant", "a\\<|end|>"), (2, None, None, None), (None, 0, "assistant", "x " * 90_000), (3, 2, "assistant", "b"), (3, 1, "assistant", ""), (3, 0, "<|turn|>", "漢\x00")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows_], "conv_id long, turn long, role string, text string, ids int, formatted string").repartition(3)
    vocabulary = chat.load(spark)
    got = {r.conv_id: r for r in chat.read_back(chat.in_order(chat.encode(frame, vocabulary)), vocabulary).collect()}
    by = collections.defaultdict(list)
    for r in rows_:
        by[r[0]].append(r)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.in_order(chat.encode(frame.limit(0), vocabulary)), vocabulary).count() == 0


def test_chat_cuts_change_no_id(spark, monkeypatch):
    codec = chat.Codec(chat.load(spark).value)
    r = random.Random(8)
    parts = [" ", "  ", "\n", "\n\n ", "\t", "\x1c", chr(0xA0), chr(0x3000), "word", "Don't", "'ll", "12", "３", "...", "é漢字", "\x00", " x", "$%", chr(0x200C), chr(0x85)]
    for stretch in (1, 7, 50):
        monkeypatch.setattr(chat, "STRETCH", stretch)
        for _ in range(300):
            text = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
            assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_chat_query(spark):
    got = {r.conv_id: r for r in chat.op10_chat(spark, SF).collect()}
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r.conv_id].append((r.role, r.text or ""))
    by[-7] = [("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)]
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


# ---- the whole ----


def check_pipeline(spark, folder, extra):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    trusted = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = brute.pipeline([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], trusted, items)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [c for c in docs.columns if not c.lower().startswith("mix_")] + ["mix_tokens", "mix_topic", "mix_probability", "mix_weight"]
    got = [(r.doc_id, r.mix_tokens, r.source or "(none)", r.lang or "(none)", r.mix_topic, r.mix_probability, r.mix_weight, True, r.text, r.n_chars) for r in out.collect()]
    key = lambda r: repr((r[0], r[8]))
    assert len(got) == len(want) and len(got) >= extra
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (g[:5], g[8]) == (w[:5], w[8]) and g[5:7] == pytest.approx(w[5:7], rel=1e-7) and g[9] == len(g[8])
    return out


def test_pipeline_against_brute_force(spark):
    check_pipeline(spark, SF, 50)


def test_pipeline_awkward_rows(spark, odd, tmp_path):
    texts = [passage(s, 90) for s in range(30, 60)]
    item = " ".join(passage(77, 30).split())
    rows_ = [(100 + i, t, "en", f"s{i % 3}", len(t), "c", "c", "c") for i, t in enumerate(texts)]
    rows_ += [(200, texts[0] + " more words", "en", None, 1, "c", "c", "c"), (201, passage(90, 50) + " " + texts[1] + " " + passage(91, 50), None, "s1", 1, "c", "c", "c")]
    rows_ += [(202, passage(92, 60) + ". " + item + "! " + passage(93, 60), "en", "s2", 1, "c", "c", "c"), (203, item, "en", "s2", 1, "c", "c", "c")]
    rows_ += [(None, texts[2], "en", "s1", 1, "c", "c", "c"), (None, passage(94, 80), "fr", "s1", 1, "c", "c", "c"), (103, passage(95, 80), "fr", "s1", 1, "c", "c", "c"), (104, texts[4], "en", "s1", len(texts[4]), "c", "c", "c")]
    every = odd.union(spark.createDataFrame(rows_, SCHEMA)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    for clash in ("Mix_Tokens", "text_place", "row_number", "repeated_spans", "loser", "words", "kept", "doc", "id", "first", "topic", "rate", "trusted_id"):
        every = every.withColumn(clash, F.lit("c"))
    labels = spark.createDataFrame([(d, 1, 0) for d in [*range(100, 130), None, 9, 9]] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")
    for name, docs in (("some", every), ("none", every.limit(0))):
        docs.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        check_pipeline(spark, f"{tmp_path}/{name}", 15 if name == "some" else 0)


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix-array", "benchmark", "mixing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(small.columns)] == small.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids)) and len(ids) < small.count()
    kept = pairs_of(out)
    assert not any(w[3] for w in brute.contamination(kept, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]))
    assert all(w[2] == 0 for w in brute.repeats(kept) if w[1])


@pytest.mark.parametrize(("k", "chunk"), [(1, 1), (1, 1 << 14), (2, 7), (2, 1 << 14)])
def test_bitslice_pairs(monkeypatch, k, chunk):
    from tamis.llm import bitslice

    monkeypatch.setattr(bitslice, "CHUNK", chunk)
    rng = np.random.default_rng(k)
    for _ in range(20):
        n = int(rng.integers(2, 300))
        v = rng.integers(0, 2**64, size=(5, k), dtype=np.uint64)[rng.integers(0, 5, n)]
        for _ in range(4):
            v = v ^ np.where(rng.random((n, k)) < 0.7, np.uint64(1) << rng.integers(0, 64, (n, k)).astype(np.uint64), np.uint64(0))
        g = np.sort(rng.integers(0, rng.integers(1, 6), n))
        radius = int(rng.integers(0, 9))
        apart = lambda i, j: sum(int(a ^ b).bit_count() for a, b in zip(v[i].tolist(), v[j].tolist(), strict=True))
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if g[i] == g[j] and apart(i, j) <= radius}
        values = v if k > 1 else v.ravel()
        got = [(int(a), int(b)) for x, y in bitslice.pairs(values, g, radius) for a, b in zip(x, y, strict=True)]
        assert len(got) == len(want) and set(got) == want
        sets = brute.Sets(range(n))
        for i, j in want:
            sets.join(i, j)
        assert bitslice.forest(values, g, radius).tolist() == [sets.find(i) for i in range(n)]


def test_fm_index_counts_and_places():
    from tamis.llm.fmindex import FMIndex

    rng = np.random.default_rng(1)
    for _ in range(25):
        sigma = int(rng.integers(2, 9))
        text = rng.integers(0, sigma, int(rng.integers(1, 400)))
        index = FMIndex(text, sigma)
        phrases = rng.integers(1, sigma, (30, 4)) if sigma > 1 else np.ones((30, 4), int)
        lengths = rng.integers(1, 5, 30)
        low, high = index.search(phrases, lengths)
        for p, k, a, b in zip(phrases, lengths, low, high, strict=True):
            want = {i for i in range(len(text) - k + 1) if (text[i : i + k] == p[4 - k :]).all()}
            assert set(index.locate(np.arange(a, b)).tolist()) == want


def test_types_of_digest_columns(spark):
    want = {"n_words": S.LongType(), "n_hit": S.LongType(), "n_items": S.LongType(), "contaminated": S.BooleanType()}
    schema = decontaminate.op1_decontaminate(spark, SF).schema
    assert all(schema[k].dataType == t for k, t in want.items())
