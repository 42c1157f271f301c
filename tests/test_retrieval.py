import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import chunking, dense, embed, evaluate, fusion, lexical, policy

TEXTS = ["red fox jumps over fence", "red red lazy dog sleeps", "blue whale swims deep", "quiet river", "red fox jumps over fence"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("u", i, t) for i, t in enumerate(TEXTS)] + [("v", 0, "red whale")], "scope string, ord long, text string")


def asked(spark, *questions, scope="u"):
    return spark.createDataFrame([(i, scope, t) for i, t in enumerate(questions)], "question_id long, scope string, question string")


def plain_bm25(texts, question):
    docs = [t.split() for t in texts]
    n, average = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        s = 0.0
        for w in question.split():
            df = sum(w in x for x in docs)
            if df:
                tf = d.count(w)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / average))
        out.append(s)
    return out


def test_scores(spark, chunks):
    q = "red fox fox unknown"
    got = {r.ord: r.score for r in lexical.scores(lexical.index(chunks), asked(spark, q)).collect()}
    for i, s in enumerate(plain_bm25(TEXTS, q)):
        assert got.get(i, 0) == pytest.approx(s)


def test_coverage_bounds_and_unknown_words(spark, chunks):
    got = {(r.question_id, r.ord): r.coverage for r in lexical.coverage(lexical.index(chunks), asked(spark, "red fox", "red zebra", "zebra")).collect()}
    assert got[0, 0] == pytest.approx(1) and 0 < got[1, 0] < 0.5 and not any(k[0] == 2 for k in got)


def test_endorsements_are_distinct_texts(spark, chunks):
    got = lexical.endorsements(lexical.index(chunks), asked(spark, "red fox fence")).collect()
    assert [r.ord for r in got if r.text == TEXTS[0]] == [0]
    assert lexical.endorsements(lexical.index(chunks, most_chunks=4), asked(spark, "red")).count() == 0


@pytest.mark.parametrize("vectors", [[[1.0, 0.0], [1.0, 0.0]], [[1.0, 0.0], [0.0, 0.0]], [[1.0, 2.0], [-1.0, -2.0]]])
def test_cosine_distance(spark, vectors):
    a, b = map(np.array, vectors)
    want = 1.0 if not a.any() or not b.any() else 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    got = spark.createDataFrame([tuple(vectors)], "a array<double>, b array<double>").select(dense.cosine_distance(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(want)


def test_topk_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 3}", i, "", rng.normal(size=8).tolist() if i != 4 else [0.0] * 8) for i in range(60)]
    c = spark.createDataFrame(rows, "scope string, ord long, text string, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, f"s{i % 3}", rng.normal(size=8).tolist()) for i in range(9)], "question_id long, scope string, vector array<double>")
    monkeypatch.setattr(dense, "BLOCK", 4)
    one = sorted((r.question_id, r.ord, round(r.distance, 9)) for r in dense.topk(spark, q, c, 4).collect())
    two = sorted((r.question_id, r.ord, round(r.distance, 9)) for r in dense.topk_by_join(q, c, 4).collect())
    assert one == two and len(one) == 36
    assert dense.topk(spark, q.limit(0), c, 4).count() == 0


@pytest.fixture(scope="module")
def hybrid(spark, chunks):
    return embed.embed(chunks, "text")


def test_guard_and_rescue(spark, hybrid):
    q = embed.embed(asked(spark, "red fox jumps", "zebra crossing", "و در به"), "question")
    c = fusion.retrieve(spark, q, hybrid, threshold=2.0).collect()
    assert all(not r.kept for r in c if r.question_id == 1)  # nothing covers it
    assert any(r.kept for r in c if r.question_id == 2)  # no content word: the guard is silent
    assert any(r.source == "both" and r.kept for r in c if r.question_id == 0)
    off = fusion.retrieve(spark, q, hybrid, threshold=2.0, guard_floor=-1).collect()
    assert any(r.kept for r in off if r.question_id == 1)
    strict = fusion.retrieve(spark, q, hybrid, threshold=-1.0).collect()
    assert {r.source for r in strict if r.kept and r.question_id == 0} <= {"both", "lexical"}
    assert len(strict) >= 6  # rejected candidates are still reported


def test_scopes_are_apart(spark, hybrid):
    q = embed.embed(asked(spark, "red whale", scope="v"), "question")
    assert {r.scope for r in fusion.retrieve(spark, q, hybrid).collect()} == {"v"}
    assert {r.scope for r in fusion.retrieve(spark, q, hybrid, scoped=False, pool=6).collect()} == {"u", "v"}


def test_budget_alternates(spark):
    r = random.Random(3)
    rows, want = [], {}
    for qid in range(40):
        d = sorted(r.random() for _ in range(r.randint(0, 6)))
        s = sorted((r.random() for _ in range(r.randint(0, 6))), reverse=True)
        size = 4
        a, b, out = list(enumerate(d)), [(100 + i, x) for i, x in enumerate(s)], []
        turn = 0
        while (a or b) and len(out) < size:
            queue = (a or b) if turn == 0 else (b or a)
            out.append(queue.pop(0)[0])
            turn = 1 - turn
        want[qid] = set(out)
        rows += [(qid, "u", i, "t", x, True, "dense", 0.0) for i, x in enumerate(d)] + [(qid, "u", 100 + i, "t", 0.5, True, "lexical", x) for i, x in enumerate(s)]
        rows.append((qid, "u", 999, "t", 0.0, False, "dense", 0.0))
    c = spark.createDataFrame(rows, "question_id long, scope string, ord long, text string, distance double, kept boolean, source string, lexical_score double")
    got = {k: set() for k in want}
    for x in fusion.budget(c, 4).where("in_prompt").collect():
        got[x.question_id].add(x.ord)
    assert got == want


def test_chunks(spark):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) + "." for i in range(12))
    got = chunking.split_text(text)
    assert all(c in text and c.strip() == c and chunking.words(c) <= 120 for c in got)
    assert set(" ".join(got).split()) == set(text.split())
    assert chunking.split_text(" \n ") == []
    # By characters no chunk is longer than the limit, whatever the words; all text survives.
    for size in (1, 10, 64):
        long = "short " + "x" * 500 + " tail. " + "é" * 33
        cut = chunking.split_text(long, size, 0, len)
        assert all(len(c) <= size and c in long for c in cut) and "".join(cut).replace(" ", "") == long.replace(" ", "")
    assert chunking.BREAKS.index("؟ ") < chunking.BREAKS.index("! ")
    docs = spark.createDataFrame([("u", "The title", "some text here"), (None, "", ""), ("w", "only", ""), ("x", "same", "same")], "url string, title string, content string")
    rows = {(r.scope, r.ord): r.text for r in chunking.chunk(docs).collect()}
    assert rows == {("u", 0): "The title", ("u", 1): "some text here", ("w", 0): "only", ("x", 0): "same"}
    assert [r.chunk_id for r in chunking.chunk(docs).orderBy("chunk_id").collect()] == [r.chunk_id for r in chunking.chunk(docs).orderBy("chunk_id").collect()]
    new = chunking.replace_scopes(chunking.chunk(docs), chunking.chunk(docs.where("url = 'u'")).withColumn("text", F.lit("new")))
    assert sorted(r.text for r in new.collect()) == ["new", "new", "only", "same"]


def test_policies(spark):
    with pytest.raises(ValueError):
        policy.resolve("other")
    q = spark.createDataFrame([(0, "raw  يQ {context}?", "strict"), (1, "b", "strict"), (2, "c", "open")], "question_id long, question string, policy string")
    texts = spark.createDataFrame([(0, ["p1 {question}", "p2"])], "question_id long, texts array<string>")
    p = {r.question_id: r.prompt for r in policy.prompts(spark, q, texts).collect()}
    assert "p1 {question}\n\np2" in p[0] and "raw  يQ {context}?" in p[0] and p[1] is None and "c" in p[2]
    a = {r.question_id: r.answer for r in policy.answers(policy.prompts(spark, q, texts), lambda x: ("", "length")).collect()}
    assert a[1] == policy.NO_CONTEXT and a[0] == policy.EMPTY_BY_LENGTH


def test_evaluation(spark):
    c = spark.createDataFrame(
        [(0, "has key", 0.1, True, True), (1, "has key", 0.9, False, False), (2, "none", 0.2, True, True), (3, "has key", 0.3, True, False)],
        "question_id long, text string, distance double, kept boolean, in_prompt boolean",
    )
    keys = spark.createDataFrame([(i, "key") for i in range(5)], "question_id long, answer_key string")
    rows = {r.question_id: (r.hit, r.trimmed, r.cause) for r in evaluate.judged(c, keys).collect()}
    assert rows == {0: (True, False, None), 1: (False, False, "gate"), 2: (False, False, "rank"), 3: (True, True, None), 4: (False, False, "rank")}
    r = evaluate.recall(evaluate.judged(c, keys)).first()
    assert (r.hits, r.trimmed, r.missed_by_gate, r.missed_by_rank) == (2, 1, 1, 2)
    assert evaluate.false_admits(c, keys).first().false_admits == 3
    a = spark.createDataFrame([(0, "?"), (1, "the key"), (2, "?"), (3, "key, not from the document")], "question_id long, answer string")
    assert {x.outcome: x.answers for x in evaluate.answer_faults(a, evaluate.judged(c, keys), keys, "not from").collect()} == {"correct": 1, "ungrounded": 1, "retrieval": 1, "generation": 1}


def test_sweep_runs_retrieval_anew(spark, hybrid):
    q = embed.embed(asked(spark, "red fox jumps", "blue whale", "zebra"), "question")
    keys = spark.createDataFrame([(0, "fox"), (1, "whale"), (2, "zebra")], "question_id long, answer_key string")
    settings = [{}, {"threshold": -1.0, "coverage": 2.0}, {"budget": 0}, {"threshold": 2.0, "dense_coverage": -1.0, "pool": 1}]
    got = evaluate.sweep(lambda x, **given: fusion.retrieve(spark, x, hybrid, **given), {"all": (q, keys)}, settings).collect()
    for given, r in zip(settings, got, strict=True):
        found = fusion.retrieve(spark, q, hybrid, **{evaluate.SETTINGS[k]: v for k, v in given.items()})
        want = evaluate.recall(evaluate.judged(found, keys)).first()
        assert (r.questions, r.hits, r.trimmed, r.threshold) == (want.questions, want.hits, want.trimmed, given.get("threshold"))
    assert got[0].hits == 2 and got[1].hits == 0 and got[2].trimmed == 2


def test_unrelated_questions_are_put_to_every_document(spark, hybrid):
    q = embed.embed(asked(spark, "zebra crossing", "red whale"), "question")
    put = evaluate.in_every_scope(q, hybrid)
    r = evaluate.false_admits(fusion.retrieve(spark, put, hybrid, threshold=2.0), put).first()
    assert (r.questions, r.false_admits) == (4, 2)


def test_unknown_policies_are_errors(spark):
    from pyspark.errors import PySparkException

    q = spark.createDataFrame([(0, "a", "strict"), (1, "b", "other")], "question_id long, question string, policy string")
    with pytest.raises(PySparkException, match="unknown policy other"):
        policy.prompts(spark, q, spark.createDataFrame([], "question_id long, texts array<string>")).collect()


def test_bm25_queries_count_large_scopes(spark, tmp_path):
    from tamis.queries import QUERIES

    # 2,001 documents in one source: statistics, scores and coverage have no bound on a scope.
    spark.range(2001).selectExpr("id AS doc_id", "concat('alpha beta', CAST(id % 7 AS STRING)) AS text", "'src0' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT 0L AS item_id, 'alpha gamma' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.token: r.df for r in QUERIES["bm25_idf"](spark, str(tmp_path)).collect()}["alpha"] == 2001
    assert QUERIES["bm25_scores"](spark, str(tmp_path)).count() == 2001
    assert QUERIES["bm25_coverage"](spark, str(tmp_path)).count() == 2001
