from tamis.functions.dialog import choose_policy, choose_source, yes_or_no
from tamis.plans.answering import ask, ingest
from tamis.sources import store
from tamis.streaming.ingest import watch


def test_dialog():
    assert [yes_or_no(x) for x in (" YES ", "آري", "بله", "نه", "ok", "")] == [True, True, True, False, None, None]
    assert [choose_policy(x, "open") for x in ("", "strict", "2", "۱", "سخت‌گیرانه", "آزاد", "other")] == ["open", "strict", "open", "strict", "strict", "open", None]
    assert [choose_source(x) for x in ("فایل محلي", "2", "URL", "")] == ["file", "url", "url", None]


def test_ingest_and_ask(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    docs = lambda *x: spark.createDataFrame(list(x), "title string, content string, source_id string")
    ingest(spark, path, docs(("Foxes", "the red fox jumps over the fence. it sleeps at noon", "u"), ("Whales", "blue whales swim", "v")))
    ingest(spark, path, docs(("", "", "u")))  # nothing to store: the old rows stay
    chunks = store.read_scope(spark, path)
    assert {r.scope for r in chunks.collect()} == {"u", "v"}
    q = spark.createDataFrame([(0, "u", "where does the red fox jump", "strict"), (1, "u", "zebra", "strict"), (2, "u", "zebra", "open")], "question_id long, scope string, question string, policy string")
    a = {r.question_id: r.answer for r in ask(spark, q, chunks, threshold=2.0).collect()}
    assert "fox" in a[0].lower() and a[1] != a[0] and set(a) == {0, 1, 2}


def test_watch(spark, tmp_path):
    folder, path = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    for n in range(2):
        (folder / f"doc_{n}.txt").write_text(f"text number {n} about foxes")
        watch(spark, f"file://{folder}", path, f"file://{tmp_path}/state", until_empty=True).awaitTermination(60)
        assert store.read_scope(spark, path).select("scope").distinct().count() == n + 1
