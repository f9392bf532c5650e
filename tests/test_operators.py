import json

import pytest
from pyspark.sql import functions as F

from folio.functions import conversation as C
from folio.operators import chunking, evaluation, ranking
from folio.plans import retrieval
from folio.functions import text
from folio.providers import Lazy, Retry, hash_embedding, route_pages, warm_up, with_fallback
from folio.sources import store
from folio.streaming import ingest

PAGE = "document_id string, page int, landscape boolean, blocks array<string>, lines array<array<string>>"


def test_repacking_repeats_the_overlap_and_one_pass_does_not(spark):
    a, b = " ".join(["Aa"] * 99) + " end.", " ".join(["Bb"] * 99) + " end."
    pages = spark.createDataFrame([("d", 1, False, [a, b], None)], PAGE)
    once = [r["text"] for r in chunking.prose_chunks(pages).orderBy("chunk_index").collect()]
    again = [r["text"] for r in chunking.prose_chunks_repacked(pages).orderBy("chunk_index").collect()]
    assert once == [a, f"{a} {b}"]
    assert again == [a, a, f"{a} {b}"]


def test_trailing_divider_has_no_chunk_and_override_wins(spark):
    pages = spark.createDataFrame([("d", 1, True, ["Questions?"], None)], PAGE)
    assert chunking.chunk(pages).count() == 0
    assert chunking.chunk(pages, "prose").first()["document_type"] == "prose"


def test_bm25_pads_with_zero_scores(spark):
    chunks = spark.createDataFrame([("d", i, t) for i, t in enumerate(["cat", "dog", "", "cat cat dog"])], "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "!"), (3, "zebra")], "query_id int, text string")
    got = {}
    for r in ranking.bm25(q, chunks, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_index"], r["score"] > 0))
    assert got == {1: [(0, True), (3, True), (1, False)], 3: [(0, False), (1, False), (2, False)]}


def test_fusion_arithmetic_and_ties(spark):
    row = lambda ids: spark.createDataFrame([(1, "d", c, r + 1) for r, c in enumerate(ids)], "query_id int, document_id string, chunk_index int, rank int")
    got = ranking.fuse([row([1, 2]), row([3, 1])]).orderBy("rank").collect()
    assert [r["chunk_index"] for r in got] == [1, 3, 2]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_metrics_without_gold_are_zero(spark):
    none = spark.createDataFrame([], "query_id int, document_id string, chunk_index int")
    r = spark.createDataFrame([(1, "d", 0, 1)], "query_id int, document_id string, chunk_index int, rank int")
    m = evaluation.ranking_metrics(r, none, spark.createDataFrame([(1,)], "query_id int")).first().asDict()
    assert all(v == 0 for k, v in m.items() if k != "query_id")
    both = retrieval.evaluate({"a": r, "b": r}, r.select("query_id", "document_id", "chunk_index"), spark.createDataFrame([(1,)], "query_id int"))
    assert {x["mrr"] for x in both.collect()} == {1.0}
    assert evaluation.side_by_side(both, ["a", "b"]).count() == 6


def test_evidence_split_across_chunks(spark):
    chunks = spark.createDataFrame([("d", 0, "the cat sat on the"), ("d", 1, "mat and slept all day long")], "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([(1, "sat on the mat and slept all"), (2, "never said"), (3, "cat sat")], "query_id int, phrase string")
    assert {(r["query_id"], r["verdict"]) for r in evaluation.evidence_coverage(q, chunks).collect()} == {(1, "split across chunks"), (2, "missing from extraction")}


def test_evidence_is_found_across_differing_word_breaks(spark):
    phrase = "Weights are renormalized by email in the US and we don't define fine print for any of the remaining layers"
    breaks = {"renormalized": "renorm-\nalized", "email": "e-mail", "US": "U.S.", "don't": "dont", "fine print": "\ufb01ne print"}
    texts = [phrase, *(phrase.replace(a, b) for a, b in breaks.items())]
    texts = ["x" * k + " " + t for k, t in enumerate(texts)]
    # words joined everywhere, so that no run of words is left as it was; and one letter missing
    texts += [phrase.replace(" ", ""), phrase.replace(" ", "-\n"), phrase.replace("remaining", "remainin")]
    chunks = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([(1, phrase), (2, phrase.replace("fine", "\ufb01ne"))], "query_id int, phrase string")
    got = {(r["query_id"], r["chunk_index"]) for r in evaluation.relevant_chunks(q, chunks).collect()}
    assert got == {(n, i) for n in (1, 2) for i in range(len(texts) - 1)}
    assert [r["query_id"] for r in evaluation.evidence_coverage(q, chunks.filter(f"chunk_index >= {len(texts) - 3}")).collect()] == []


def test_store_appends_scans_and_looks_up(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "document_id string, chunk_index int, text string")
    s.add(rows)
    s.add(spark.createDataFrame([(f"d{i}", 0, "w") for i in range(600)], "document_id string, chunk_index int, text string"))
    assert len([f for f in (tmp_path / "pdf_documents").iterdir() if f.name.startswith("bucket=")]) <= 256
    assert s.scan("a").columns == ["document_id", "chunk_index", "text"]
    assert s.scan("a").count() == 2 and "PartitionFilters: [isnotnull(bucket" in s.scan("a")._jdf.queryExecution().toString()
    with store.isolated(spark) as own:
        own.add(rows)
        assert own.scan("b").count() == 1
    with pytest.raises(Exception):
        own.scan("b")
    assert [r["text"] for r in s.get(spark.createDataFrame([("b", 0), ("b", 9)], "document_id string, chunk_index int")).collect()] == ["z"]
    store.report(rows.withColumn("context", F.lit("c")), f"file://{tmp_path}/report")
    assert "context" not in spark.read.json(f"file://{tmp_path}/report").columns


def test_config_falls_back():
    c = store.Config.from_env({"MAX_UPLOAD_SIZE_BYTES": "x", "MAX_PDF_PAGES": "-1", "OCR_ENABLED": " No "})
    assert (c.max_bytes, c.max_pages, c.ocr) == (20 * 1024 * 1024, 300, False)


def test_status(spark):
    e = spark.createDataFrame([("a", 1, "processing", None, 10), ("a", 2, "failed", None, 60), ("b", 1, "ready", None, 100)], "document_id string, seq int, status string, reason string, progress int")
    got = {r["document_id"]: (r["status_code"], r["status"], r["reason"], r["progress"]) for r in ingest.status(spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string"), e).collect()}
    assert got == {"a": (200, "failed", ingest.GENERIC_REASON, None), "b": (200, "ready", None, 100), "c": (404, None, None, None)}


def test_answer_events_and_error_detail(spark):
    a = spark.createDataFrame([(1, "[]", ["Hi", "", " all"], None), (2, "[]", [], None), (3, "[]", ["x"], "down")], "request_id int, sources string, deltas array<string>, error string")
    got = {}
    for r in ingest.answer_events(a).orderBy("request_id", "seq").collect():
        got.setdefault(r["request_id"], []).append((r["event"], json.loads(r["data"])))
    assert [e for e, _ in got[1]] == ["sources", "token", "token", "done"] and got[1][-1][1] == {"answer": "Hi all"}
    assert got[2][-1] == ("done", {"answer": C.REFUSAL}) and got[3][-1] == ("error", {"detail": "down"})
    b = spark.createDataFrame([('{"detail": "no"}',), ('{"detail": [1]}',), ("not json",)], "body string")
    assert [r[0] for r in b.select(ingest.error_detail(F.col("body"), F.lit("?"))).collect()] == ["no", "?", "?"]


def test_stream_of_pages_is_chunked_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"document_id": "d", "page": 1, "landscape": False, "blocks": ["One sentence. Two."], "lines": None}) + "\n")
    for _ in range(2):
        ingest.stream_pages(spark, str(tmp_path / "in"), PAGE, str(tmp_path / "out"), str(tmp_path / "cp"), chunking.prose_chunks).awaitTermination(60)
    assert [r["text"] for r in ingest.read_chunks(spark, str(tmp_path / "out")).collect()] == ["One sentence. Two."]
    # a page that comes later is chunked with the document's others
    (tmp_path / "in" / "b.json").write_text("\n".join(json.dumps({"document_id": i, "page": 2, "landscape": False, "blocks": ["Three."], "lines": None}) for i in "de") + "\n")
    ingest.stream_pages(spark, str(tmp_path / "in"), PAGE, str(tmp_path / "out"), str(tmp_path / "cp"), chunking.prose_chunks).awaitTermination(60)
    assert sorted((r["document_id"], r["chunk_index"], r["text"]) for r in ingest.read_chunks(spark, str(tmp_path / "out")).collect()) == [("d", 0, "One sentence. Two. Three."), ("e", 0, "Three.")]


def test_retry_and_fallback():
    waits, calls = [], []

    def f():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError
        return "ok"

    assert Retry().call(f, lambda e: ("connection", False), waits.append) == "ok" and waits == [2.0, 4.0, 8.0]
    with pytest.raises(ConnectionError):
        Retry().call(lambda: (_ for _ in ()).throw(ConnectionError()), lambda e: ("rate_limit", True), waits.append)
    assert with_fallback(lambda: 1 / 0, lambda: "slow")() == "slow"


def test_answer_messages_keep_history(spark):
    h = F.array(F.struct(F.lit("user").alias("role"), F.lit("q1").alias("content")))
    m = spark.range(1).select(C.answer_messages(F.lit("s"), h, F.lit("ctx"), F.lit("q2"))).first()[0]
    assert [x["role"] for x in m] == ["system", "user", "user"] and "<document_context>\nctx\n</document_context>" in m[2]["content"]


def test_index_answers_as_texts_do_and_is_made_once_for_each_version(spark, tmp_path):
    chunks = spark.createDataFrame([("d", i, t) for i, t in enumerate(["cat", "dog", "", "cat cat dog"])] + [("e", 0, "cat")], "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "zebra dog")], "query_id int, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = ranking.Index(chunks, f"file://{tmp_path}", "1")
    assert rows(index.bm25(q, 3)) == rows(ranking.bm25(q, chunks, 3))
    more = chunks.unionByName(spark.createDataFrame([("e", 1, "dog")], chunks.schema))
    assert rows(ranking.Index(more, f"file://{tmp_path}", "1").bm25(q, 3)) == rows(ranking.bm25(q, chunks, 3))
    assert rows(ranking.Index(more, f"file://{tmp_path}", "2").bm25(q, 3)) == rows(ranking.bm25(q, more, 3))


def test_fused_rows_carry_the_later_list(spark):
    row = lambda c, p: spark.createDataFrame([(1, "d", c, 1, p)], "query_id int, document_id string, chunk_index int, rank int, page string")
    got = {r["chunk_index"]: r["page"] for r in ranking.fuse([row(1, "a"), row(1, "b").unionByName(row(2, "c"))], payload=("page",)).collect()}
    assert got == {1: "b", 2: "c"}


def test_routing_only_where_enabled_and_available(spark):
    pages = spark.createDataFrame([("d", 1, ["x"]), ("d", 2, []), ("d", 3, None)], "document_id string, page int, blocks array<string>")
    seen = lambda p: p.withColumns({"blocks": F.when(F.col("page") == 2, F.array(F.lit("seen"))).otherwise(F.array().cast("array<string>")), "ocr_confidence": F.lit(0.95)})
    assert sorted((r["page"], r["ocr"], r["ocr_confidence"]) for r in route_pages(pages, seen).collect()) == [(1, False, None), (2, True, 0.95)]
    asked = []
    assert [r["page"] for r in route_pages(pages, seen, enabled=False, available=lambda: asked.append(1)).collect()] == [1] and not asked
    assert [r["page"] for r in route_pages(pages, seen, available=Lazy(lambda: 1 / 0).available).collect()] == [1]


def test_lazy_models_and_warm_up(spark):
    calls = []
    model = Lazy(lambda: calls.append(1) or "model")
    assert model.available() and model.get() == "model" and model.get() == "model" and calls == [1]
    broken = Lazy(lambda: calls.append(2) or 1 / 0)
    assert not broken.available() and not broken.available() and calls == [1, 2]
    with pytest.raises(RuntimeError):
        broken.get()
    assert warm_up(spark, hash_embedding) == 1


def test_polling_ends_with_the_upload():
    waits, said = [], iter(["pending", "processing", "failed", "ready"])
    assert ingest.poll(lambda: next(said), sleep=waits.append) == "failed" and waits == [0.4, 0.4]
    assert ingest.poll(lambda: None, most=3, sleep=waits.append) is None


def test_figures_of_a_benchmark(spark):
    seconds = evaluation.timed(extract=lambda: spark.range(3), chunk=lambda: 1)
    assert list(seconds) == ["extract", "chunk"] and all(v >= 0 for v in seconds.values())
    assert evaluation.latency(3.0, 2) == 1.5 and evaluation.latency(3.0, 0) == 0.0
    assert [evaluation.request_delay(v) for v in (None, "2.5", "-1", "x")] == [5.0, 2.5, 0.0, 5.0]
    r = spark.createDataFrame([(2, None, 0.5, "b"), (1, 7, 1.0, "a"), (11, 1, 0.1, "c")], "rank int, page int, score double, text string")
    assert evaluation.print_ranking(r) == ["1. page 7 score 1.0000 a", "2. page ? score 0.5000 b"]


def test_hyphens_are_joined_left_to_right(spark):
    cases = [("learn-\ning rates", ["learning"], "learning rates"), ("well-\nknown fact", ["known"], "well-known fact"), ("a trans-\nform and co-\nop", ["transform"], "a transform and co-op"),
             ("\u00dcber-\nGang", ["\u00fcbergang"], "\u00dcberGang"), ("a-\nb-\nc-\nd", ["ab", "cd"], "ab-\ncd"), ("a-\nb-\nc", [], "a-b-\nc"), (None, [], None), ("", [], "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, text string, words array<string>")
    assert [r[0] for r in df.orderBy("i").select(text.join_hyphenated(F.col("text"), F.col("words"))).collect()] == [c for _, _, c in cases]


def test_phrases_of_every_length_are_found(spark, monkeypatch):
    chunks = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a cat sat", "the ca-t", "dog", ""])], "document_id string, chunk_index int, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "a c"), (3, "o"), (4, "zz"), (5, "")], "query_id int, phrase string")
    for short in (256, 0):
        monkeypatch.setattr(evaluation, "SHORT", short)
        assert {(r["query_id"], r["chunk_index"]) for r in evaluation.relevant_chunks(q, chunks).collect()} == {(1, 0), (1, 1), (2, 0), (3, 2)}


def test_keyword_search_does_not_depend_on_the_broadcast(spark, monkeypatch):
    """Repeated terms and queries, null and empty texts, null ids, empty tables: the same rows whichever way weights reach the postings."""
    chunks = spark.createDataFrame([("a", 0, "The cat the CAT"), ("a", 1, None), ("a", 2, ""), ("b", 0, "dog cat"), (None, 1, "cat")], "document_id string, chunk_index long, text string")
    asked = spark.createDataFrame([(1, "cat the the"), (2, "zebra"), (3, None), (None, "dog")], "query_id long, text string")
    assert {(r["document_id"], r["chunk_index"], r["length"], r["term"], r["tf"]) for r in ranking.postings(chunks).collect()} == {("a", 0, 4, "cat", 2), ("a", 0, 4, "the", 2), ("b", 0, 2, "cat", 1), ("b", 0, 2, "dog", 1), (None, 1, 1, "cat", 1)}
    found = sorted(map(repr, ranking.bm25(asked, chunks, 3).collect()))
    monkeypatch.setattr(ranking, "BROADCAST_WEIGHTS", 0)
    assert sorted(map(repr, ranking.bm25(asked, chunks, 3).collect())) == found and len(found) == 15
    for limit in (0, 1 << 18):
        monkeypatch.setattr(ranking, "BROADCAST_WEIGHTS", limit)
        assert ranking.bm25(asked.limit(0), chunks, 3).count() == 0 and ranking.bm25(asked, chunks.limit(0), 3).count() == 0


def test_mean_confidence_is_judged_apart_from_its_last_digits(spark):
    pages = spark.createDataFrame([("d", p, True, 0.8 + 0.02 * (p % 10)) for p in (9, 4, 14, 24, 1, 8, 11, 18, 6)], "document_id string, page int, ocr boolean, ocr_confidence double")
    chunks = spark.createDataFrame([], "document_id string, chunk_index int")
    assert ingest.ready_summary(pages.coalesce(1), chunks).first()["ocr_quality"] == "good"


def _shuffled(spark, rows):
    """Records that the stages of an action over rows wrote for others, and the rows."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def written():
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return rows().collect(), written() - before


def test_strings_that_are_no_phrase_do_not_leave_their_task(spark):
    """Of more short phrases than were once compared directly, no string of a text is shuffled but what may be one of them."""
    texts = [(f"d{i}", i, " ".join(f"w{(i * 7 + j) % 997}x{j}" for j in range(300))) for i in range(20)]
    asked = [(i, f"w{i % 997}x{i % 300}"[: 3 + i % 7] + f"q{i}") for i in range(300)] + [(1000, "W8x1 w9X2"), (1001, "w7x0" + "w8x1" * 9)]
    chunks = spark.createDataFrame(texts, "document_id string, chunk_index int, text string")
    q = spark.createDataFrame(asked, "query_id int, phrase string")
    plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
    want = {(i, d, k) for i, p in asked for d, k, t in texts if plain(p) in plain(t)}
    found, written = _shuffled(spark, lambda: evaluation.relevant_chunks(q, chunks))
    assert {tuple(r) for r in found} == want and want
    assert written < 5 * (len(asked) + len(found)) + 1000


@pytest.mark.parametrize("limits", [{}, {"ROUND": 16, "BLOCK": 8, "TRIED": 4}])
def test_phrases_are_found_as_by_comparing_all(limits, spark, monkeypatch):
    import random

    from folio.operators import phrases

    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(3)
    letters = "ab\u00e9\U00010400"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 150])))) for i in range(60)] + [(None, "abab"), (60, None)]
    asked = {"".join(rng.choice(letters) for _ in range(n)) for n in (1, 1, 2, 3, 3, 4, 5, 6, 7, 8, 12)} | {t[a : a + n] for _, t in texts if t for a, n in [(rng.randrange(len(t)), rng.choice([1, 9, 31, 32, 33, 64, 120]))]}
    t = spark.createDataFrame(texts, "i int, t string")
    p = spark.createDataFrame([(x,) for x in asked], "p string")
    assert sorted(map(repr, ((r["p"], r["i"]) for r in phrases.occurrences(p, t).collect()))) == sorted({repr((x, i)) for x in asked for i, y in texts if y and x in y})
    assert {r["p"] for r in phrases.occurrences(p, t.select("t")).collect()} == {x for x in asked if any(y and x in y for _, y in texts)}
    assert phrases.occurrences(p.limit(0), t).count() == phrases.occurrences(p, t.limit(0)).count() == 0


def test_own_document_alone_is_searched_where_a_question_names_it(spark):
    chunks = spark.createDataFrame([(d, 0, "the cat sat") for d in (1, 2)], "document_id int, chunk_index int, text string")
    q = spark.createDataFrame([(7, 2, "Cat!"), (8, 3, "cat"), (9, 1, None)], "query_id int, document_id int, phrase string")
    assert [tuple(r) for r in evaluation.relevant_chunks(q, chunks).collect()] == [(7, 2, 0)]


def test_keyword_search_moves_only_postings_that_their_document_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 0)
    chunks = spark.createDataFrame([(d, i, " ".join(f"w{(i + j) % 40}" for j in range(40))) for d in range(40) for i in range(30)] + [(99, 0, "w1"), (0, 30, None)], "document_id int, chunk_index int, text string")
    q = spark.createDataFrame([(d, d, f"w{d} W{d} x") for d in range(40)] + [(50, 77, "w1"), (51, None, "w1"), (52, 3, None)], "query_id int, document_id int, text string")
    found, written = _shuffled(spark, lambda: ranking.bm25(q, chunks, 3))
    named = {(r["query_id"], r["document_id"]): r["query_id"] for r in q.collect()}
    every = ranking.bm25(q.select("query_id", "text"), chunks, 3).collect()
    assert sorted(map(repr, found)) == sorted(repr(r) for r in every if (r["query_id"], r["document_id"]) in named) and len(found) == 120
    assert written < 12 * chunks.count()


def test_passages_do_not_carry_the_words_of_their_document(spark, data):
    import re

    from folio.plans import cases_retrieval

    plan = cases_retrieval.passages(spark, data).select("chunk_index", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate inline\(.*\), \[[\d, ]+\], false", plan) and "explode" not in plan
