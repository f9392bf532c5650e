"""Answers, prompts and grades over conversations: assistant turns become answers with lists, citations and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import text as T
from ..operators import evaluation
from ..providers import extractive_answer
from ..streaming import ingest
from .registry import literal, query, stripped, table, words


def answers(spark, d):
    """answer_id, text, n_sources: sentences of assistant turns as bullets, numbered items or paragraphs, with citations and marks."""
    c, kind = table(spark, d, "conversations").filter("role = 'assistant'"), (F.col("conv_id") + F.col("turn")) % 4
    joint = F.when(kind == 0, "\n- ").when(kind == 1, "\n1. ").when(kind == 2, "\n\n").otherwise(". ")
    first = F.coalesce(F.get(F.split("text", " "), F.lit(0)), F.lit(""))
    t = F.concat(F.lit("**"), first, F.lit("** `"), first, F.lit("` ** "), F.replace("text", F.lit(". "), joint), F.lit(" [1]["), (F.col("turn") % 5).cast("string"), F.lit("] and [2, 7] or [3,1]"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), t.alias("text"), F.lit(3).alias("n_sources"))


_ANSWERS = r"""an AS (SELECT conv_id * 1000 + turn AS answer_id, '**' || string_split(text, ' ')[1] || '** `' || string_split(text, ' ')[1] || '` ** ' || replace(text, '. ',
 CASE (conv_id + turn) % 4 WHEN 0 THEN chr(10) || '- ' WHEN 1 THEN chr(10) || '1. ' WHEN 2 THEN chr(10) || chr(10) ELSE '. ' END) || ' [1][' || (turn % 5) || '] and [2, 7] or [3,1]' AS text, 3 AS n_sources FROM conversations WHERE role = 'assistant')"""


@query(rf"""WITH {_ANSWERS}, l AS (SELECT answer_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM an),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*\d+[.)]\s+') THEN 'numbered' WHEN regexp_matches(line, '^\s*[-*•]\s+') THEN 'bullets' WHEN {stripped('line')} = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM l),
b AS (SELECT *, lag(kind) OVER (PARTITION BY answer_id ORDER BY pos) AS line_before FROM k),
x AS (SELECT *, lag(kind) OVER (PARTITION BY answer_id ORDER BY pos) AS kind_before, CASE kind WHEN 'paragraph' THEN {stripped('line')} WHEN 'numbered' THEN regexp_replace(line, '^\s*\d+[.)]\s+', '') ELSE regexp_replace(line, '^\s*[-*•]\s+', '') END AS body FROM b WHERE kind <> 'blank'),
n AS (SELECT *, sum(CASE WHEN kind = 'paragraph' THEN CASE WHEN line_before = 'paragraph' THEN 0 ELSE 1 END ELSE CASE WHEN kind_before = kind THEN 0 ELSE 1 END END) OVER (PARTITION BY answer_id ORDER BY pos) AS block_no FROM x)
SELECT answer_id, CAST(block_no AS BIGINT) AS block_no, kind, CASE WHEN kind = 'paragraph' THEN string_agg(body, ' ' ORDER BY pos) ELSE string_agg(body, chr(10) ORDER BY pos) END AS text FROM n GROUP BY answer_id, block_no, kind""")
def answer_blocks(spark, d):
    return C.answer_blocks(answers(spark, d))


@query(rf"""WITH {_ANSWERS}, r AS (SELECT answer_id, n_sources, unnest(regexp_extract_all(text, '(?:\[\d+(?:\s*,\s*\d+)*\])+')) AS run FROM an), i AS (SELECT *, list_transform(regexp_extract_all(run, '\d+'), lambda x: CAST(x AS INT)) AS ids FROM r)
SELECT answer_id, run, array_to_string(ids, ',') AS ids, len(list_filter(ids, lambda x: x < 1 OR x > n_sources)) = 0 AS cited FROM i""")
def citations(spark, d):
    x = answers(spark, d).select("answer_id", F.inline(C.citation_runs(F.col("text"), F.col("n_sources"))))
    return x.select("answer_id", "run", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "cited")


@query(rf"""WITH {_ANSWERS} SELECT answer_id, array_to_string(list_filter(regexp_extract_all(text, '\*\*[^*]+\*\*|`[^`]+`'), lambda x: length(x) > CASE WHEN starts_with(x, '*') THEN 4 ELSE 2 END), '|') AS marks FROM an""")
def inline_marks(spark, d):
    return answers(spark, d).select("answer_id", F.array_join(C.inline_marks(F.col("text")), "|").alias("marks"))


def _users(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").withColumn("has_history", F.col("turn") > 0)


_OPEN = " OR ".join(f"starts_with(q, {literal(o)})" for o in C.OPENERS)


@query(rf"""WITH u AS (SELECT conv_id, turn, text, turn > 0 AS h, lower({stripped('text')}) AS q, CASE turn % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' About ' || text || chr(10) END AS reply FROM conversations WHERE role = 'user'),
n AS (SELECT *, h AND (len(regexp_extract_all(q, '[a-z'']+')) <= 3 OR {_OPEN} OR list_has_any(regexp_extract_all(q, '[a-z'']+'), {literal(list(C.REFERRING))})) AS needs FROM u)
SELECT conv_id, turn, CASE WHEN needs AND {stripped("coalesce(reply, '')")} <> '' THEN {stripped('reply')} ELSE text END AS rewritten FROM n""")
def rewrite_result(spark, d):
    """The model's replies are blank, a sentence, or missing."""
    reply = F.when(F.col("turn") % 3 == 0, F.lit("  ")).when(F.col("turn") % 3 == 1, F.concat(F.lit(" About "), F.col("text"), F.lit("\n")))
    return _users(spark, d).select("conv_id", "turn", C.rewritten(F.col("text"), C.needs_rewrite(F.col("text"), F.col("has_history")), reply).alias("rewritten"))


@query(r"""WITH u AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1),
h AS (SELECT c.conv_id, string_agg(c.role || '=' || c.text, '|' ORDER BY c.turn) AS h FROM conversations c JOIN u ON u.conv_id = c.conv_id AND c.turn < u.turn GROUP BY 1)
SELECT u.conv_id, 'system=Be brief.|' || coalesce(h || '|', '') || 'user=' || chr(10) || '<document_context>' || chr(10) || 'ctx' || chr(10) || '</document_context>' || chr(10) || chr(10) || 'Question:' || chr(10) || c.text || chr(10) AS messages
FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn AND c.role = 'user' LEFT JOIN h ON h.conv_id = u.conv_id""")
def answer_prompt(spark, d):
    """The last question of each conversation with all that was said before it."""
    c = table(spark, d, "conversations")
    last = c.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    said = F.filter(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "last"))), lambda m: m["turn"] < m["last"])
    g = c.join(last, "conv_id").groupBy("conv_id").agg(said.alias("m"), F.max(F.when((F.col("turn") == F.col("last")) & (F.col("role") == "user"), F.col("text"))).alias("question"))
    history = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    messages = C.answer_messages(F.lit("Be brief."), history, F.lit("ctx"), F.col("question"))
    return g.select("conv_id", F.array_join(F.transform(messages, lambda m: F.concat_ws("=", m["role"], m["content"])), "|").alias("messages"))


@query(rf"""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN {literal(C.REFUSAL)} ELSE {stripped(r"regexp_extract(text, '^[^.!?]*[.!?]?') || ' [1]'")} END AS answer FROM conversations WHERE role = 'assistant'""")
def extractive_answers(spark, d):
    """The stand-in for a model: the first sentence of the first passage; every fifth question has none."""
    passages = F.when(F.col("turn") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("text"))
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", C.final_answer(extractive_answer(passages)).alias("answer"))


def _streamed(spark, d):
    """request_id, sources, deltas, error: words as they come, some of them empty; every sixth conversation fails."""
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    deltas = F.transform(F.split("text", " "), lambda w, i: F.when(i % 4 == 3, F.lit("")).otherwise(F.concat(w, F.lit(" "))))
    deltas = F.when(F.col("turn") % 7 == 1, F.array(F.lit(" "))).otherwise(deltas)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.lit("[]").alias("sources"), deltas.alias("deltas"), F.when(F.col("conv_id") % 6 == 1, F.lit("down")).alias("error"))


_STREAMED = r"""sr AS (SELECT conv_id * 1000 + turn AS request_id, CASE WHEN turn % 7 = 1 THEN [' '] ELSE list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 4 = 3 THEN '' ELSE w || ' ' END) END AS deltas, CASE WHEN conv_id % 6 = 1 THEN 'down' END AS error FROM conversations WHERE role = 'assistant'),
sd AS (SELECT request_id, error, list_filter(deltas, lambda x: x <> '') AS ds FROM sr)"""


@query(f"""WITH {_STREAMED} SELECT request_id, CAST(i - 1 AS INT) AS seq, ds[i] AS delta FROM (SELECT request_id, ds, unnest(range(1, len(ds) + 1)) AS i FROM sd)""")
def answer_deltas(spark, d):
    return C.answer_deltas(_streamed(spark, d))


_DONE = stripped("array_to_string(ds, '')")


@query(f"""WITH {_STREAMED}, e AS (SELECT request_id, 0 AS seq, 'sources' AS event, '[]' AS data FROM sd
 UNION ALL SELECT request_id, i, 'token', CAST(to_json({{'text': ds[i]}}) AS VARCHAR) FROM (SELECT request_id, ds, unnest(range(1, len(ds) + 1)) AS i FROM sd)
 UNION ALL SELECT request_id, len(ds) + 1, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END, CASE WHEN error IS NULL THEN CAST(to_json({{'answer': CASE WHEN {_DONE} = '' THEN {literal(C.REFUSAL)} ELSE {_DONE} END}}) AS VARCHAR) ELSE CAST(to_json({{'detail': error}}) AS VARCHAR) END FROM sd)
SELECT request_id, CAST(seq AS BIGINT) AS seq, event, data FROM e""")
def answer_events(spark, d):
    return ingest.answer_events(_streamed(spark, d))


@query(f"""WITH {_STREAMED} SELECT request_id, CASE WHEN error IS NULL THEN 'final' ELSE array_to_string(ds, '') END AS shown FROM sd""")
def joined_answer(spark, d):
    """What is shown: the final text, or after a failure the parts so far."""
    parts = C.answer_deltas(_streamed(spark, d)).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("p"))
    s = _streamed(spark, d).select("request_id", F.when(F.col("error").isNull(), "final").alias("done")).join(parts, "request_id", "left")
    return s.select("request_id", C.joined_answer(F.transform(F.coalesce("p", F.array().cast(parts.schema["p"].dataType)), lambda x: x["delta"]), F.col("done")).alias("shown"))


_FRAME = "CASE WHEN event_id % 10 = 0 THEN '{bad' ELSE props END"


@query(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'message' ELSE event_type END AS event, props AS data FROM events WHERE event_id % 10 <> 0""")
def sse_decode(spark, d):
    """Frames in CRLF, without a name every third time, with broken JSON every tenth; an incomplete one follows."""
    data = F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.col("props"))
    named = F.replace(C.sse_event(F.col("event_type"), data), F.lit("\n"), F.lit("\r\n"))
    frame = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("data: "), data, F.lit("\n\n"))).otherwise(named)
    s = table(spark, d, "events").select("event_id", frame.alias("s"))
    return s.select("event_id", F.inline(C.sse_frames(F.concat("s", F.lit("event: cut off")))))


@query(f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {literal(C.DAILY_QUOTA)} ELSE 'failed' END AS provider, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'fallback' END AS client FROM events""")
def error_texts(spark, d):
    """Provider errors with and without a daily quota; bodies whose detail is a string, a list, or no JSON at all."""
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("detail")))).when(F.col("event_id") % 3 == 1, F.lit('{"detail": [1]}')).otherwise(F.lit("not json"))
    e = table(spark, d, "events")
    return e.select("event_id", C.provider_error(F.col("event_id") % 4 == 0, F.lit("failed")).alias("provider"), ingest.error_detail(body, F.lit("fallback")).alias("client"))


_NORMAL = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"


@query(rf"""WITH a AS (SELECT conv_id % 7 AS run_id, conv_id * 1000 + turn AS seq, CASE WHEN turn % 3 = 0 THEN 'unanswerable' ELSE 'answerable' END AS kind, {_NORMAL.format('text')} AS t, {words('text')} AS w, (conv_id + turn) % 4 = 0 AS refused, conv_id % 5 = 1 AS error FROM conversations WHERE role = 'assistant'),
k AS (SELECT *, (contains(t, {_NORMAL.format("coalesce(w[1], '')")}) OR contains(t, 'qqq')) AND (contains(t, CASE WHEN seq % 2 = 0 THEN 'zzzz' ELSE {_NORMAL.format("coalesce(w[3], 'e')")} END)) AS kw FROM a),
p AS (SELECT *, sum(CAST(NOT error AS INT)) OVER (PARTITION BY run_id ORDER BY seq) AS part FROM k),
r AS (SELECT *, sum(CAST(error AS INT)) OVER (PARTITION BY run_id, part ORDER BY seq) AS n FROM p),
s AS (SELECT *, coalesce(max(n) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS stopped FROM r)
SELECT run_id, kind, CAST(count(*) FILTER (NOT error AND CASE WHEN kind = 'answerable' THEN kw AND NOT refused ELSE refused END) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (error) AS BIGINT) AS errors FROM s WHERE NOT stopped GROUP BY ALL""")
def answer_keyword_grade(spark, d):
    """Seven runs of answers; each must have one keyword of each of two groups."""
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    seq, w = F.col("conv_id") * 1000 + F.col("turn"), T.tokens(F.col("text"))
    groups = F.array(F.array(F.coalesce(F.get(w, F.lit(0)), F.lit("")), F.lit("qqq")), F.array(F.when(seq % 2 == 0, F.lit("zzzz")).otherwise(F.coalesce(F.get(w, F.lit(2)), F.lit("e")))))
    groups = F.transform(groups, lambda g: F.transform(g, T.evidence_text))
    a = c.select((F.col("conv_id") % 7).alias("run_id"), seq.alias("seq"), F.when(F.col("turn") % 3 == 0, "unanswerable").otherwise("answerable").alias("kind"),
                 C.contains_keywords(T.evidence_text(F.col("text")), groups).alias("has_keywords"), ((F.col("conv_id") + F.col("turn")) % 4 == 0).alias("refused"), (F.col("conv_id") % 5 == 1).alias("error"))
    return evaluation.grade_summary(evaluation.grade_answers(a))


@query("""WITH m AS (SELECT DISTINCT source AS model FROM documents WHERE source IS NOT NULL), c AS (SELECT DISTINCT conv_id AS case_id FROM conversations),
r AS (SELECT model, case_id, (length(model) + case_id) % 6 AS k FROM m CROSS JOIN c)
SELECT model, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (k IN (0, 1)) AS BIGINT) AS answered, CAST(count(*) FILTER (k = 2) AS BIGINT) AS timeout, CAST(count(*) FILTER (k = 3) AS BIGINT) AS rate_limit, CAST(count(*) FILTER (k = 4) AS BIGINT) AS not_found, CAST(count(*) FILTER (k = 5) AS BIGINT) AS other FROM r GROUP BY model""")
def rewriter_comparison(spark, d):
    """Sources as models, conversations as cases; replies and failures by the length of the name."""
    models = table(spark, d, "documents").select(F.col("source").alias("model")).filter("model IS NOT NULL").distinct()
    cases = table(spark, d, "conversations").select(F.col("conv_id").alias("case_id")).distinct()
    k = (F.length("model") + F.col("case_id")) % 6
    error = F.when(k == 2, "Request Timed out").when(k == 3, "HTTP 429").when(k == 4, "404 no such model").when(k == 5, "broken")
    replies = cases.crossJoin(F.broadcast(models)).withColumns({"error": error, "reply": F.when(k < 2, "x")})
    return evaluation.compare_models(models, cases, replies)
