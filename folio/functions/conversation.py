"""Conversation, prompt and answer text as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import strip

#: Words and openers that refer to what was said before.
REFERRING = (
    "it", "its", "it's", "they", "them", "their", "theirs", "this", "that",
    "these", "those", "he", "him", "his", "she", "her", "hers", "there",
    "former", "latter", "above", "previous", "earlier", "same", "else",
    "more", "again", "another", "other", "one", "ones",
)
OPENERS = (
    "and ", "but ", "also ", "so ", "what about", "how about", "why ",
    "why?", "then ", "elaborate", "explain more", "tell me more",
)
#: The sentence that declines an answer, and the questions suggested for each document type.
REFUSAL = "I don't know based on the provided document."
SUGGESTIONS = {
    "prose": ("Summarize the main topics of this document", "What are the key definitions introduced?", "What limitations or open problems are discussed?"),
    "slides": ("Summarize the main ideas of this deck", "What are the key terms and their definitions?", "Walk me through the steps or algorithms covered"),
    "resume": ("Summarize this person's experience", "Which projects are listed, and what technologies do they use?", "What is their education background?"),
}
#: Messages for the client.
DAILY_QUOTA = "The free model's daily request limit has been reached. It resets at midnight UTC."
HISTORY = 6


def needs_rewrite(question: Column, has_history: Column) -> Column:
    q = F.lower(strip(question))
    words = F.regexp_extract_all(q, F.lit("[a-z']+"), F.lit(0))
    opens = F.lit(False)
    for o in OPENERS:
        opens = opens | q.startswith(o)
    return has_history & ((F.size(words) <= 3) | opens | F.arrays_overlap(words, F.array(*map(F.lit, REFERRING))))


def history_window(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n user or finished messages of each conversation (conv_id, turn, role, text, optional status)."""
    done = F.col("role") == "user"
    done = done | (F.col("status") == "done") if "status" in messages.columns else done | (F.col("role") == "assistant")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.filter(done).withColumn("_back", back).filter(F.col("_back") <= n).drop("_back")


def history_text(roles: Column, texts: Column) -> Column:
    """ROLE: content lines of user and assistant messages with content."""
    both = F.arrays_zip(roles.alias("r"), texts.alias("t"))
    kept = F.filter(both, lambda m: m["r"].isin("user", "assistant") & (F.coalesce(m["t"], F.lit("")) != ""))
    return F.array_join(F.transform(kept, lambda m: F.concat(F.upper(m["r"]), F.lit(": "), m["t"])), "\n")


def rewrite_prompt(question: Column, history: Column) -> Column:
    """A request to make the question stand alone."""
    talk = F.when(F.coalesce(history, F.lit("")) == "", F.lit("(No prior conversation.)")).otherwise(history)
    rules = "Rewrite the question so that it stands alone: resolve references from the conversation, keep its intent and names, add and answer nothing. Return one question; if it already stands alone, return it unchanged."
    return F.concat(F.lit("Conversation:\n"), talk, F.lit("\n\nLatest question: "), question, F.lit(f"\n\n{rules}\n"))


def rewritten(question: Column, needed: Column, reply: Column) -> Column:
    """What is searched for: the model's reply, stripped, where a rewrite is needed and there is one; else the question as it is."""
    r = strip(F.coalesce(reply, F.lit("")))
    return F.when(needed & (r != ""), r).otherwise(question)


def suggestions(documents: DataFrame) -> DataFrame:
    """document_id, suggestion_no (from 0), suggestion for documents (document_id, document_type): a lookup in a table of nine rows."""
    spark = documents.sparkSession
    rows = [(kind, i, text) for kind, texts in SUGGESTIONS.items() for i, text in enumerate(texts)]
    known = F.broadcast(spark.createDataFrame(rows, "document_type string, suggestion_no int, suggestion string"))
    return documents.select("document_id", "document_type").join(known, "document_type").select("document_id", "suggestion_no", "suggestion")


def answer_deltas(answers: DataFrame, key: str = "request_id") -> DataFrame:
    """key, seq, delta: the non-empty parts of an answer as they come."""
    parts = F.filter("deltas", lambda x: F.coalesce(x, F.lit("")) != "")
    return answers.select(key, F.posexplode(parts).alias("seq", "delta"))


def answer_messages(system: Column, history: Column, context: Column, question: Column) -> Column:
    """array<struct<role, content>>: system, the history as it is, then the question with delimited context."""
    ask = F.concat(F.lit("\n<document_context>\n"), context, F.lit("\n</document_context>\n\nQuestion:\n"), question, F.lit("\n"))
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.concat(one("system", system), history, one("user", ask))


def final_answer(text: Column) -> Column:
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(s == "", F.lit(REFUSAL)).otherwise(s)


def provider_error(per_day: Column, default: Column) -> Column:
    return F.when(per_day, F.lit(DAILY_QUOTA)).otherwise(default)


RUN = r"(?:\[\d+(?:\s*,\s*\d+)*\])+"


def citation_runs(answer: Column, n_sources: Column) -> Column:
    """array<struct<run, ids, cited>>: runs such as [1], [1][3] or [1, 2]; cited if every id is a source."""
    runs = F.regexp_extract_all(answer, F.lit(RUN), F.lit(0))
    ids = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"\d+"), F.lit(0)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    return F.transform(runs, lambda r: F.struct(r.alias("run"), ids(r).alias("ids"), F.forall(ids(r), lambda i: F.coalesce((i >= 1) & (i <= n_sources), F.lit(False))).alias("cited")))


def inline_marks(text: Column) -> Column:
    """Bold and code spans of a text, with their marks."""
    found = F.regexp_extract_all(text, F.lit(r"\*\*[^*]+\*\*|`[^`]+`"), F.lit(0))
    return F.filter(found, lambda x: F.length(x) > F.when(x.startswith("*"), F.lit(4)).otherwise(F.lit(2)))


def answer_blocks(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """key, block_no, kind (paragraph, bullets, numbered), text: paragraphs with lines joined by space, list items by line.

    A paragraph ends at a blank line or an item; items of one kind form one list unless a paragraph lies between.
    """
    bullet, numbered = r"^\s*[-*•]\s+", r"^\s*\d+[.)]\s+"
    lines = answers.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    kind = F.when(F.col("line").rlike(numbered), "numbered").when(F.col("line").rlike(bullet), "bullets").when(strip(F.col("line")) == "", "blank").otherwise("paragraph")
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("kind", kind).withColumn("line_before", F.lag("kind").over(w))
    body = F.when(F.col("kind") == "paragraph", strip(F.col("line"))).when(F.col("kind") == "numbered", F.regexp_replace("line", numbered, "")).otherwise(F.regexp_replace("line", bullet, ""))
    rows = lines.filter("kind <> 'blank'").withColumns({"body": body, "kind_before": F.lag("kind").over(w)})
    new = F.when(F.col("kind") == "paragraph", F.coalesce(F.col("line_before") != "paragraph", F.lit(True))).otherwise(F.coalesce(F.col("kind_before") != F.col("kind"), F.lit(True)))
    rows = rows.withColumn("block_no", F.sum(new.cast("long")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"])
    out = rows.groupBy(key, "block_no", "kind").agg(parts.alias("parts"))
    return out.select(key, "block_no", "kind", F.when(F.col("kind") == "paragraph", F.array_join("parts", " ")).otherwise(F.array_join("parts", "\n")).alias("text"))


def sse_event(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_frames(stream: Column) -> Column:
    """array<struct<event, data>> of the complete frames of a stream; data lines joined; event defaults to message. Frames whose data is not JSON are ignored."""
    text = F.regexp_replace(stream, "\r\n", "\n")
    frames = F.split(text, "\n\n", -1)
    whole = F.slice(frames, F.lit(1), F.greatest(F.size(frames) - 1, F.lit(0)))
    lines = lambda f, name: F.transform(F.filter(F.split(f, "\n"), lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    event = lambda f: F.coalesce(F.element_at(F.when(F.size(lines(f, "event")) > 0, lines(f, "event")), -1), F.lit("message"))
    found = F.transform(whole, lambda f: F.struct(event(f).alias("event"), F.array_join(lines(f, "data"), "\n").alias("data")))
    return F.filter(found, lambda x: (x["data"] != "") & F.try_parse_json(x["data"]).isNotNull())


def joined_answer(deltas: Column, done_text: Column) -> Column:
    """The final text if there is one, else the deltas so far."""
    return F.coalesce(done_text, F.array_join(deltas, ""))


def contains_keywords(answer: Column, groups: Column) -> Column:
    """Every group has a keyword that the answer contains; both sides already normalized."""
    return F.forall(groups, lambda g: F.exists(g, lambda k: F.contains(answer, k)))
