"""Routing, history, rewriting, tolerant replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .retrieval import to_id

#: What a client is told first, and what asks a model for bare JSON.
THINKING = "正在思考..."
JSON_HINT = "请只返回合法的 JSON 对象，不要包含任何其他内容或 markdown 格式。"
#: How a past turn's search query is told, the marks around a reply's keys, and what a line that only repeats the form says: the first and one of the others.
ROUTED_AS = ("\n（当时路由检索query：", "）")
BLOCK_START, BLOCK_END = "SOURCES_START", "SOURCES_END"
FORM_LINE = ("chunk key", ("逗号分隔", "chunk_1,chunk_2"))


def unfenced(c: Column) -> Column:
    """A reply without the fence of a code block around all of it."""
    return F.regexp_replace(X.strip(c), r"(?is)\A```(?:json)?\s*(.*?)\s*```\z", "$1")


def _is_object(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull() & c.startswith("{")


def route(c: Column, reply: Column | None = None, reasoning: bool = False) -> Column:
    """Q1, Q2, Q4: (action, query, reasoning). Rules first; then a model's raw reply, checked; where there is none, search for the input."""
    text = F.coalesce(c, F.lit(""))
    made = lambda action, query, why: F.struct(action.alias("action"), query.alias("query"), why.alias("reasoning"))
    search = lambda why: made(F.lit("search"), text, F.lit(why))
    rest = search("api_error")
    if reply is not None:
        body = unfenced(reply)
        said = F.from_json(body, "action string, query string, reasoning string")
        action = F.lower(X.strip(F.coalesce(said["action"], F.lit(""))))
        action = F.when(action.isin("search", "chat", "reject"), action).otherwise("search")
        query = F.when(action == "search", F.coalesce(F.nullif(X.strip(said["query"]), F.lit("")), text)).otherwise("")
        why = X.strip(F.coalesce(said["reasoning"], F.lit(""))) if reasoning else F.lit("")
        rest = F.when(reply.isNull(), search("api_error")).when(_is_object(body), made(action, query, why)).otherwise(search("parse_error"))
    chat = lambda why: made(F.lit("chat"), F.lit(""), F.lit(why))
    return F.when(X.is_injection(c), chat("injection_rule")).when(X.is_small_talk(c), chat("rule_match")).otherwise(rest)


def recent(history: DataFrame, turns: int = 2, cut: int = 100, told_route: bool = False) -> DataFrame:
    """Q4, Q7: adds `recent`, the last `turns` turns (query, answer) of the conversation before each one, answers cut: what a model is shown.

    told_route: what a turn's query was searched as (`route_query`, if there is such a column and it isn't blank) is told after it.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-turns, -1)
    query = F.coalesce("query", F.lit(""))
    if told_route and "route_query" in history.columns:
        searched = X.strip(F.coalesce("route_query", F.lit("")))
        query = F.when(searched == "", query).otherwise(F.concat(query, F.lit(ROUTED_AS[0]), searched, F.lit(ROUTED_AS[1])))
    return history.withColumn("recent", F.collect_list(F.struct(query.alias("query"), F.left(F.coalesce("answer", F.lit("")), F.lit(cut)).alias("answer"))).over(w))


def routed(history: DataFrame, model: Callable[[Column, Column], Column], turns: int = 2, cut: int = 100) -> DataFrame:
    """Q4: adds `route`, with a model's reply to each query and its recent turns, which tell what was searched then."""
    rows = recent(history, turns, cut, told_route=True)
    return rows.withColumn("route", route(F.col("query"), model(F.col("query"), F.col("recent")))).drop("recent")


def compact_toc(chunks: DataFrame) -> DataFrame:
    """Q3: a manual's first titles in order of first use, the second ones indented under them."""
    g = chunks.where("title_h1 <> ''").groupBy("doc", "title_h1", "title_h2").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("doc", "title_h1")
    rows = g.withColumn("first", F.min("ord").over(w))
    heads = rows.groupBy("doc", "title_h1").agg(F.min("first").alias("first")).select("doc", "first", F.lit(-1).cast("long").alias("ord"), F.col("title_h1").alias("line"))
    subs = rows.where("title_h2 <> ''").select("doc", "first", "ord", F.concat(F.lit("  "), "title_h2").alias("line"))
    lines = heads.unionByName(subs).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "ord", "line"))).alias("l"))
    return lines.select("doc", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("toc"))


def pairs(turns: DataFrame) -> DataFrame:
    """History: a user's message and the assistant's right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("answer", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    return rows.where((F.col("role") == "user") & F.col("answer").isNotNull()).select("conv_id", "turn", F.col("text").alias("query"), "answer")


def trim_history(history: DataFrame, budget: int) -> DataFrame:
    """Q6: newest first, until the turns kept would pass the budget; a single turn above it is skipped and older ones still count. A null query or answer is empty; a budget of 0 keeps nothing."""
    rows = history.withColumn("n_tokens", X.token_count(F.col("query")) + X.token_count(F.col("answer"))).where((F.col("n_tokens") <= budget) & F.lit(budget > 0))
    total = F.sum("n_tokens").over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).where(F.col("running") <= budget)


def rewrite(history: DataFrame, model: Callable[[Column, Column], Column] | None = None, turns: int = 2, cut: int = 200) -> DataFrame:
    """Q7: a model's rewriting of the query, given its recent turns, if it changed it; else, where the query leans on what was said, the last query goes before it.

    A first query stays as it is. A model that failed (null) leaves the query as it is as well.
    """
    shown = recent(history if "answer" in history.columns else history.withColumn("answer", F.lit("")), turns, cut)
    last = X.strip(F.coalesce(F.element_at(F.col("recent.query"), -1), F.lit("")))
    shown = shown.withColumn("__last", F.when(F.size("recent") > 0, last).otherwise(""))
    joined = F.when(X.leans_on_context(F.col("query")) & (F.col("__last") != ""), F.concat(F.lit("关于“"), F.col("__last"), F.lit("”，"), "query")).otherwise(F.col("query"))
    if model is not None:
        told = F.regexp_replace(model(F.col("query"), F.col("recent")), "\\A[`\"' \n\t]+|[`\"' \n\t]+\\z", "")
        joined = F.when((F.size("recent") == 0) | told.isNull(), F.col("query")).when((told != "") & (told != F.col("query")), told).otherwise(joined)
    return shown.select(*history.columns, joined.alias("search_query"))


def last_user_message(turns: DataFrame) -> DataFrame:
    """Q8"""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("last_user", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))


def parse_reply(c: Column) -> Column:
    """Q5: a reply's JSON, fenced or not, as (answer, used_chunks); what can't be parsed is the answer itself."""
    body = unfenced(c)
    parsed = F.from_json(body, "answer string, used_chunks array<string>")
    nothing = F.array().cast("array<string>")
    return F.when(_is_object(body), F.struct(F.coalesce(parsed["answer"], F.lit("")).alias("answer"), F.coalesce(parsed["used_chunks"], nothing).alias("used_chunks"))).otherwise(F.struct(c.alias("answer"), nothing.alias("used_chunks")))


def answered(rows: DataFrame, generate: Callable[[str, str, list[dict]], str], at_once: int | None = None) -> DataFrame:
    """Q12: (query_id, answer, used) of questions (query_id, query, context, labels, history array<struct<query, answer>>) by a given generator.

    Its reply is read as parse_reply() does; labels it used become ids, each as often as told, unknown ones go. Where it fails the answer says so and nothing is used.
    at_once bounds the calls that run at a time; each row is one call, in Arrow batches.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            said, failed = [], []
            for query, context, history in zip(batch["query"], batch["context"], batch["history"], strict=True):
                try:
                    said.append(generate(query or "", context or "", [dict(t) if isinstance(t, dict) else t.asDict() for t in (history if history is not None else [])]))
                    failed.append(False)
                except Exception as e:  # whatever the given generator meets is told as the answer
                    said.append(f"生成失败：{e}")
                    failed.append(True)
            yield pd.DataFrame({"query_id": batch["query_id"], "said": said, "failed": failed})

    narrow = rows.select("query_id", "query", "context", "history")
    told = (narrow.repartition(at_once) if at_once else narrow).mapInPandas(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, said string, failed boolean")
    told = told.withColumn("r", F.when(F.col("failed"), F.struct(F.col("said").alias("answer"), F.array().cast("array<string>").alias("used_chunks"))).otherwise(parse_reply(F.col("said"))))
    ids = F.filter(F.transform("r.used_chunks", lambda k: to_id(X.strip(k), F.col("labels"))), lambda k: k.isNotNull())
    return told.join(rows.select("query_id", "labels"), "query_id").select("query_id", F.col("r.answer").alias("answer"), ids.alias("used"))


def used_keys(keys: Column, valid: Column) -> Column:
    """Q9: a model's keys that are known, each once, in order. Space around keys doesn't count; blank ones are none."""
    bare = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.strip), lambda k: k != "")
    known = bare(valid)
    return F.array_join(F.array_distinct(F.filter(bare(keys), lambda k: F.array_contains(known, k))), ",")


def answered_in_two(rows: DataFrame, make: Callable[[], tuple[Callable[[str, str, list[dict]], str], Callable[[str, str, list[str], str], str]]], at_once: int | None = None) -> DataFrame:
    """Q9, Q12: (query_id, answer, used_keys) of questions (query_id, query, context, labels, history array<struct<query, answer>>) by two calls: one that answers, and one that is shown the answer and asked which chunks it used.

    make() is called once a task and gives both functions: (query, context, history) to a plain answer, and (query, answer, keys, context) to JSON with `used_chunks`. The answer is stripped for the second call. Where the first
    fails the answer says so and there is no second; where the second fails, or says nothing that can be read, no keys are told. Keys are checked against the labels as used_keys() does; without labels there is no second call.
    at_once bounds the tasks, and so the calls, that run at a time; what was made is kept part by part where files.write_through() is given this function.
    """

    def run(batches):
        import pandas as pd

        answer, extract = make()
        for batch in batches:
            said, told = [], []
            for query, context, history, keys in zip(batch["query"], batch["context"], batch["history"], batch["keys"], strict=True):
                query, context, raw = query or "", context or "", None
                try:
                    text = answer(query, context, [dict(t) if isinstance(t, dict) else t.asDict() for t in (history if history is not None else [])]) or ""
                except Exception as e:  # whatever the given function meets is told as the answer
                    said.append(f"生成失败：{e}")
                    told.append(None)
                    continue
                said.append(text)
                known = [k.strip() for k in (keys if keys is not None else []) if k.strip()]
                if known:
                    try:
                        raw = extract(query, text.strip(), known, context)
                    except Exception:  # an answer without its sources is better than none
                        raw = None
                told.append(raw)
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": said, "told": told, "keys": batch["keys"]})

    narrow = rows.select("query_id", "query", "context", "history", F.map_keys("labels").alias("keys"))
    made = (narrow.repartition(at_once) if at_once else narrow).mapInPandas(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, answer string, told string, keys array<string>")
    body = X.strip(F.col("told"))
    parsed = F.when(_is_object(body), F.from_json(body, "used_chunks array<string>")["used_chunks"])
    return made.select("query_id", "answer", used_keys(parsed, F.col("keys")).alias("used_keys"))


def block_between(c: Column, start: str = BLOCK_START, end: str = BLOCK_END) -> Column:
    """Q10: the lines between two marks, without those that only repeat the form, space around the whole left out; null where a mark is missing. Blank lines inside stay."""
    pattern = rf"(?s)\Q{start}\E[ \t\r]*+\n?+(.*?)\Q{end}\E"
    form = lambda l: l.contains(FORM_LINE[0]) & (l.contains(FORM_LINE[1][0]) | l.contains(FORM_LINE[1][1]))
    kept = F.filter(X.lines(F.regexp_extract(c, pattern, 1)), lambda l: ~form(l))
    return F.when(c.rlike(pattern), X.strip(F.array_join(kept, "\n")))


def messages(history: DataFrame, system: str) -> DataFrame:
    """Q11: a conversation's turns as messages: the system's first, then each query and answer."""
    turn = F.struct("turn", "query", "answer")
    rows = history.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.flatten(F.transform("t", lambda s: F.array(message("user", s["query"]), message("assistant", s["answer"]))))
    return rows.select("conv_id", F.concat(F.array(message("system", F.lit(system))), said).alias("messages"))


def answer_events(rows: DataFrame) -> DataFrame:
    """K7: (query_id, pos, event, data) that a client is sent for each answer (query_id, action, answer, sources, images, error): status, answer_token, sources, done; an error ends them.

    data is JSON. A chat or refusal has neither sources nor images.
    """
    searched = F.col("action") == "search"
    listed = lambda c: F.when(searched, F.coalesce(F.col(c), F.array())).otherwise(F.array())
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    status = event("status", F.to_json(F.struct(F.lit(THINKING).alias("text"))))
    told = event("answer_token", F.to_json(F.struct(F.coalesce("answer", F.lit("")).alias("content"))))
    found = event("sources", F.to_json(F.struct(listed("sources").alias("sources"), listed("images").alias("images"), "action")))
    failed = event("error", F.to_json(F.struct("error")))
    events = F.when(F.col("error").isNotNull(), F.array(status, failed)).otherwise(F.array(status, told, found, event("done", F.lit("{}"))))
    return rows.select("query_id", F.posexplode(events).alias("pos", "e")).select("query_id", "pos", "e.event", "e.data")


def manual_label(pdf_name: Column, short: dict[str, str] | None = None) -> Column:
    """T5: what a manual is called in a list: its short name, if it has one, or its file's name without the ending."""
    base = F.regexp_replace(X.strip(F.coalesce(pdf_name, F.lit(""))), r"(?i)\.pdf\z", "")
    for name, said in (short or {}).items():
        base = F.when(base == name, said).otherwise(base)
    return base


def google_payload(messages: Column, json_mode: bool = False) -> Column:
    """Q11: (system_instruction, contents) as the provider `google` takes messages: system texts joined and apart, the assistant called model, blank messages left out."""
    solid = F.filter(F.transform(messages, lambda m: F.struct(F.lower(X.strip(m["role"])).alias("role"), X.strip(F.coalesce(m["content"], F.lit(""))).alias("text"))), lambda m: m["text"] != "")
    system = F.array_join(F.transform(F.filter(solid, lambda m: m["role"] == "system"), lambda m: m["text"]), "\n\n")
    part = lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), m["text"].alias("text"))
    contents = F.transform(F.filter(solid, lambda m: m["role"] != "system"), part)
    if json_mode:
        last = F.try_element_at(contents, F.lit(-1))
        joined = F.concat(F.slice(contents, F.lit(1), F.size(contents) - 1), F.array(F.struct(F.lit("user").alias("role"), F.concat(last["text"], F.lit("\n\n" + JSON_HINT)).alias("text"))))
        hint = F.array(F.struct(F.lit("user").alias("role"), F.lit(JSON_HINT).alias("text")))
        contents = F.when(F.coalesce(last["role"] == "user", F.lit(False)), joined).otherwise(F.concat(contents, hint))
    return F.struct(F.nullif(system, F.lit("")).alias("system_instruction"), contents.alias("contents"))


def provider(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.startswith("gemini"), "google").when(m.startswith("claude"), "anthropic").otherwise("openai")
