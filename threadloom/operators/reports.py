"""Compositions: digests, timelines, search pages, projections and states built from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import fingerprint, tokens
from threadloom.operators.predicates import local_day
from threadloom.operators.search import fts_match, ilike_contains, score_messages
from threadloom.operators.windows import newest_per_key, take_within_budget

#: Tiers by category (fixed values): what is embedded by the better model.
QUALITY_CATEGORIES = ("memory", "plan", "identity", "learning")
#: Names that aren't just their id in title case (fixed values).
DISPLAY_NAMES = {"claude_code": "Claude Code", "codex": "Codex", "cursor": "Cursor", "openclaw": "OpenClaw"}


def summary_staleness(summaries: DataFrame, messages: DataFrame, offset_minutes: int = -480) -> DataFrame:
    """``summaries(day, created)`` with whether a message of that local day is newer."""
    newest = messages.groupBy(local_day(F.col("ts"), offset_minutes).alias("day")).agg(F.max("ts").alias("newest"))
    return summaries.join(newest, "day", "left").select("day", F.coalesce(F.col("newest") > F.col("created"), F.lit(False)).alias("stale"))


def conversation_digest(messages: DataFrame, budget: int = 3000, turn: int = 500) -> DataFrame:
    """Per conversation its turns, led by their role, up to a budget of characters."""
    rows = messages.where("role in ('user', 'assistant')").withColumn("content", F.concat("role", F.lit(": "), F.substring("content", 1, turn)))
    kept = take_within_budget(rows, "document_id", ["line_number"], "content", budget)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "content"))), lambda x: x["content"])
    return kept.groupBy("document_id").agg(F.array_join(parts, "\n").alias("digest"))


def share_counts(links: DataFrame, views: DataFrame) -> DataFrame:
    """Views of each link, none included."""
    return links.join(views.groupBy("link_id").agg(F.count("*").alias("views")), "link_id", "left").select("link_id", F.coalesce("views", F.lit(0)).alias("views"))


def pending_by_root(folded: DataFrame, pending: DataFrame) -> DataFrame:
    """Open questions of each visible conversation with its copies and children."""
    return folded.join(pending, "document_id").groupBy("canonical_id").agg(F.sum("pending").alias("pending"))


def task_counts(tasks: Column) -> list[Column]:
    """Tasks by status, and those outstanding, of an array of statuses."""
    names = ("pending", "in_progress", "blocked", "completed", "cancelled")

    def having(*statuses: str) -> Column:
        return F.size(F.filter(tasks, lambda t: t.isin(*statuses)))

    counts = [having(n).alias(n) for n in names]
    return [*counts, having("pending", "in_progress", "blocked").alias("outstanding")]


def task_history(rows: DataFrame, k: int, limit: int = 50) -> DataFrame:
    """The newest k states of each document, ``limit`` in all."""
    order = [F.desc_nulls_last("ts"), F.desc("line_number")]
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k).orderBy(*order, "document_id").limit(limit)


def search_in_conversation(messages: DataFrame, document_id: int, query: str, limit: int) -> DataFrame:
    """A document's hits in order, one more than asked for to tell whether there are more."""
    return score_messages(messages.where(F.col("document_id") == document_id), query).orderBy("line_number").limit(limit + 1)


def search_documents(docs: DataFrame, query: str, offset: int, limit: int) -> DataFrame:
    """A page of documents whose title or path contains the query, or whose text has all its tokens; newest first."""
    named = docs.where(ilike_contains(F.col("title"), query) | ilike_contains(F.col("relative_path"), query))
    found = named.select("document_id", "synced").union(fts_match(docs, query).select("document_id", "synced")).distinct()
    return found.orderBy(F.desc("synced"), "document_id").offset(offset).limit(limit)


def hybrid_search(semantic: DataFrame, lexical: DataFrame, graph: DataFrame, limit: int) -> DataFrame:
    """Hits of three searches, each path once at its best score: semantic as scored, lexical 0.5, graph 0.7."""
    hits = semantic.select("path", "score").union(lexical.select("path", F.lit(0.5))).union(graph.select("path", F.lit(0.7)))
    return hits.groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def clean_path(path: Column) -> Column:
    """A plain path of a file URL: decoded, without the scheme, a verbatim prefix or a trailing slash."""
    plain = F.when(path.startswith("file:///"), F.try_url_decode(F.regexp_replace(F.substring(path, 9, 4096), r"\+", "%2B"))).otherwise(path)
    return F.regexp_replace(F.regexp_replace(plain, r"^\\\\\?\\", ""), r"(?<=.)/+$", "")


def display_name(tool: Column) -> Column:
    """A tool's name for people."""
    table = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, tool), F.initcap(F.translate(tool, "_-", "  ")))


def geo_tag(views: DataFrame, ranges: DataFrame) -> DataFrame:
    """``views(view_id, ip)`` with the country of the range that holds the address, blank on a miss.

    ``ranges(low, high, country)`` are disjoint; a range meets addresses by its first octets.
    """
    octets = F.split("ip", r"\.")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda x, o: x * 256 + o.cast("bigint"))
    asked = views.where(F.col("ip").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).withColumn("number", number).withColumn("octet", F.floor(F.col("number") / 16777216))
    by_octet = ranges.withColumn("octet", F.explode(F.sequence(F.floor(F.col("low") / 16777216), F.floor(F.col("high") / 16777216))))
    hit = asked.join(by_octet, "octet").where(F.col("number").between(F.col("low"), F.col("high"))).select("view_id", "country")
    return views.join(hit, "view_id", "left").select("view_id", F.coalesce("country", F.lit("")).alias("country"))


def split_codex_user(text: Column) -> tuple[Column, Column]:
    """Role and text of a user payload: what follows the request's heading, or system for a wrapper without one."""
    request = F.regexp_extract(text, r"(?s)## My request for Codex:\s*(.*)\z", 1)
    wrapped = F.ltrim(text).rlike(r"^(<environment_context>|<user_instructions>|# AGENTS\.md|# Context from my IDE setup:)")
    role = F.when(request != "", "user").when(wrapped, "system").otherwise("user")
    return role, F.when(request != "", F.trim(request)).otherwise(F.trim(text))


def pending_interactions(messages: DataFrame, limit: int = 64) -> DataFrame:
    """Open questions: those (kind 'question') without an answer of their id and without a later prompt."""
    questions = messages.where("kind = 'question'")
    answers = messages.where("kind = 'answer'").select("document_id", "question_id").distinct()
    prompts = messages.where("kind = 'prompt'").groupBy("document_id").agg(F.max("line_number").alias("last_prompt"))
    is_open = questions.join(answers, ["document_id", "question_id"], "left_anti").join(prompts, "document_id", "left")
    is_open = is_open.where("last_prompt is null or line_number > last_prompt")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("line_number"))
    return is_open.withColumn("place", place).where(F.col("place") <= limit).select("document_id", "question_id", "line_number")


def current_task_state(states: DataFrame) -> DataFrame:
    """Per document the best state: one marked current, then the last line, then the highest id."""
    best = F.max_by("message_id", F.struct(F.coalesce("is_current", F.lit(False)), "line_number", "message_id"))
    return states.groupBy("document_id").agg(best.alias("message_id"))


def project_timeline(docs: DataFrame) -> DataFrame:
    """Groups by root session, else by document, with their members and newest time."""
    group = F.coalesce("root_session_id", "thread", F.col("document_id").cast("string"))
    return docs.groupBy("tool_id", group.alias("group_key")).agg(F.count("*").alias("members"), F.max(F.coalesce("activity", F.least("mtime", "synced"))).alias("ts"))


def extraction_inputs(messages: DataFrame, previous: DataFrame, budget: int = 4000, least: int = 200) -> DataFrame:
    """Conversations whose role-tagged text is long enough and differs from the one seen before."""
    digest = conversation_digest(messages, budget, budget).where(F.length("digest") >= least)
    new = digest.withColumn("hash", F.sha2("digest", 256))
    return new.join(previous.select("document_id", "hash"), ["document_id", "hash"], "left_anti").select("document_id", "hash")


def parse_extraction(reply: Column) -> Column:
    """Entities and relations of a reply: from its first to its last brace, whatever stands around."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.from_json(body, "entities array<struct<name: string, type: string, summary: string>>, relations array<struct<source: string, target: string, type: string>>")


def replace_by_document(stored: DataFrame, fresh: DataFrame, valid: DataFrame) -> DataFrame:
    """Stored rows, with those of validly answered documents replaced by the fresh ones."""
    done = valid.select("document_id").distinct()
    return stored.join(done, "document_id", "left_anti").unionByName(fresh.join(done, "document_id", "left_semi"))


def embedding_text(docs: DataFrame, messages: DataFrame, count: int = 100, chars: int = 4000, budget: int = 100_000) -> DataFrame:
    """A document's text, else its first messages together; nothing under 100 characters."""
    said = newest_ranked(messages.where("role in ('user', 'assistant')"), "document_id", [F.col("line_number")], count)
    kept = take_within_budget(said, "document_id", ["line_number"], "content", budget, chars)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "content"))), lambda x: x["content"])
    together = kept.groupBy("document_id").agg(F.array_join(parts, "\n").alias("said"))
    text = F.coalesce(F.nullif("content", F.lit("")), F.col("said"))
    return docs.join(together, "document_id", "left").select("document_id", text.alias("text")).where(F.length("text") >= 100)


def newest_ranked(rows: DataFrame, part: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each part."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def assign_tier(category: Column, current: Column) -> Column:
    """quality for curated categories; a document that has it keeps it."""
    return F.when((current == "quality") | category.isin(*QUALITY_CATEGORIES), "quality").otherwise("fast")


def coalesce_queue(items: DataFrame) -> DataFrame:
    """Per source what is still to send: the last full item, and behind it the last delta of each base."""
    last_full = items.where("mode = 'full'").groupBy("source").agg(F.max("item_id").alias("_full"))
    behind = items.join(last_full, "source", "left").where(F.col("_full").isNull() | (F.col("item_id") >= F.col("_full"))).drop("_full")
    return newest_per_key(behind, ["source", "mode", "base_offset"], [F.desc("item_id")])


def delivery_state(prior: DataFrame, batch: DataFrame) -> DataFrame:
    """Per document the latest delivery; its activity only moves forward."""
    both = prior.unionByName(batch)
    return both.groupBy("document_id").agg(F.max_by("hash", F.struct("delivered", "hash")).alias("hash"), F.max("delivered").alias("delivered"), F.max("activity").alias("activity"))


def dashboard_projection(docs: DataFrame, prior: DataFrame) -> DataFrame:
    """A narrow row for each document, and whether it differs from the stored one."""
    new = docs.select("document_id", "tool_id", "title", fingerprint("tool_id", "title", "category").alias("row_hash"))
    return new.join(prior.select("document_id", F.col("row_hash").alias("_hash")), "document_id", "left").withColumn(
        "changed", ~F.col("row_hash").eqNullSafe(F.col("_hash"))
    ).drop("_hash")


def refresh_fts(docs: DataFrame, messages: DataFrame, count: int = 200, chars: int = 2048, budget: int = 200 << 10) -> DataFrame:
    """Per document the number of index tokens of its title and its last messages."""
    last = newest_ranked(messages.where("role in ('user', 'assistant')"), "document_id", [F.desc("line_number")], count)
    kept = take_within_budget(last, "document_id", ["line_number"], "content", budget, chars)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_number", "content"))), lambda x: x["content"])
    said = kept.groupBy("document_id").agg(F.array_join(parts, " ").alias("said"))
    text = F.concat_ws(" ", "title", "said")
    return docs.join(said, "document_id", "left").select("document_id", F.size(tokens(text)).alias("tokens"))


def clean_discovery(rows: DataFrame) -> DataFrame:
    """machine_id, tool_id, root, path: the projects that machines' inventories name, one row without a path for a tool without any.

    ``rows(machine_id, content)`` hold a JSON object of tools, each with ``root`` and
    ``projects``. Paths are decoded and lose a verbatim prefix; what isn't encoded well stays.
    """
    tools = F.from_json("content", "map<string, struct<root: string, projects: array<struct<path: string>>>>")

    def plain(path: Column) -> Column:
        return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), r"^\\\\?\?\\", "")

    named = rows.select("machine_id", F.explode(tools).alias("tool_id", "t"))
    found = named.select("machine_id", "tool_id", "t.root", F.explode_outer("t.projects").alias("p"))
    return found.select("machine_id", "tool_id", plain(F.col("root")).alias("root"), plain(F.col("p.path")).alias("path"))


def list_files(docs: DataFrame, activity: DataFrame, where: Column, offset: int, limit: int) -> DataFrame:
    """A page of the newest copies of the paths ``where`` holds, the most recently active first.

    ``activity(document_id, ts)``: a file without any goes by the time it was synced.
    """
    files = newest_per_key(docs.where(where), ["machine_id", "relative_path"], [F.desc("synced"), F.desc("document_id")])
    rows = files.join(activity.select("document_id", "ts"), "document_id", "left").withColumn("active_at", F.coalesce("ts", "synced"))
    return rows.orderBy(F.desc("active_at"), "document_id").offset(offset).limit(limit)


def project_detail(docs: DataFrame, most: int = 15) -> DataFrame:
    """The newest ``most`` documents of each project and category, each with how many there are."""
    keys = ["project", "category"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("synced"), "document_id"))
    newest = docs.withColumn("place", place).where(F.col("place") <= most)
    return newest.join(docs.groupBy(*keys).agg(F.count("*").alias("total")), keys)


def project_conversations(messages: DataFrame, folded: DataFrame, ends: int = 20) -> DataFrame:
    """The first and the last ``ends`` messages of each root, those of its children among them by time."""
    rows = messages.join(folded.select("document_id", "root"), "document_id")

    def clipped(*order: Column) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where(F.col("_n") <= ends).drop("_n")

    keys = ("ts", "document_id", "line_number")
    return clipped(*map(F.asc, keys)).unionByName(clipped(*map(F.desc, keys))).dropDuplicates(["root", *keys])


def prove_snapshot(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """document_id, proven: whether all that was recorded of a source equals what its text shows; unknown sources aren't proven."""
    columns = [c for c in recorded.columns if c != "document_id"]
    renamed = recorded.select("document_id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in columns])
    equal = F.coalesce("_known", F.lit(False))
    for c in columns:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return found.join(renamed, "document_id", "left").select("document_id", equal.alias("proven"))


def live_signals(lines: DataFrame, tail: int = 2000) -> DataFrame:
    """document_id, call_id, status: the latest status of each call in the last ``tail`` lines of its transcript."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("line_number")))
    late = lines.withColumn("_n", place).where(F.col("_n") <= tail).where("call_id is not null")
    return late.groupBy("document_id", "call_id").agg(F.max_by("status", "line_number").alias("status"))
