"""Ingest as batch jobs: deduplicated signals, facts, summaries, sessions and curation merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions import gate
from pricetide.functions import text as T
from pricetide.functions.urls import content_hash
from pricetide.operators.dedup import first_by, merge_note, merge_text, new_only
from pricetide.operators.extract import extract_listings

SIGNAL_KEY = ["source_type", "source_ref", "content_hash"]


def hashed(signals: DataFrame) -> DataFrame:
    return signals.withColumn("content_hash", content_hash("raw_text"))


def new_signals(signals: DataFrame, known: DataFrame, order: str = "signal_id") -> DataFrame:
    """One signal of each key that isn't known; a null reference equals a null one."""
    return new_only(hashed(signals), known, SIGNAL_KEY, order)


def new_web_signals(signals: DataFrame, known: DataFrame, order: str = "signal_id") -> DataFrame:
    """The coarser rule for web pages: one signal of each reference."""
    return new_only(hashed(signals), known, SIGNAL_KEY[:2], order)


def facts(signals: DataFrame) -> DataFrame:
    """Price observations of signals: extraction, gate, price per m², the review flag and the month to partition by.

    The capture time becomes the time of the observation; without one it stays null.
    """
    named = {"name": F.substring("item_text", 1, 60), "project_name": F.lit(None).cast("string"), "building_name": F.lit(None).cast("string"), "house_number": F.lit(None).cast("string"), "location_text": F.lit(None).cast("string")}
    found = extract_listings(signals, "raw_text").withColumns({k: v for k, v in named.items() if k not in signals.columns})
    out = found.withColumns({"price_per_m2": gate.price_per_m2(), "needs_review": gate.should_review(), "reason": gate.rejection_reason()})
    if "captured_at" in signals.columns:
        out = out.withColumn("observed_at", F.col("captured_at")).withColumn("month", F.date_format("captured_at", "yyyy-MM"))
    return out


MESSAGE = "raw_text string, source_type string, source_ref string, captured_at timestamp"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages (JSON lines) as signals: without a type they are a broker's, blank references and texts are none."""
    raw = spark.read.schema(MESSAGE).json(path)
    trimmed = raw.withColumns({"raw_text": F.trim("raw_text"), "source_ref": F.nullif(F.trim("source_ref"), F.lit("")), "source_type": F.coalesce("source_type", F.lit("broker"))})
    return trimmed.where("raw_text <> ''")


def curation_drafts(session: DataFrame, derived: DataFrame) -> DataFrame:
    """Drafts of a session and those derived from its hierarchy, each marked with where it comes from."""
    return session.withColumn("origin", F.lit("session")).unionByName(derived.withColumn("origin", F.lit("hierarchy")), allowMissingColumns=True)


def backfill(properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, buildings) of old property rows (project_name, building_name): one spelling of each normalized name.

    The least spelling counts; blank names make no row, and a building needs its project.
    """
    norm = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    named = properties.select("project_name", "building_name", norm("project_name").alias("project"), norm("building_name").alias("building")).where("project is not null")
    projects = named.groupBy(F.col("project").alias("name_normalized")).agg(F.min("project_name").alias("name"))
    buildings = named.where("building is not null").groupBy("project", F.col("building").alias("name_normalized")).agg(F.min("building_name").alias("name"))
    return projects, buildings


def append_facts(rows: DataFrame, path: str) -> None:
    """Append accepted observations, partitioned by month."""
    rows.where("reason is null").drop("reason").write.mode("append").partitionBy("month").parquet(path)


def batch_summary(outcomes: DataFrame, key: str) -> DataFrame:
    """created, linked, review and rejected by key, from rows with an ``outcome``."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return outcomes.groupBy(key).agg(n("created").alias("created"), n("linked").alias("linked"), n("review").alias("review"), n("rejected").alias("rejected"))


def signal_status(outcomes: DataFrame, key: str) -> DataFrame:
    """ignored where nothing was kept, needs_review where something waits, else extracted."""
    s = batch_summary(outcomes, key)
    kept = F.col("created") + F.col("linked") + F.col("review")
    return s.withColumn("status", F.when(kept == 0, "ignored").when(F.col("review") > 0, "needs_review").otherwise("extracted"))


def transcript(messages: DataFrame, session: str, order: str, role: str, text: str, sep: str = "\n\n---\n\n") -> DataFrame:
    """(session, transcript, n_messages): the user's messages in order."""
    said = F.array_sort(F.collect_list(F.when(F.col(role) == "user", F.struct(F.col(order).alias("o"), F.trim(text).alias("t")))))
    return messages.groupBy(session).agg(F.array_join(F.transform(F.filter(said, lambda m: m["t"] != ""), lambda m: m["t"]), sep).alias("transcript"), F.count(F.when(F.col(role) == "user", 1)).alias("n_messages"))


def attachments(messages: DataFrame, session: str, order: str, column: str, most: int = 8) -> DataFrame:
    """(session, attachments): sound ones (with key and url) in order, at most so many a message."""
    sound = F.slice(F.filter(column, lambda a: F.coalesce((a["key"] != "") & (a["url"] != ""), F.lit(False))), 1, most)
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), sound.alias("a"))))
    return messages.groupBy(session).agg(F.flatten(F.transform(held, lambda m: m["a"])).alias("attachments"))


def draft_progress(drafts: DataFrame, session: str) -> DataFrame:
    """(session, total, complete, percent, ready) over extraction rows of open drafts."""
    done = gate.is_complete()
    out = drafts.groupBy(session).agg(F.count("*").alias("total"), F.count(F.when(done, 1)).alias("complete"))
    return out.withColumns({"percent": F.round(100 * F.col("complete") / F.col("total")).cast("int"), "ready": F.col("complete") == F.col("total")})


def session_title(drafts: DataFrame, session: str, order: str) -> DataFrame:
    """The first project name, else the first name, else a fallback; 80 characters at most."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col(order)))
    return drafts.groupBy(session).agg(F.substring(F.coalesce(first("project_name"), first("name"), F.lit("Untitled session")), 1, 80).alias("title"))


def committed(sessions: DataFrame, drafts: DataFrame, messages: DataFrame) -> DataFrame:
    """Signals of the sessions that are ready: (session_id, source_type, source_ref, raw_text, content_hash)."""
    ready = draft_progress(drafts, "session_id").where("ready").select("session_id")
    open_ones = sessions.where("status = 'open'").select("session_id").join(ready, "session_id", "left_semi")
    text = transcript(messages, "session_id", "turn", "role", "text")
    made = open_ones.join(text, "session_id").select("session_id", F.lit("chat").alias("source_type"), F.concat(F.lit("session:"), F.col("session_id").cast("string")).alias("source_ref"), F.col("transcript").alias("raw_text"))
    return hashed(made)


def merged_curation(entities: DataFrame, drafts: DataFrame, note_prefix: str = "Note: ") -> DataFrame:
    """Entities (id, aliases, tags, address, notes) after drafts (id, aliases, tags, address, note): unions, kept addresses, notes once."""
    d = drafts.select("id", *(F.col(c).alias(f"_{c}") for c in ("aliases", "tags", "address", "note")))
    joined = entities.join(d, "id", "left")
    return joined.withColumns(
        {
            "aliases": merge_text(F.col("aliases"), F.col("_aliases"), T.unique_text),
            "tags": merge_text(F.col("tags"), F.col("_tags"), T.unique_text),
            "address": F.coalesce(F.nullif(F.trim("address"), F.lit("")), F.col("_address")),
            "notes": merge_note(F.col("notes"), F.col("_note"), note_prefix),
        }
    ).select(*entities.columns)


def research_key(project: Column, building: Column, scope: Column, urls: Column) -> Column:
    return F.sha2(F.concat_ws("|", T.normalize_name(project), T.normalize_name(building), scope, F.array_join(F.array_sort(urls), ",")), 256)


def merged_research(old: DataFrame, new: DataFrame, keep: int = 10) -> DataFrame:
    """Records (entity_id, key, at, ...): a new one replaces that of its key, and the last ``keep`` of an entity stay."""
    both = first_by(old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))), ["entity_id", "key"], F.desc("_new"), F.desc("at"))
    return first_by(both, ["entity_id"], F.desc("at"), F.desc("key"), k=keep).drop("_new")


def research_record(scope: str, facts_column: str, evidence_column: str, most: int = 5) -> Column:
    """Struct of the facts that apply to a scope and the first evidence rows."""
    own = F.filter(facts_column, lambda f: (f["applies_to"] == scope) | (f["applies_to"] == "both"))
    return F.struct(F.lit(scope).alias("scope"), own.alias("facts"), F.slice(F.col(evidence_column), 1, most).alias("evidence"))
