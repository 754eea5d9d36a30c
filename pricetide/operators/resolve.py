"""Entity resolution of extractions against properties, set at a time.

Blocking is exact: a token of an extraction is a substring of an entity's text only if the text holds all trigrams of the
token, so its rarest one joins by equality and ``contains`` verifies. Scoring is column arithmetic over the candidates, and
a window keeps the best. Extractions have ext_id and the extraction record's columns; entities have property_id, name,
project_name, building_name, house_number, aliases, wiki_notes, type, area_m2 and maybe more. Ids are unique.

Rows of equal columns are of one kind. Kinds are matched and scored once, however many rows they have, and results go to
their rows at the end: all of them where pairs are wanted, the least ids where the best are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import gate
from pricetide.functions import text as T
from pricetide.operators.dedup import first_by, new_only
from pricetide.operators.kinds import expanded, kinds
from pricetide.operators.quantiles import beside
from pricetide.session import cut

LINK_FROM, REVIEW_FROM, KEEP = 0.80, 0.45, 10
NAMES = ("name", "project_name", "building_name", "house_number", "location_text", "aliases")  # what tokens come from
TEXTS = ("name", "project_name", "building_name", "house_number", "aliases", "wiki_notes")  # where they are looked for
_NONE = "array<string>"


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_NONE))


def blocking_tokens(extractions: DataFrame) -> DataFrame:
    """(ext_id, token): distinct tokens of three letters or more of project or name, building, unit, location and aliases."""
    fields = F.array(T.clean_project_name(F.coalesce("project_name", "name")), F.col("building_name"), F.col("house_number"), F.col("location_text"))
    words = F.flatten(F.transform(F.filter(F.concat(fields, _strings("aliases")), lambda x: x.isNotNull()), lambda x: T.tokens(T.normalize_name(x))))
    return extractions.select("ext_id", F.explode(F.array_distinct(words)).alias("token"))


def trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def entity_text(*columns: str | Column) -> Column:
    """Normalized fields of an entity, one to a line, so that no token spans two."""
    return F.array_join(F.transform(F.filter(F.array(*(F.col(c) if isinstance(c, str) else c for c in columns)), lambda x: x.isNotNull()), T.normalize_name), "\n")


def token_matches(wanted: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(ext_id, key): entities (key, search_text) whose text holds a token of the extraction.

    A token is looked for where the rarest of its trigrams is; one with a trigram that no text has is nowhere. Tokens go
    beside the trigrams of the texts if they are few, else by trigram and salt, so a common trigram isn't one task.
    """
    spread = texts.select(key, F.explode(trigrams(F.col("search_text"))).alias("gram"))
    counts = spread.groupBy("gram").agg(F.count("*").alias("n"))
    grams = wanted.select("token").distinct().select("token", F.explode(trigrams(F.col("token"))).alias("gram"))
    n = F.coalesce("n", F.lit(0))
    rarest = grams.join(counts, "gram", "left").groupBy("token").agg(F.min(n).alias("least"), F.min_by("gram", F.struct(n, "gram")).alias("own_gram"))
    tokens = cut(rarest.where("least > 0").select("token", "own_gram"))
    maybe = beside(spread, tokens, F.col("gram") == F.col("own_gram"), F.col(key)).select(key, "token")  # keys alone; a text moves once it can be a hit
    hits = maybe.join(texts.select(key, "search_text"), key).where(F.col("search_text").contains(F.col("token"))).select(key, "token").distinct()
    return wanted.join(hits, "token").select("ext_id", key).distinct()


def canonical(entities: DataFrame, pointer: str = "canonical_id") -> DataFrame:
    """Entities that aren't merged into another; all where there is no such column."""
    return entities.where(F.col(pointer).isNull()) if pointer in entities.columns else entities


def candidates(extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """(ext_id, property_id): canonical entities of which a field holds a blocking token."""
    askers, asked = kinds(extractions, "ext_id", NAMES)
    holders, held = kinds(canonical(entities), "property_id", TEXTS)
    aliases = F.array_join(_strings("aliases"), " ")
    texts = held.select("property_id", entity_text("name", "project_name", "building_name", "house_number", aliases, "wiki_notes").alias("search_text"))
    return expanded(token_matches(blocking_tokens(asked), texts, "property_id"), askers, holders, "ext_id", "property_id")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def keyed_extractions(extractions: DataFrame) -> DataFrame:
    """(ext_id, e): what the score needs of an extraction, with names normalized once."""
    shown = T.display_name("project_name", "building_name", "house_number", "name", "location_text")
    e = F.struct(
        T.keyed(T.clean_project_name(F.coalesce("project_name", "name"))).alias("project"),
        T.keyed("building_name").alias("building"),
        T.keyed("house_number").alias("unit"),
        T.keyed(shown).alias("shown"),
        (_filled("project_name") | _filled("building_name")).alias("tiered"),
        F.col("type"),
        F.col("area_m2"),
    )
    return extractions.select("ext_id", e.alias("e"))


def keyed_entities(entities: DataFrame) -> DataFrame:
    """(property_id, c): what the score needs of an entity."""
    aliases = _strings("aliases")
    known = F.concat(F.array(F.coalesce("project_name", "name"), F.col("name")), aliases)
    identities = T.unique_text(F.concat(known, F.transform(known, T.clean_project_name)))
    c = F.struct(
        F.transform(identities, T.keyed).alias("identities"),
        T.keyed("building_name").alias("building"),
        T.keyed("house_number").alias("unit"),
        F.transform(F.concat(F.array("name", "project_name"), aliases), T.keyed).alias("names"),
        (_filled("project_name") & ~_filled("building_name") & ~_filled("house_number")).alias("whole"),
        (_filled("project_name") | _filled("building_name")).alias("tiered"),
        F.col("type"),
        F.col("area_m2"),
    )
    return entities.select("property_id", c.alias("c"))


def score() -> Column:
    """Weighted score of a keyed extraction (e) against a keyed entity (c).

    A candidate that is a whole project counts by its project; with a hierarchy on either side project, building, unit
    and name count, without one the name alone. The type and an area within 10 % add a tenth each.
    """
    e, c = (lambda n: F.col(f"e.{n}")), (lambda n: F.col(f"c.{n}"))
    project, name = T.max_keyed_sim(e("project"), c("identities")), T.max_keyed_sim(e("shown"), c("names"))
    building, unit = T.keyed_sim(e("building"), c("building")), T.keyed_sim(e("unit"), c("unit"))
    identity = F.when(c("whole"), 0.76 * project + 0.14 * name).when(e("tiered") | c("tiered"), 0.42 * project + 0.22 * building + 0.18 * unit + 0.08 * name).otherwise(0.72 * name)
    same_type = F.coalesce((e("type") != "unknown") & (e("type") == c("type")), F.lit(False))
    same_area = F.coalesce((c("area_m2") > 0) & (F.abs(e("area_m2") - c("area_m2")) / c("area_m2") <= 0.1), F.lit(False))
    return identity + 0.1 * same_type.cast("double") + 0.1 * same_area.cast("double")


def best_of_kinds(scored: DataFrame, members: DataFrame, key: str, keep: int, *order: Column | str) -> DataFrame:
    """scored (ext_id, kinds as ``key``, and the columns of the order) as the best members of each ext_id, with ``rank``.

    Members of a kind differ by their key alone, which ends the order; so the best are among the least keys of the kinds
    whose own least keys are best.
    """
    few = cut(first_by(members, ["kind"], key, k=keep))
    least = few.groupBy("kind").agg(F.min(key).alias("_least"))
    heads = first_by(scored.join(least, F.col(key) == F.col("kind")).drop("kind"), ["ext_id"], *order, "_least", k=keep)
    named = heads.withColumnRenamed(key, "kind").drop("_least").join(few, "kind").drop("kind")
    rank = F.row_number().over(Window.partitionBy("ext_id").orderBy(*order, key))
    return named.withColumn("rank", rank).where(F.col("rank") <= keep)


def to_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """found, with a row for each member (ext_id, kind) of the kind in its ext_id."""
    return found.withColumnRenamed("ext_id", "kind").join(members, "kind").drop("kind")


def ranked_candidates(extractions: DataFrame, entities: DataFrame, keep: int = KEEP, pairs: DataFrame | None = None, extra: Column | None = None) -> DataFrame:
    """(ext_id, property_id, score, rank): the best candidates of positive score.

    ``pairs`` (ext_id, property_id and more) takes the place of the token blocks; ``extra`` over its columns adds to the score.
    """
    if pairs is None:
        askers, asked = kinds(extractions, "ext_id", (*NAMES, "type", "area_m2"))
        holders, held = kinds(canonical(entities), "property_id", (*TEXTS, "type", "area_m2"))
        scored = scores(candidates(asked, held), asked, held, extra)
        best = best_of_kinds(scored, holders, "property_id", keep, F.desc("score"))
        return to_members(best, askers).select("ext_id", "property_id", "score", "rank")
    rank = F.row_number().over(Window.partitionBy("ext_id").orderBy(F.desc("score"), "property_id"))
    return scores(pairs, extractions, entities, extra).withColumn("rank", rank).where(F.col("rank") <= keep)


def scores(pairs: DataFrame, extractions: DataFrame, entities: DataFrame, extra: Column | None = None) -> DataFrame:
    """(ext_id, property_id, score) of pairs, where it is positive."""
    total = score() if extra is None else score() + extra
    both = pairs.join(keyed_extractions(extractions), "ext_id").join(keyed_entities(entities), "property_id")
    return both.select("ext_id", "property_id", F.round(total, 12).alias("score")).where("score > 0")


def decision(best: Column) -> Column:
    return F.when(best >= LINK_FROM, "link").when(best >= REVIEW_FROM, "review").otherwise("create")


def resolve(extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """(ext_id, action, property_id, best): the best candidate and what to do."""
    best = ranked_candidates(extractions, entities, 1).select("ext_id", "property_id", F.col("score").alias("best"))
    found = extractions.select("ext_id").join(best, "ext_id", "left").withColumn("action", decision(F.coalesce("best", F.lit(0.0))))
    return found.select("ext_id", "action", F.when(F.col("action") == "link", F.col("property_id")).alias("property_id"), "best")


def persist_decisions(extractions: DataFrame, entities: DataFrame, parents: DataFrame) -> DataFrame:
    """(ext_id, outcome, reason, property_id): reject, review, link or create.

    An extraction that would create a property under a project that ``parents`` (name_normalized) doesn't know is for review.
    """
    gated = extractions.select("ext_id", gate.rejection_reason().alias("reason"), gate.should_review().alias("doubtful"), T.normalize_name(F.coalesce("project_name", "building_name")).alias("parent"))
    grounded = parents.select(F.col("name_normalized").alias("parent"), F.lit(True).alias("grounded")).distinct()
    joined = gated.join(resolve(extractions, entities), "ext_id").join(grounded, "parent", "left")
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("action") == "review", "review")
        .when(F.col("action") == "link", F.when(F.col("doubtful"), "review").otherwise("linked"))
        .when(F.col("doubtful"), "review")
        .when(F.col("parent").isNotNull() & F.col("grounded").isNull(), "review")
        .otherwise("created")
    )
    return joined.select("ext_id", outcome.alias("outcome"), "reason", "property_id")


def created_entities(extractions: DataFrame) -> DataFrame:
    """New property rows: names, normalized keys, aliases without the own name, tags."""
    shown = T.display_name("project_name", "building_name", "house_number", "name", "location_text")
    own = extractions.withColumn("display", shown)
    aliases = F.filter(T.unique_text(F.concat(F.array("name"), _strings("aliases"))), lambda a: T.normalize_name(a) != T.normalize_name("display"))
    project = T.split_name_tags("project_name")
    tags = T.unique_text(F.concat(project["tags"], T.split_name_tags("name")["tags"], _strings("tags")))
    return own.select(
        F.sha2(F.concat_ws("|", T.normalize_name("display"), F.coalesce("type", F.lit("unknown"))), 256).alias("property_id"),
        F.col("display").alias("name"), T.normalize_name("display").alias("name_normalized"), project["name"].alias("project_name"), "building_name", "house_number",
        aliases.alias("aliases"), tags.alias("tags"), F.coalesce("type", F.lit("unknown")).alias("type"), "area_m2", "location_text",
    )


def get_or_create(names: DataFrame, known: DataFrame) -> DataFrame:
    """Rows to append to ``known`` (name, name_normalized): the first spelling of each new normalized name."""
    fresh = names.select(T.clean_project_name("name").alias("name")).where("name is not null").withColumn("name_normalized", T.normalize_name("name"))
    return new_only(fresh.where("name_normalized <> ''"), known, ["name_normalized"], "name")


def search_entities(queries: DataFrame, projects: DataFrame, buildings: DataFrame, properties: DataFrame, k: int = 8) -> DataFrame:
    """(ext_id, entity_type, id, name): up to k entities of three tables (id, name, search columns) that hold a token; projects first."""
    askers = queries.groupBy("ext_id").agg(F.array_sort(F.collect_set("token")).alias("tokens")).withColumn("kind", F.unhex(F.md5(F.array_join("tokens", " "))))
    asked = cut(askers.select(F.col("kind").alias("ext_id"), "tokens").distinct()).select("ext_id", F.explode("tokens").alias("token"))
    out = None
    for place, (kind, df) in enumerate((("project", projects), ("building", buildings), ("property", properties))):
        fields = tuple(c for c in df.columns if c != "id")
        holders, held = kinds(df.withColumn("id", F.col("id").cast("string")), "id", fields)
        texts = held.select("id", entity_text(*fields).alias("search_text"))
        hits = token_matches(asked, texts, "id").join(held.select("id", "name"), "id")
        best = best_of_kinds(hits, holders, "id", k, "name").select("ext_id", F.lit(place).alias("place"), F.lit(kind).alias("entity_type"), "id", "name")
        out = best if out is None else out.unionByName(best)
    return to_members(first_by(out, ["ext_id"], "place", "name", "id", k=k).drop("place"), askers.select("ext_id", "kind"))


HIERARCHY_LEAST, HIERARCHY_MARGIN = 0.72, 0.12


def hierarchy_score(project: Column, building: Column, other_project: Column, other_building: Column) -> Column:
    """0.68 of the project's and 0.32 of the building's similarity; the project's alone where no building is named."""
    p, b = T.near_sim(project, other_project), T.near_sim(building, other_building)
    return F.when(F.coalesce(building, F.lit("")) == "", p).otherwise(0.68 * p + 0.32 * b)


def choose_hierarchy(wanted: DataFrame, matches: DataFrame) -> DataFrame:
    """(ext_id, project_name, building_name, score): the best match of each extraction if it is good and clearly best.

    wanted: ext_id, project, building; matches: ext_id, project_name, building_name. A runner-up within the margin
    stands in the way unless it names the same hierarchy.
    """
    scored = wanted.join(matches, "ext_id").withColumn("score", F.round(hierarchy_score(F.col("project"), F.col("building"), F.col("project_name"), F.col("building_name")), 12))
    same = F.struct(T.normalize_name("project_name").alias("p"), F.coalesce(T.normalize_name("building_name"), F.lit("")).alias("b"))
    order = Window.partitionBy("ext_id").orderBy(F.desc("score"), "project_name", "building_name")
    ranked = first_by(scored.withColumn("same", same), ["ext_id", "same"], F.desc("score"), "project_name", "building_name")
    placed = ranked.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    clear = F.col("next").isNull() | (F.col("score") - F.col("next") >= HIERARCHY_MARGIN)
    return placed.where((F.col("rank") == 1) & (F.col("score") >= HIERARCHY_LEAST) & clear).select("ext_id", "project_name", "building_name", "score")


def evidence_support(names: DataFrame, evidence: DataFrame, column: str, least_results: int, share: float = 0.75) -> DataFrame:
    """(ext_id, results, supported): evidence rows (ext_id, title, url, snippet) that hold enough of a name's tokens."""
    words = T.tokens(T.normalize_name(column))
    text = T.normalize_name(F.concat_ws(" ", "title", "snippet", "url"))
    joined = names.select("ext_id", words.alias("words")).join(evidence.select("ext_id", text.alias("hay")), "ext_id", "left")
    found = F.size(F.filter("words", lambda w: F.col("hay").contains(w)))
    hit = (F.size("words") > 0) & (found >= share * F.size("words"))
    return joined.groupBy("ext_id").agg(F.count(F.when(hit, 1)).alias("results")).withColumn("supported", F.col("results") >= least_results)


def apply_hierarchy(extractions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Extractions with the names of the chosen hierarchy; the old label becomes an alias."""
    c = chosen.select("ext_id", F.col("project_name").alias("_p"), F.col("building_name").alias("_b"))
    joined = extractions.join(c, "ext_id", "left")
    hit = F.col("_p").isNotNull()
    aliases = F.when(hit, T.unique_text(F.concat(F.array("name", "project_name"), _strings("aliases")))).otherwise(_strings("aliases"))
    project, building = F.coalesce("_p", "project_name"), F.when(hit, F.coalesce("_b", "building_name")).otherwise(F.col("building_name"))
    label = T.display_name(project, building, "house_number", "name", "location_text")
    return joined.withColumns({"aliases": aliases, "name": F.when(hit, label).otherwise(F.col("name")), "building_name": building}).withColumn("project_name", project).drop("_p", "_b")


def apply_reviews(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Observations (obs_id, property_id, needs_review, version) after decisions (obs_id, action, target_id): new versions."""
    d = decisions.select("obs_id", "action", "target_id")
    joined = observations.join(d, "obs_id", "left")
    touched = F.col("action").isin("link", "create", "dismiss")
    return joined.select(
        "obs_id",
        F.when(F.col("action").isin("link", "create"), F.col("target_id")).otherwise(F.col("property_id")).alias("property_id"),
        F.when(F.coalesce(touched, F.lit(False)), False).otherwise(F.col("needs_review")).alias("needs_review"),
        F.coalesce(F.col("action") == "dismiss", F.lit(False)).alias("dismissed"),
        (F.col("version") + F.coalesce(touched, F.lit(False)).cast("int")).alias("version"),
    )


def create_suggestion(raw: Column | str, ref: Column | str) -> Column:
    """Struct (project_name, building_name, house_number, label): what a reviewer would create from an extraction."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    project = T.clean_project_name(F.coalesce("project_name", "name"))
    building = F.coalesce(blank("building_name"), T.infer_building(project, raw, ref))
    label = F.nullif(F.concat_ws(" / ", blank(project), building, blank("house_number")), F.lit(""))
    return F.struct(project.alias("project_name"), building.alias("building_name"), blank("house_number").alias("house_number"), F.coalesce(label, "name", F.lit("(new property)")).alias("label"))


def review_queue(observations: DataFrame, signals: DataFrame, entities: DataFrame, newest: str = "created_at", limit: int | None = None) -> DataFrame:
    """What waits for a reviewer: the observation, its signal, the best candidates and what could be created instead.

    observations: ext_id, signal_id, needs_review, ``newest`` and the extraction record; signals: signal_id, raw_text,
    source_type, source_ref. ``limit`` keeps the newest ones (the page a reviewer opens).
    """
    waiting = observations.where("needs_review")
    if limit is not None:
        waiting = waiting.orderBy(F.desc(newest), "ext_id").limit(limit)
    seen = waiting.join(signals.select("signal_id", "raw_text", "source_type", "source_ref"), "signal_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "property_id", "score")))  # KEEP at most
    found = ranked_candidates(waiting, entities).groupBy("ext_id").agg(listed.alias("candidates"))
    none = F.array().cast("array<struct<rank:int,property_id:bigint,score:double>>")
    return seen.join(found, "ext_id", "left").withColumns({"candidates": F.coalesce("candidates", none), "suggestion": create_suggestion("raw_text", "source_ref")})


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
