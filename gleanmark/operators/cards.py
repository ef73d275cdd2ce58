"""Cards, courses and queues: classes of folders, statuses in notes, histories, and what waits for extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a course's department stands in a folder's name, in the order in which they are tried.
COURSE = (r"(?i)How We Teach[^:]*[:：]\s*(?:MIT\s+)?(\d{1,2}[A-Z]?)\.", r"(?i)RES\.(\d{1,2})", r"(?i)(?:MIT\s+)?(\d{1,2}[A-Z]?)\.")
#: What a pilot plan must tell.
PLAN_KEYS = ("title", "objective", "concepts", "hypotheses", "deterministic_controls", "ai_tasks", "measurements", "independent_evidence_needed", "stop_conditions")

#: How the question for each type of gap begins, and that for any other.
ASKS = {"unsupported_claim": "academic evidence for: ", "missing_instance": "concrete examples and case studies of: ", "unverified_edge": "evidence justifying the relationship "}
ASKS_ELSE = "knowledge about "


def card_id(ref: Column) -> Column:
    return F.nullif(F.regexp_extract(ref, r"K-\d{4}", 0), F.lit(""))


def status_of(note: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(note, r"(?m)^status:\s*[\"']?(\w+)", 1), F.lit("")), F.lit("unknown"))


def with_status(note: Column, status: Column) -> Column:
    """A note whose first status line tells another status; a note without one stays."""
    cut = r"(?ms)\A(.*?^status:\s*)[\"']?\w+[\"']?(.*)\z"
    return F.when(note.rlike(cut), F.concat(F.regexp_extract(note, cut, 1), F.lit('"'), status, F.lit('"'), F.regexp_extract(note, cut, 2))).otherwise(note)


def has_sources(note: Column) -> Column:
    return note.contains("## Source Refs") | note.contains("## Source References")


def course_matches(course: Column, path: Column) -> Column:
    """Whether a path names a course, whatever the case, its number written with a point, a dash or a low line."""
    lower, number = F.lower(path), F.lower(course)
    return lower.contains(number) | lower.contains(F.replace(number, F.lit("."), F.lit("-"))) | lower.contains(F.replace(number, F.lit("."), F.lit("_")))


def english_alias(note: Column) -> Column:
    """The first alias of two to five English words, from the list in a note's header."""
    listed = F.transform(F.split(F.regexp_extract(note, r"(?m)^aliases:\s*\[(.*)\]", 1), ","), lambda a: F.regexp_extract_all(a, F.lit("[A-Za-z][A-Za-z0-9_-]*"), F.lit(0)))
    return F.array_join(F.get(F.filter(listed, lambda w: F.size(w).between(2, 5)), 0), " ")


def classified(folders: DataFrame, departments: DataFrame) -> DataFrame:
    """``folders`` (folder) with the first department (dept, discipline, broad) that its name tells, in the order of ``COURSE``; a number that no department has
    gives way to the next. What comes by the second is a supplement. Folders without one have nulls."""
    told = F.array(*[F.struct(F.lit(i).alias("place"), F.upper(F.regexp_extract("folder", rule, 1)).alias("dept")) for i, rule in enumerate(COURSE)])
    met = folders.select("folder").distinct().select("folder", F.inline(told)).where("dept <> ''").join(departments, "dept")
    discipline = F.when(F.col("place") == 1, F.concat("discipline", F.lit(" (Supplemental)"))).otherwise(F.col("discipline"))
    best = met.groupBy("folder").agg(F.min_by(F.struct("dept", discipline.alias("discipline"), "broad"), "place").alias("r"))
    return folders.join(best, "folder", "left").select(*folders.columns, "r.dept", "r.discipline", "r.broad")


def nested(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """The last revision of each node with all claims on the node, of whatever revision, by id: id, revision, claims (claim_id, statement)."""
    told = claims.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("claim_id", "statement"))).alias("claims"))
    last = nodes.groupBy("id").agg(F.max("revision").alias("revision"))
    return last.join(told, "id", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<struct<claim_id:string,statement:string>>")))


def history(events: DataFrame, entity: str, at: list[str]) -> DataFrame:
    """What happened to each entity, in order: entity and events (event_type, actor). An entity's events are few beside the log."""
    return events.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(*at, "event_type", "actor"))).alias("e")).select(entity, F.transform("e", lambda x: F.struct(x["event_type"].alias("event_type"), x["actor"].alias("actor"))).alias("events"))


def queued(files: DataFrame, known: DataFrame) -> DataFrame:
    """New items of the extraction queue: of ``files`` (path, content, text) those whose digest no item of ``known`` (id) has, equal contents once, by the least path. id,
    sha256, path, characters and state."""
    told = files.select("path", F.sha2("content", 256).alias("sha256"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.substring("sha256", 1, 16))
    once = told.groupBy("id", "sha256").agg(F.min(F.struct("path", "text")).alias("r"))
    new = once.join(known.select("id"), "id", "left_anti")
    state = F.when(F.col("r.text").rlike(r"(?U)\S"), "needs_topic_extraction").otherwise("needs_ocr")
    return new.select("id", "sha256", "r.path", F.length("r.text").alias("characters"), state.alias("state"))


def valid_critique(answer: Column) -> Column:
    """Whether a critic's answer (a VARIANT) has reviews, and recommends two of them at most for a follow-up."""
    reviews = F.try_variant_get(answer, "$.reviews", "array<variant>")
    again = F.filter(reviews, lambda r: F.coalesce(F.try_variant_get(r, "$.recommend_for_followup", "boolean"), F.lit(False)))
    return F.coalesce((F.size(reviews) > 0) & (F.size(again) <= 2), F.lit(False))


def valid_plan(answer: Column) -> Column:
    """Whether an answer (a VARIANT) has a pilot that tells all that a plan must."""
    pilot = F.try_variant_get(answer, "$.pilot", "map<string,variant>")
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, PLAN_KEYS)), F.map_keys(pilot))) == 0, F.lit(False))


def gap_topic(kind: Column, node: Column, claim: Column, statement: Column) -> Column:
    """What to look for to fill a gap: a claim's wording, a node's name or an edge."""
    subject = {"unsupported_claim": F.coalesce(statement, claim, F.lit("")), "missing_instance": node, "unverified_edge": F.coalesce(claim, F.lit("?"))}
    told = F.lit(None).cast("string")
    for name, begin in ASKS.items():
        told = F.when(kind == name, F.concat(F.lit(begin), subject[name])).otherwise(told)
    return F.when(kind.isin(*ASKS), told).otherwise(F.concat(F.lit(ASKS_ELSE), F.coalesce(node, F.lit("unknown topic"))))
