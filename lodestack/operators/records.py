"""Imports of conversations, records of observations, briefs, sessions, and the audit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as md
from lodestack.functions import hashing
from lodestack.operators.memory import in_sinks

#: The roles of a message, the most messages of a conversation and characters of a text, and the longest identity.
ROLES, MOST_MESSAGES, MOST_TEXT, MOST_IDENTITY = ("user", "assistant", "system", "tool"), 10_000, 2_000_000, 512
#: Keys that only the engine writes, and the sources of a brief.
PROTECTED, MOST_SOURCES = ("source", "status", "superseded_by", "superseded_reason", "observed_at", "confidence", "evidence", "type"), 50
#: Rows of the audit by default and at most.
AUDIT_ROWS, MOST_AUDIT_ROWS = 50, 1000
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?(Z|[+-]\d{2}:\d{2})$"


def strict_time(value: Column) -> Column:
    """The timestamp of a full date and time with a zone, else null."""
    return F.when(value.rlike(ISO), F.try_to_timestamp(value))


def checked_messages(rows: DataFrame) -> DataFrame:
    """Messages (provider, external_id, id, role, text, at) with `error`, the first rule that their conversation breaks, null where none.

    One line and 512 characters at most for identities, known roles, texts of a bounded length, strict times, no message twice.
    """
    bad_name = lambda c: F.col(c).isNull() | (F.length(c) < 1) | (F.length(c) > MOST_IDENTITY) | F.col(c).rlike("[\r\n\u0000]")
    rules = [(bad_name("provider") | bad_name("external_id") | bad_name("id"), "identity"), (~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role")]
    rules += [(F.col("text").isNull() | (F.length("text") > MOST_TEXT), "text"), (F.col("at").isNotNull() & strict_time(F.col("at")).isNull(), "time")]
    own = F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules])
    per = rows.withColumn("own", own).groupBy("provider", "external_id").agg(F.min("own").alias("own"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    error = F.coalesce(F.col("own"), F.when(F.col("n") > F.col("ids"), "duplicate_message"), F.when(F.col("n") > MOST_MESSAGES, "too_many_messages"))
    told = per.select(F.col("provider").alias("p"), F.col("external_id").alias("e"), error.alias("error"))
    return rows.join(told, F.col("provider").eqNullSafe(F.col("p")) & F.col("external_id").eqNullSafe(F.col("e"))).drop("p", "e")


def import_actions(staged: DataFrame, existing: DataFrame, sinks: Sequence[str] = ()) -> DataFrame:
    """path, action for staged imports (path, identity, hash, expected) against notes (path, identity, import_hash, hash, intact).

    reused where the same import is there unchanged, written, replaced, or refused: inside a sink, another identity, another hash than
    expected, or gone.
    """
    now = existing.select("path", F.col("identity").alias("has"), "import_hash", F.col("hash").alias("now"), "intact")
    out = staged.join(now, "path", "left")
    gone = F.col("now").isNull()
    action = (
        F.when(in_sinks(F.col("path"), sinks), "refused: non_agent_write_inside_sink")
        .when(gone & F.col("expected").isNotNull(), "refused: not_found").when(gone, "written")
        .when(~F.col("has").eqNullSafe(F.col("identity")), "refused: import_identity_mismatch")
        .when(F.coalesce("intact", F.lit(False)) & (F.col("import_hash") == F.col("hash")), "reused")
        .when(~F.col("expected").eqNullSafe(F.col("now")), "refused: hash_mismatch").otherwise("replaced")
    )
    return out.select("path", action.alias("action"))


def promote(asked: DataFrame, messages: DataFrame) -> DataFrame:
    """promotion, confidence, evidence, error for each request (promotion, conv, hash, mode, claim, ids: array) over messages (conv, hash, id, text).

    A quote must be the texts of its messages in the order asked for, a blank line between, and is direct; an inference is inferred.
    """
    each = asked.select("promotion", "conv", F.col("hash").alias("asked_hash"), F.posexplode("ids").alias("place", "id"))
    found = each.join(messages.withColumnRenamed("hash", "now"), ["conv", "id"], "left")
    per = found.groupBy("promotion").agg(F.max("now").alias("now"), F.count("text").alias("n"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("said"))
    quote = F.array_join(F.transform("said", lambda m: m["text"]), "\n\n")
    out = asked.join(per, "promotion", "left")
    wrong = (F.trim("claim") == "") | (F.size(F.array_distinct("ids")) < F.size("ids")) | (F.size("ids") < 1)
    error = F.when(F.coalesce(wrong, F.lit(True)), "invalid").when(F.col("now").isNotNull() & (F.col("now") != F.col("hash")), "hash_mismatch").when(F.coalesce("n", F.lit(0)) < F.size("ids"), "message_not_found")
    error = error.when((F.col("mode") == "quote") & (F.col("claim") != quote), "quote_mismatch")
    evidence = F.transform("ids", lambda i: F.concat(F.col("conv").cast("string"), F.lit("#"), F.url_encode(i.cast("string"))))
    confidence = F.when(F.col("mode") == "quote", "direct").otherwise("inferred")
    return out.withColumn("error", error).select("promotion", F.when(F.col("error").isNull(), confidence).alias("confidence"), F.when(F.col("error").isNull(), evidence).alias("evidence"), "error")


def slugs(column: str) -> Column:
    """The slug of each claim, in one Arrow call a batch (no built-in takes accents apart)."""
    return F.pandas_udf(lambda s: s.map(lambda t: md.slug(t or "")).astype("string"), "string")(column)


def record_paths(claims: DataFrame, taken: DataFrame, sink: str, attempts: int = 3) -> DataFrame:
    """claims (claim, observed_at) with `path`: sink, day, slug and six hex digits of the claim, time and attempt; the first attempt that
    isn't taken (column path), null where all are. Rows of one claim and time get one path."""
    named = claims.withColumn("slug", slugs("claim"))
    tries = named.withColumn("attempt", F.explode(F.array(*[F.lit(i) for i in range(attempts)])))
    salt = F.substr(F.sha2(F.concat_ws("\n", "claim", F.col("observed_at").cast("string"), F.col("attempt").cast("string")), 256), F.lit(1), F.lit(6))
    path = F.concat(F.lit(sink), F.date_format("observed_at", "yyyy-MM-dd"), F.lit("-"), "slug", F.lit("-"), salt, F.lit(".md"))
    free = tries.withColumn("path", path).join(taken.select("path").distinct(), "path", "left_anti")
    first = free.groupBy("claim", "observed_at").agg(F.min_by("path", "attempt").alias("path"))
    return claims.join(first, ["claim", "observed_at"], "left")


def supersede(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows (id, status, superseded_by, superseded_reason) after requests (id, by, reason), one an id: their status, successor and reason."""
    told = asked.select("id", "by", "reason")
    out = rows.join(told, "id", "left")
    new = F.col("by").isNotNull()
    changed = {"status": F.lit("superseded"), "superseded_by": F.col("by"), "superseded_reason": F.col("reason")}
    return out.withColumns({c: F.when(new, v).otherwise(F.col(c)) for c, v in changed.items()}).drop("by", "reason")


def missing_citations(briefs: DataFrame, cited: DataFrame, titles: DataFrame) -> DataFrame:
    """brief, id, title of the sources (brief, id) that the body cites neither by title nor by id; `cited` has brief and target."""
    sources = briefs.join(titles, "id", "left").withColumn("title", F.coalesce("title", F.col("id").cast("string")))
    by = lambda c: cited.select("brief", F.trim("target").alias(c)).distinct()
    return sources.join(by("title"), ["brief", "title"], "left_anti").withColumn("name", F.col("id").cast("string")).join(by("name"), ["brief", "name"], "left_anti").select("brief", "id", "title")


def footer(missing: DataFrame) -> DataFrame:
    """brief, footer: a list of links to the missing sources, of which a brief has fifty at most, in order of their ids."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda s: F.concat(F.lit("- [["), s["title"], F.lit("]]")))
    return missing.groupBy("brief").agg(F.concat(F.lit("\n\n## Sources\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("footer"))


def compile_briefs(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """brief, error, hashes for briefs asked for (brief, id): the hash of each source when it was read, as a map by id.

    A brief without sources, with more than fifty, with sources of several vaults, or one that isn't there is refused.
    """
    rows = asked.distinct().join(notes.select("id", "vault", "hash"), "id", "left")
    per = rows.groupBy("brief").agg(F.count("id").alias("n"), F.count("hash").alias("there"), F.count_distinct("vault").alias("vaults"))
    error = F.when(F.col("n") > MOST_SOURCES, "too_many_sources").when(F.col("there") < F.col("n"), "source_not_found").when(F.col("vaults") > 1, "sources_of_several_vaults")
    judged = per.select("brief", error.alias("error"))
    fits = rows.join(judged.filter("error is null"), "brief", "left_semi")
    held = fits.groupBy("brief").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "hash")))).alias("hashes"))
    return judged.join(held, "brief", "left")


def brief_list(briefs: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """brief, status, sources, age_days of briefs (brief, status, compiled_at) with sources (brief, id); days are whole."""
    n = sources.groupBy("brief").agg(F.count_distinct("id").alias("sources"))
    age = F.floor((now.cast("double") - F.col("compiled_at").cast("double")) / 86400).cast("long")
    return briefs.join(n, "brief", "left").select("brief", "status", F.coalesce("sources", F.lit(0)).alias("sources"), age.alias("age_days"))


def checkpoints(kept: DataFrame, asked: DataFrame) -> DataFrame:
    """session, event, verdict of checkpoints (session, event, summary, evidence, observed_at) against those kept (key, payload).

    The same key with the same payload is reused, with another a mismatch; a new one is recorded, and of several of one key in the
    request the first by payload is, the others are mismatches or reuses.
    """
    key = F.sha2(F.to_json(F.array("session", "event")), 256)
    payload = F.sha2(F.to_json(F.struct("summary", "evidence", "observed_at")), 256)
    rows = asked.withColumns({"key": key, "payload": payload})
    invalid = (F.trim("session") == "") | (F.trim("event") == "") | (F.trim("summary") == "") | (F.size("evidence") < 1) | strict_time(F.col("observed_at")).isNull()
    first = rows.filter(~F.coalesce(invalid, F.lit(True))).groupBy("key").agg(F.min("payload").alias("first"))
    out = rows.join(kept.select("key", F.col("payload").alias("was")), "key", "left").join(first, "key", "left")
    verdict = F.when(F.coalesce(invalid, F.lit(True)), "invalid").when(F.coalesce("was", "first") != F.col("payload"), "mismatch").when(F.col("was").isNotNull(), "reused").otherwise("recorded")
    return out.select("session", "event", verdict.alias("verdict"), "key", "payload")


def verified_sources(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """id, state of the sources that a session starts from (id, hash): current, changed or missing."""
    out = asked.join(notes.select("id", F.col("hash").alias("now")), "id", "left")
    return out.select("id", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("hash"), "current").otherwise("changed").alias("state"))


def audit(rows: DataFrame, *, note: str | None = None, op: str | None = None, since: Column | None = None, in_sink: bool | None = None, limit: int | None = None) -> DataFrame:
    """Rows (id, note, op, at, sink) that fit all that is given, the newest first; the limit is 50, and 1000 at most."""
    tests = [t for t, given in ((F.col("note") == note, note), (F.col("op") == op, op), (F.col("at") >= since if since is not None else None, since), (F.coalesce("sink", F.lit(False)) == in_sink, in_sink)) if given is not None]
    kept = rows.filter(reduce(Column.__and__, tests)) if tests else rows
    return kept.orderBy(F.desc("id")).limit(max(1, min(MOST_AUDIT_ROWS, AUDIT_ROWS if limit is None else limit)))


def healed(log: DataFrame, notes: DataFrame) -> DataFrame:
    """The log (id, note, ...) with `path` from the notes (id, path), or the last known path of a note that is gone."""
    return log.join(notes.select(F.col("id").alias("note"), F.col("path").alias("now")), "note", "left").withColumn("path", F.coalesce("now", "path")).drop("now")


def memory_stats(notes: DataFrame, log: DataFrame, sinks: DataFrame) -> DataFrame:
    """sink, records, types, statuses, last_write for each sink (sink, prefix): notes (path, type, status) and the log (path, at) below it.

    Sinks are few: paths meet them by their folder parts, so there is one equality join and no comparison of all with all.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    below = lambda rows: rows.withColumn("prefix", F.explode(folders)).join(sinks, "prefix")
    held = below(notes)
    records = held.groupBy("sink").agg(F.count("*").alias("records"))
    out = sinks.select("sink").join(records, "sink", "left")
    for c, name in (("type", "types"), ("status", "statuses")):
        per = held.filter(F.col(c).isNotNull()).groupBy("sink", c).agg(F.count("*").alias("n")).groupBy("sink").agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("value"), "n"))).alias(name))
        out = out.join(per, "sink", "left")
    last = below(log).groupBy("sink").agg(F.max("at").alias("last_write"))
    return out.join(last, "sink", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def rendered(messages: DataFrame) -> DataFrame:
    """provider, external_id, markdown: a heading for the conversation and one for each message in its order (pos), its time, its text."""
    time = F.when(F.col("at").isNotNull(), F.concat(F.lit("Time: "), "at", F.lit("\n\n"))).otherwise(F.lit(""))
    block = F.concat(F.lit("\n## "), "id", F.lit(" · "), "role", F.lit("\n\n"), time, "text", F.lit("\n"))
    per = messages.groupBy("provider", "external_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("blocks"))
    return per.select("provider", "external_id", F.concat(F.lit("# Conversation "), "external_id", F.lit("\n"), F.array_join(F.transform("blocks", lambda b: b["block"]), "")).alias("markdown"))


def previews(messages: DataFrame, folder: str) -> DataFrame:
    """provider, external_id, source_id, hash, target, markdown: what an import of the conversations would write, and where in the folder."""
    scheme, _, rest = folder.partition("://")
    if not scheme or not rest.endswith("/") or {".", ".."} & set(rest.split("/")):
        raise ValueError("the folder is a handle that ends in / and has no part . or ..")
    identity = hashing.import_identity(F.col("provider"), F.col("external_id"))
    rows = rendered(messages).withColumn("identity", identity)
    return rows.select(
        "provider", "external_id", F.concat(F.lit("conversation:"), "identity").alias("source_id"), F.concat(F.lit("sha256:"), F.sha2("markdown", 256)).alias("hash"),
        F.concat(F.lit(f"{folder}conversation-"), "identity", F.lit(".md")).alias("target"), "markdown",
    )
