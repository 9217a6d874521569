"""Memory records and staged writes: validation, recall, optimistic writes with an audit, property patches, and chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.predicates import confidence_rank, not_superseded, valid_at, younger_than
from lodestack.runtime import shared_dir

#: The keys that every record must have, in the order they are asked for, and the words allowed.
REQUIRED = ("source", "observed_at")
ALLOWED = {"confidence": ("direct", "inferred", "uncertain"), "status": ("active", "superseded")}


def in_sinks(path: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return F.coalesce(out, F.lit(False))


def validate(rows: DataFrame, sinks: Sequence[str]) -> DataFrame:
    """Rows with `reason` and `key` of the first rule that each breaks, null where it breaks none.

    Rows have path, agent (boolean: written by an agent), source, confidence, status, observed_at and superseded_by.
    """
    inside, agent = in_sinks(F.col("path"), sinks), F.coalesce(F.col("agent"), F.lit(False))
    rules: list[tuple[Column, str, str]] = [(agent & ~inside, "agent_write_outside_sink", "-"), (~agent & inside, "sink_is_for_agents", "-")]
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rules += [(inside & blank(c), "missing_provenance", c) for c in REQUIRED]
    rules += [(inside & F.col(c).isNotNull() & ~F.col(c).isin(*words), "invalid_provenance", c) for c, words in ALLOWED.items()]
    ended = F.coalesce(F.col("status") == "superseded", F.lit(False))
    rules.append((inside & (ended == blank("superseded_by")), "supersede_mismatch", "superseded_by"))
    first = F.coalesce(*[F.when(test, F.struct(F.lit(reason).alias("reason"), F.lit(key).alias("key"))) for test, reason, key in rules])
    return rows.withColumn("broken", first).select(*rows.columns, "broken.reason", "broken.key")


def recall(hits: DataFrame, now: Column, *, sinks: Sequence[str], confidence: str | None = None, types: Sequence[str] | None = None, days: float | None = None, limit: int = 20) -> DataFrame:
    """Best hit of each path, below the sinks, neither superseded nor out of its validity, newest observation first."""
    keep = in_sinks(F.col("path"), sinks) & not_superseded() & valid_at("valid_from", "valid_to", now)
    if confidence:
        keep = keep & (confidence_rank("confidence") >= {"direct": 3, "inferred": 2, "uncertain": 1}.get(confidence, 0))
    if types is not None:
        keep = keep & F.coalesce(F.col("type").isin(*types), F.lit(False))
    if days is not None:
        keep = keep & younger_than("observed_at", days, now)
    rest = [c for c in hits.columns if c != "path"]
    best = hits.filter(keep).groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("score", *[c for c in rest if c not in ("score", "props")])).alias("h"))
    return best.select("path", "h.*").orderBy(F.desc_nulls_last("observed_at"), F.desc("mtime"), "path").limit(limit)


def stage_writes(current: DataFrame, writes: DataFrame) -> DataFrame:
    """path, action and hashes for each write (path, hash, expected, delete): created, updated, unchanged, deleted, or refused
    with a reason. An `expected` hash must equal the current one; a deletion needs it; a null one allows creation and update."""
    now = current.select("path", F.col("hash").alias("now"))
    out = writes.join(now, "path", "left")
    gone, delete = F.col("now").isNull(), F.coalesce(F.col("delete"), F.lit(False))
    action = (
        F.when(delete & gone, "refused: not_found")
        .when(delete & F.col("expected").isNull(), "refused: expected_hash_required")
        .when(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("now")), "refused: hash_mismatch")
        .when(delete, "deleted").when(gone, "created").when(F.col("now") == F.col("hash"), "unchanged").otherwise("updated")
    )
    return out.select("path", action.alias("action"), F.col("now").alias("before"), F.when(~delete, F.col("hash")).alias("after"))


def apply_writes(current: DataFrame, writes: DataFrame) -> DataFrame:
    """current (path, hash, and id where it has one) after the accepted writes: one full outer join by path. Writes have one row a path.

    A note keeps its id; a new one has a hash of its path as id.
    """
    done = stage_writes(current, writes).filter(F.col("action").isin("created", "updated", "deleted"))
    ids = ["id"] if "id" in current.columns else []
    both = current.select("path", "hash", *ids).join(done, "path", "full_outer")
    changed = F.col("action").isNotNull()
    out = both.filter(~F.coalesce(F.col("action") == "deleted", F.lit(False)))
    return out.select("path", F.when(changed, F.col("after")).otherwise(F.col("hash")).alias("hash"), *[F.coalesce("id", F.xxhash64("path")).alias("id") for _ in ids])


def audit_rows(staged: DataFrame, at: Column, by: str) -> DataFrame:
    """path, op, before, after, at, by: the audit of the writes and deletions that were accepted, to be written before they are."""
    op = F.when(F.col("action") == "deleted", "delete").when(F.col("action") == "created", "create").otherwise("update")
    rows = staged.filter(F.col("action").isin("created", "updated", "deleted"))
    return rows.select("path", op.alias("op"), "before", "after", at.alias("at"), F.lit(by).alias("by"))


def write_notes(current: DataFrame, writes: DataFrame, bodies: DataFrame, folder: str, at: Column, by: str) -> DataFrame:
    """Write accepted notes (path, text of `bodies`), the audit first, below the folder, and return the verdicts.

    Each call has a folder of its own, and the last file written is what makes it count; so a call that fails leaves nothing that is read.
    """
    staged = stage_writes(current, writes)
    audit_rows(staged, at, by).write.mode("errorifexists").parquet(f"{folder}/audit")
    accepted = staged.filter(F.col("action").isin("created", "updated")).select("path")
    bodies.join(accepted, "path", "left_semi").write.mode("errorifexists").parquet(f"{folder}/notes")
    return staged.select("path", "action")


def patch_map(props: Column | str, *, put: dict[str, str] | None = None, unset: Sequence[str] = ()) -> Column:
    """A map column with entries replaced or taken out; a null map counts as empty."""
    base = F.coalesce(F.col(props) if isinstance(props, str) else props, F.create_map().cast("map<string,string>"))
    drop = [*unset, *(put or {})]
    left = F.map_filter(base, lambda k, v: ~k.isin(*drop)) if drop else base
    return F.map_concat(left, F.create_map(*[F.lit(x) for kv in put.items() for x in kv])) if put else left


def replace_once(text: Column, old: str, new: str) -> Column:
    """struct<text, error>: the only occurrence of `old` replaced, else target_not_found or ambiguous_target."""
    n = F.size(F.split(text, F.lit("\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"), -1)) - 1
    error = F.when(n == 0, "target_not_found").when(n > 1, "ambiguous_target")
    return F.struct(F.when(n == 1, F.replace(text, F.lit(old), F.lit(new))).otherwise(text).alias("text"), error.alias("error"))


def prior_folder(notes: DataFrame, least: int = 3, levels: int = 4) -> DataFrame:
    """path, folder: the nearest ancestor folder, at most `levels` up, that holds `least` notes or more, those below included."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    near = F.when(depth > 0, F.sequence(depth, F.greatest(F.lit(1), depth - (levels - 1)))).otherwise(F.array().cast("array<int>"))
    every = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).otherwise(F.array().cast("array<string>"))
    sizes = notes.select(F.explode(every).alias("folder")).groupBy("folder").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    asked = notes.select("path", F.explode(F.transform(near, lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("folder"))
    return asked.join(sizes, "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def follow(pointers: DataFrame, most: int = 100) -> DataFrame:
    """start, final, hops: where each id's chain (id, next) ends, after `most` hops at the latest. A next that is no id ends it.

    Pointer doubling: round r holds the node 2**r hops on, so 100 hops take seven joins, and no table grows with the chains' length.
    """
    ids = pointers.select("id")
    step = pointers.join(ids.select(F.col("id").alias("next")), "next", "left_semi").select(F.col("id").alias("at"), F.col("next").alias("to"), F.lit(1).alias("n"))
    now = ids.select(F.col("id").alias("start"), F.col("id").alias("final"), F.lit(0).alias("hops"))
    left = most
    while left:
        if left & 1:  # these hops, from where each start is
            now = now.join(step, now["final"] == step["at"], "left").select("start", F.coalesce("to", "final").alias("final"), (F.col("hops") + F.coalesce("n", F.lit(0))).alias("hops"))
        left >>= 1
        if left:
            more = step.select(F.col("at").alias("mid"), F.col("to").alias("end"), F.col("n").alias("m"))
            # Where the second half isn't there, the first is as far as the chain goes.
            step = step.join(more, step["to"] == more["mid"], "left").select("at", F.coalesce("end", "to").alias("to"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
            shared_dir(pointers.sparkSession)
            step, now = step.checkpoint(), now.checkpoint()
    return now
