"""What properties look like: profiles of fields and values, inference from folders, neighbours and content, inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators import assembly

#: How sure a rule about content is, how much of a text it looks at, and the longest text that is a mere fact.
STRONG, USUAL, WEAK = 0.85, 0.7, 0.5
HEAD, LINK_HEAD, FACT = 2000, 500, 150
#: Words of meetings, and the lines that name their guests, as patterns.
MEETING = r"(?i)\b(Meeting|Treffen|Call|Sondierung|Termin|Standup|Sync|Kickoff|Kick-off|Jour\s*fixe|Workshop)\b"
GUESTS = r"(?im)^(Attendees|Teilnehmer|Participants):"
MAIL_TITLE, MAIL_REPLY = r"(?i)^(E-?Mail|Email|Mail)\s+(von|from)\s+\S+", r"(?i)^(Re|Fwd|AW|WG):\s"
MAIL_FROM, MAIL_TO = r"(?im)^(From|Von):\s+\S+", r"(?im)^(To|An):\s+\S+"
NAME = r"^[A-ZÄÖÜ][a-zäöüß'\-]+( [A-ZÄÖÜ][a-zäöüß'\-]+){0,3}$"
PROFILE, ADDRESS, PHONE = r"(?i)linkedin\.com/in/", r"(?i)\b[\w._-]+@[\w.-]+\.[a-z]{2,}\b", r"\+?\d[\d\s\-./()]{6,}"
CLIP_LINK, CLIP_SOURCE = r"(?m)^\s*\[.+\]\(https?://[^\s)]+\)", r"(?im)^source:\s*https?://"


def json_type(value: Column) -> Column:
    """null, boolean, number, string, array or object, of a variant."""
    kind = F.schema_of_variant(value)
    out = F.when(F.is_variant_null(value) | value.isNull(), "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
    return out.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")


def entries(notes: DataFrame, key: str, props: str) -> DataFrame:
    """key, field, value (variant): a row for each property; texts that are no JSON object have none."""
    parsed = notes.select(key, F.try_parse_json(props).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    return parsed.select(key, F.explode(F.json_object_keys(F.to_json("v"))).alias("field"), "v").select(key, "field", F.expr("try_variant_get(v, concat('$[\"', field, '\"]'), 'variant')").alias("value"))


def fields(notes: DataFrame, key: str, props: str, group: str | None = None) -> DataFrame:
    """field, types (sorted), present, total: over all notes, or those of each group."""
    by = [group] if group else []
    total = notes.groupBy(*by).agg(F.count("*").alias("total"))
    each = entries(notes, key, props)
    if group:
        each = each.join(notes.select(key, group), key)
    per = each.groupBy(*by, "field").agg(F.array_sort(F.collect_set(json_type(F.col("value")))).alias("types"), F.count_distinct(key).alias("present"))
    return per.join(total, group) if group else per.join(F.broadcast(total))  # one row


def values(rows: DataFrame, key: str, value: str, total: int | Column) -> DataFrame:
    """value, present, total: in how many notes each value stands, however often."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.count_distinct(key).alias("present")).withColumn("total", total if isinstance(total, Column) else F.lit(total).cast("long"))


def neighbours(edges: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """note, other: the notes that link to a note, those that it links to, and those that a draft of it names; each once, never itself."""
    back = edges.select(F.col("dst").alias("note"), F.col("src").alias("other"))
    ahead = edges.select(F.col("src").alias("note"), F.col("dst").alias("other"))
    rows = back.unionByName(ahead)
    if drafts is not None:
        rows = rows.unionByName(drafts.select("note", "other"))
    return rows.filter("note is not null and other is not null and note <> other").distinct()


def from_neighbours(asked: DataFrame, edges: DataFrame, properties: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """note, key, present, prevalence, dominant: of the properties (note, key, value) that the neighbours of each asked note have."""
    near = neighbours(edges, drafts).join(asked.select("note").distinct(), "note", "left_semi")
    members = near.groupBy("note").agg(F.count("*").alias("members"))
    held = near.join(properties.select(F.col("note").alias("other"), "key", "value"), "other")
    return assembly.prevalence(held, "note", "key", "value", members)


def from_content(notes: DataFrame, key: str, title: str, body: str) -> DataFrame:
    """note, key, value (JSON), confidence, rule: what six rules tell of the title and the start of the text; no UDF."""
    t, head, whole = F.coalesce(F.col(title), F.lit("")), F.substr(F.coalesce(F.col(body), F.lit("")), F.lit(1), F.lit(HEAD)), F.trim(F.coalesce(F.col(body), F.lit("")))
    mail = t.rlike(MAIL_TITLE) | t.rlike(MAIL_REPLY) | (head.rlike(MAIL_FROM) & head.rlike(MAIL_TO))
    sure = F.when(head.rlike(GUESTS), STRONG).otherwise(USUAL)
    person = F.trim(t).rlike(NAME) & (head.rlike(PROFILE) | head.rlike(ADDRESS) | head.rlike(PHONE))
    start = F.substr(head, F.lit(1), F.lit(LINK_HEAD))
    clipped = start.rlike(CLIP_LINK) | start.rlike(CLIP_SOURCE)
    fact = (F.length(whole) > 0) & (F.length(whole) <= FACT) & ~whole.rlike(r"\n\s*\n")
    date = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    rules: list[tuple[str, Column, Sequence[tuple[str, Column | str, Column | float]]]] = [
        ("email", mail, [("class", '"Email"', STRONG), ("type", '"email"', STRONG)]),
        ("meeting", t.rlike(MEETING), [("class", '"Meeting"', sure), ("type", '"meeting"', sure)]),
        ("person", person, [("class", '"Person"', STRONG), ("type", '"person"', STRONG), ("participation", "[]", WEAK)]),
        ("clipping", clipped, [("class", '"Clipping"', USUAL), ("tags", '["clippings"]', USUAL)]),
        ("fact", fact, [("class", '"Fact"', WEAK)]),
        ("date", date != "", [("created", F.concat(F.lit('"'), date, F.lit('"')), STRONG)]),
    ]
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    told = [F.when(test, F.struct(F.lit(k).alias("key"), lit(v).alias("value"), lit(c).cast("double").alias("confidence"), F.lit(rule).alias("rule"))) for rule, test, out in rules for k, v, c in out]
    return notes.select(F.col(key).alias("note"), F.inline(F.filter(F.array(*told), lambda x: x.isNotNull())))


def ranked(suggestions: DataFrame) -> DataFrame:
    """suggestions (note, key, confidence, ...) with `place`: the surest first, then by key as a reader would order them."""
    order = Window.partitionBy("note").orderBy(F.desc("confidence"), F.collate("key", "UNICODE_CI"), "key", "value")
    return suggestions.withColumn("place", F.row_number().over(order))


def inspect(notes: DataFrame, key: str, props: str, expected: Sequence[tuple[str, Sequence[str], bool]], *, strict: bool = False) -> DataFrame:
    """key, field, code, level of what breaks the expected fields (name, types, required): missing_required and invalid_type are
    errors, unexpected_field is a warning, or an error where strict."""
    spark = notes.sparkSession
    want = spark.createDataFrame([(n, list(t), r) for n, t, r in expected], "field string, types array<string>, required boolean")  # a contract's few fields
    have = entries(notes, key, props).select(key, "field", json_type(F.col("value")).alias("kind"))
    asked = notes.select(key).join(F.broadcast(want.filter("required").select("field")))
    missing = asked.join(have, [key, "field"], "left_anti").select(key, "field", F.lit("missing_required").alias("code"))
    both = have.join(F.broadcast(want), "field", "left")
    wrong = both.filter(F.col("types").isNotNull() & (F.size("types") > 0) & ~F.array_contains("types", F.col("kind"))).select(key, "field", F.lit("invalid_type").alias("code"))
    extra = both.filter("types is null").select(key, "field", F.lit("unexpected_field").alias("code"))
    level = F.when((F.col("code") == "unexpected_field") & F.lit(not strict), "warning").otherwise("error")
    return missing.unionByName(wrong).unionByName(extra).withColumn("level", level)
