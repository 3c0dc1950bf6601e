"""Multi-party dialogues from every speaker's side, with DataFrame functions only.

For each participant the dialogue is rendered once: their turns as the assistant's, the others'
as those of named users, system turns as they are. Spans mark the characters to train on: the
assistant's words and the end mark after them. Participants are told apart by their roles as given;
only the printed names are made safe, numbered where two of a dialogue would print alike.

A dialogue comes in parts of PART turns, so that one of any length is never one group. Turns get
their place from a range-partitioned sort over all rows.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import number_rows
from .common import columns

PART = 64
SYSTEM = "system"
UNNAMED = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def _safe(role):
    """A role as a plain name: letters, digits, `_`, `.` and `-`; others become `_`."""
    name = F.regexp_replace(F.trim(role), r"[^A-Za-z0-9_.-]", "_")
    return F.when(role.isNull() | (name == ""), UNNAMED).otherwise(name)


def _is_system():
    return F.coalesce(F.trim("role") == SYSTEM, F.lit(False))


def _text(text):
    """Marks inside a text can't be read as marks: `<|` becomes `< |`."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns, id="conv_id", turn="turn", role="role", text="text", part=PART):
    """conv_id, perspective, part, n_turns, n_trained, text, spans per dialogue part and participant.

    Turns are in order of turn (null first), then role, then a digest of the text; equal rows
    all stay. spans is `start:length,...` in characters of that part's text. Everyone but the
    system takes part. Roles that differ are different speakers, a null one too, which prints as
    `unknown`, as an empty one does; of several that print alike the second ends in `#2`, in order of
    the roles (null first). A null text is empty. Rows of a
    null conv_id are one dialogue. A dialogue of system turns only has no perspective, and so no
    row; an empty table has none. Extra columns are ignored.
    """
    rows = columns(turns, conv_id=id, turn=turn, role=role, text=text)
    said = rows.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), _text(F.col("text")).alias("said"))
    placed = number_rows(said, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest")])
    first = placed.groupBy(F.col("conv_id").alias("conv")).agg(F.min("position").alias("first"))
    speakers = said.where(~_is_system()).select(F.col("conv_id").alias("conv"), F.col("role").alias("speaker")).distinct()
    alike = Window.partitionBy("conv", "name").orderBy(F.col("speaker").asc_nulls_first())
    nth = F.row_number().over(alike)
    named = speakers.withColumn("name", _safe(F.col("speaker"))).withColumn("nth", nth)
    named = named.select("conv", "speaker", F.when(F.col("nth") > 1, F.concat("name", F.lit("#"), F.col("nth").cast("string"))).otherwise(F.col("name")).alias("perspective"))
    # One narrow row per dialogue on the other side; a dialogue with many turns may be split.
    inside = placed.join(first, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv").withColumn("at", F.col("position") - F.col("first"))
    inside = inside.join(named, F.col("conv_id").eqNullSafe(F.col("conv")) & F.col("role").eqNullSafe(F.col("speaker")), "left")
    inside = inside.withColumn("name", F.when(_is_system(), SYSTEM).otherwise(F.col("perspective")))
    parts = inside.groupBy("conv_id", F.floor(F.col("at") / part).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("at", "name", "said"))).alias("messages")
    )
    sides = parts.join(named, F.col("conv_id").eqNullSafe(F.col("conv")))

    def own(m):
        return m["name"] == F.col("perspective")  # printed names are one speaker's each

    def head(m):
        name = F.when(m["name"] == SYSTEM, SYSTEM).when(own(m), "assistant").otherwise(F.concat(F.lit("user name="), m["name"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    def body(m):
        return F.concat(m["said"], F.lit(END))

    pieces = F.transform("messages", lambda m: F.struct(head(m).alias("head"), body(m).alias("body"), own(m).alias("own")))
    rendered = sides.withColumn("pieces", pieces)
    text_ = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    # Lengths before each piece: at most `part` numbers to add up.
    sizes = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + 1)
    rendered = rendered.withColumn("sizes", sizes)

    def span(p, k):
        before = F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, x: a + x)
        return F.when(p["own"], F.concat((before + F.length(p["head"])).cast("string"), F.lit(":"), F.length(p["body"]).cast("string")))

    return rendered.select(
        "conv_id",
        "perspective",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_trained"),
        text_.alias("text"),
        F.array_join(F.transform("pieces", span), ",").alias("spans"),
    )


SQL = rf"""
with said as (
  select conv_id, turn, role, coalesce(trim(role) = '{SYSTEM}', false) is_system,
         case when role is null or trim(role) = '' then '{UNNAMED}' else regexp_replace(trim(role), '[^A-Za-z0-9_.-]', '_', 'g') end safe,
         md5(coalesce(text, '')) digest, replace(coalesce(text, ''), '<|', '< |') said
  from conversations),
named as (
  select conv_id, role, safe || case when n > 1 then '#' || n else '' end "name" from (
    select *, row_number() over (partition by conv_id, safe order by role nulls first) n
    from (select distinct conv_id, role, safe from said where not is_system))),
placed as (
  select s.*, case when is_system then '{SYSTEM}' else n."name" end speaker,
         row_number() over (partition by s.conv_id order by turn nulls first, s.role nulls first, digest) - 1 "at"
  from said s left join named n on n.conv_id is not distinct from s.conv_id and n.role is not distinct from s.role),
sides as (
  select p.conv_id, p."at", p."at" // {PART} part, s."name" perspective, p.speaker = s."name" own,
         '{START}' || case when p.speaker = '{SYSTEM}' then '{SYSTEM}' when p.speaker = s."name" then 'assistant'
         else 'user name=' || p.speaker end || chr(10) head, p.said || '{END}' body
  from placed p join named s on p.conv_id is not distinct from s.conv_id),
spots as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, perspective, part order by "at"
         rows between unbounded preceding and 1 preceding), 0) before from sides)
select conv_id, perspective, part, count(*) n_turns, count(*) filter (where own) n_trained,
       string_agg(head || body || chr(10), '' order by "at") "text",
       coalesce(string_agg((before + length(head))::bigint || ':' || length(body), ',' order by "at") filter (where own), '') spans
from spots group by all"""
