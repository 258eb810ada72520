"""Quotation linking of messages, with DataFrame functions alone.

Lines that begin with ``>`` are quotes, nested as deep as they have such marks. Neighbouring lines of one level are a
passage. Passages, and their longer lines, are normalised and hashed, and meet the messages of the same conversation
that wrote them: for each hash the earliest message that holds the text unquoted. A message replies to the message
its outermost quote comes from. Messages whose quotes come from nowhere start a thread of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, write_table

#: A line at the start of a quoted line: its marks; and a line that announces a quote.
MARKS, LEAD = r"^([ \t]*>)+", r"^([ \t]*>)+[ \t]?"
ANNOUNCES = r"(?i)^.*(wrote|schrieb|escribió|a écrit)[ \t]*:[ \t]*$"
#: A line of a longer quote is looked up by itself if it has so many characters; lines of originals are all indexed.
LINE_LEAST = 20


def normalised(text: Column) -> Column:
    """Lower case, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f\x0B]+", " "))


def _keys(text: Column) -> Column:
    return F.md5(normalised(text))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines, levels, bodies and passages (level, body) of each message."""
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("lines", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    rows = rows.withColumn("levels", F.transform("lines", level)).withColumn("bodies", F.transform("lines", lambda x: F.regexp_replace(x, LEAD, "")))
    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    rows = rows.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), n)
    passages = F.transform("starts", lambda s, k: F.struct(F.get("levels", s).alias("level"), F.array_join(F.slice("bodies", s + 1, end(k) - s), "\n").alias("body")))
    return rows.withColumn("passages", passages)


def clean_text() -> Column:
    """The unquoted lines without those that announce a quote, trimmed."""
    kept = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: (F.get("levels", i) == 0) & ~(F.get("lines", i).rlike(ANNOUNCES) & (F.coalesce(F.get("levels", i + 1), F.lit(0)) > 0)),
    )
    return F.regexp_replace(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def _looked_up(passage: Column, least: int) -> Column:
    """(key, whole) of a passage as it stands and of its lines of ``least`` characters or more."""
    lines = F.filter(F.split(passage, "\n", -1), lambda x: F.length(normalised(x)) >= least)
    whole = F.array(F.struct(_keys(passage).alias("key"), F.lit(1).alias("whole")))
    return F.concat(whole, F.transform(lines, lambda x: F.struct(_keys(x).alias("key"), F.lit(0).alias("whole"))))


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked): which earlier message each quoting message replies to."""
    quoted = rows.where(F.exists("levels", lambda x: x > 0))
    quotes = quoted.select("conv_id", "turn", F.explode(F.filter("passages", lambda p: (p["level"] > 0) & (normalised(p["body"]) != ""))).alias("p"))
    quotes = quotes.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(_looked_up(F.col("p.body"), LINE_LEAST)).alias("q"))
    quotes = quotes.select("conv_id", "turn", "level", "q.key", "q.whole").distinct()
    asked = quotes.select("conv_id").distinct()
    # only conversations that quote need an index of what they say
    own = rows.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.array_append(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), F.col("clean")).alias("said"))
    own = own.select("conv_id", "turn", F.explode("said").alias("said")).where(normalised(F.col("said")) != "")
    own = own.select("conv_id", "turn", F.explode(_looked_up(F.col("said"), 1)).alias("q"))
    first = own.groupBy("conv_id", F.col("q.key").alias("key")).agg(F.min("turn").alias("origin"))
    found = quotes.join(first, ["conv_id", "key"]).where("origin < turn")
    # the outermost level first, whole passages before lines, then the nearest origin
    best = F.min_by("origin", F.struct("level", -F.col("whole"), -F.col("origin")))
    return found.groupBy("conv_id", "turn").agg(best.alias("parent_turn"), F.count_distinct("level").alias("n_linked"))


def threads(found: DataFrame) -> DataFrame:
    """``found`` with root_turn and depth, by pointer jumping: the number of rounds is the logarithm of the depth."""
    shared_dir(found.sparkSession)
    at = found.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")).checkpoint()
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        moved = at.join(up, ["conv_id", "root_turn"], "left")
        if moved.where("next is not null").isEmpty():
            return found.join(at, ["conv_id", "turn"])
        at = moved.select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()


def reply_threads(messages: DataFrame) -> DataFrame:
    """Each message without its quotes, in reply order: by conv_id, root_turn, turn.

    Columns: conv_id, turn, role, clean_text, n_quotes (quoted passages), max_level, n_linked (levels whose origin was
    found), parent_turn (null for a thread's first message), root_turn, depth. A parent's turn is smaller than its
    replies', so each message stands below the one it replies to. Null and empty texts have an empty clean_text and
    quote nothing. A null conv_id or turn links with nothing. Rows that share conv_id and turn are one message for
    linking and stay rows of their own. Of equal passages the earliest message is the origin. Very long messages are
    parsed whole; an empty table gives no rows. Other columns are ignored.
    """
    rows = parsed(messages).withColumn("clean", clean_text())
    rows = write_table(rows.select("conv_id", "turn", "role", "clean", "levels", "passages"), "messages")
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    found = write_table(links(rows), "quote-links")
    named = threads(found)
    out = rows.join(named, ["conv_id", "turn"], "left")
    return (
        out.select(
            "conv_id",
            "turn",
            "role",
            F.col("clean").alias("clean_text"),
            F.size(quoted).cast("long").alias("n_quotes"),
            F.coalesce(F.array_max("levels"), F.lit(0)).cast("long").alias("max_level"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "parent_turn",
            F.coalesce("root_turn", "turn").alias("root_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
        .repartitionByRange("conv_id", "root_turn", "turn")
        .sortWithinPartitions("conv_id", "root_turn", "turn")
    )


ORACLE_SQL = r"""
WITH RECURSIVE parsed AS (
  SELECT row_number() OVER () AS id, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role,
         string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines
  FROM conversations
), line AS (
  SELECT id, conv_id, turn, u.i AS i, u.x AS x,
         length(regexp_replace(regexp_extract(u.x, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(u.x, '^([ \t]*>)+[ \t]?', '') AS body
  FROM (SELECT id, conv_id, turn, unnest(list_zip(generate_series(1, len(lines)), lines)) AS z FROM parsed) s,
       LATERAL (SELECT z[1] AS i, z[2] AS x) u
), near AS (
  SELECT *, coalesce(lag(level) OVER (PARTITION BY id ORDER BY i), -1) AS before,
         coalesce(lead(level) OVER (PARTITION BY id ORDER BY i), 0) AS after FROM line
), run AS (
  SELECT *, sum((level <> before)::INT) OVER (PARTITION BY id ORDER BY i) AS r FROM near
), passage AS (
  SELECT id, conv_id, turn, r, level, string_agg(body, chr(10) ORDER BY i) AS body FROM run GROUP BY ALL
), clean AS (
  SELECT id, conv_id, turn,
         regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT
           (after > 0 AND regexp_matches(x, '(?i)^.*(wrote|schrieb|escribió|a écrit)[ \t]*:[ \t]*$'))), ''),
           '^[ \t\n]+|[ \t\n]+$', '', 'g') AS clean_text,
         max(level) AS max_level
  FROM near GROUP BY ALL
), norm AS (
  SELECT id, conv_id, turn, level, 1 AS whole, body FROM passage
  UNION ALL SELECT id, conv_id, turn, 0, 1, clean_text FROM clean
), key AS (
  SELECT id, conv_id, turn, level, whole, trim(regexp_replace(lower(body), '[ \t\r\n\f\v]+', ' ', 'g')) AS k FROM norm
  UNION ALL
  SELECT id, conv_id, turn, level, 0, k FROM (
    SELECT id, conv_id, turn, level, trim(regexp_replace(lower(unnest(string_split(body, chr(10)))), '[ \t\r\n\f\v]+', ' ', 'g')) AS k
    FROM norm) WHERE length(k) >= 20 OR level = 0 AND k <> ''
), first AS (
  SELECT conv_id, k, min(turn) AS origin FROM key WHERE level = 0 AND k <> '' GROUP BY ALL
), found AS (
  SELECT q.conv_id, q.turn, arg_min(f.origin, (q.level, -q.whole, -f.origin)) AS parent_turn, count(DISTINCT q.level) AS n_linked
  FROM key q JOIN first f ON q.conv_id = f.conv_id AND q.k = f.k
  WHERE q.level > 0 AND q.k <> '' AND f.origin < q.turn GROUP BY q.conv_id, q.turn
), climb AS (
  SELECT conv_id, turn, parent_turn AS root_turn, 1::BIGINT AS depth FROM found
  UNION ALL
  SELECT c.conv_id, c.turn, f.parent_turn, c.depth + 1 FROM climb c JOIN found f ON f.conv_id = c.conv_id AND f.turn = c.root_turn
), top AS (
  SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM climb GROUP BY ALL
)
SELECT p.conv_id, p.turn, p.role, c.clean_text,
       (SELECT count(*) FROM passage g WHERE g.id = p.id AND g.level > 0)::BIGINT AS n_quotes,
       c.max_level::BIGINT AS max_level, coalesce(f.n_linked, 0)::BIGINT AS n_linked, f.parent_turn,
       coalesce(t.root_turn, p.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth
FROM parsed p JOIN clean c ON c.id = p.id
LEFT JOIN found f ON f.conv_id = p.conv_id AND f.turn = p.turn
LEFT JOIN top t ON t.conv_id = p.conv_id AND t.turn = p.turn
"""
