"""Queries on expressions, arguments and small operators, each with its SQL; names start with fn_."""

from __future__ import annotations

from datetime import UTC

from pyspark.sql import functions as F

from ..functions import arguments, json, redaction, text
from ..functions.text import error_terms_of, path_terms_of, query_terms_of
from ..operators import display, incremental, retrieval, scoring, search, trim, verbs
from ..sources import base, native
from ..sources.base import Sessions
from . import canonical as c
from .catalogue import _QUERY, NOW, _term_sql, query
from .formats import event_sessions


def _case(column, *values):
    """One of the values by the column's remainder."""
    out = F.lit(None)
    for k, v in enumerate(values):
        out = F.when(column % len(values) == k, v).otherwise(out)
    return out


# ── redaction ──────────────────────────────────────────────────────────
_SECRETS = """SELECT doc_id, CASE doc_id % 9
 WHEN 0 THEN CASE WHEN n >= 20 THEN 'a ******** b' ELSE 'a ghp_' || repeat('x', n) || ' b' END
 WHEN 1 THEN CASE WHEN n >= 16 THEN 'a ******** b' ELSE 'a AKIA' || repeat('Q', n) || ' b' END
 WHEN 2 THEN 'k ********' || chr(10) || 'tail ' || source
 WHEN 3 THEN 'j ******** ' || source
 WHEN 4 THEN 'MY_API_KEY=******** ' || source
 WHEN 5 THEN 'max_tokens=' || n || ' ' || source
 WHEN 6 THEN 'monkey=' || source
 WHEN 7 THEN '{"password": "********"}'
 ELSE 'db_secret: ********; ' || source END AS masked,
 CAST(CASE doc_id % 9 WHEN 0 THEN n >= 20 WHEN 1 THEN n >= 16 WHEN 5 THEN FALSE WHEN 6 THEN FALSE ELSE TRUE END AS INT) AS found
 FROM (SELECT *, CAST(doc_id % 40 AS INT) AS n FROM documents)"""


@query("fn_secrets", "", _SECRETS)
def secrets(spark, sf_dir):
    n = (F.col("doc_id") % 40).cast("int")
    body = _case(
        F.col("doc_id"),
        F.concat(F.lit("a ghp_"), F.repeat(F.lit("x"), n), F.lit(" b")),
        F.concat(F.lit("a AKIA"), F.repeat(F.lit("Q"), n), F.lit(" b")),
        F.concat(F.lit("k -----BEGIN KEY-----\nabc "), "source", F.lit("\n-----END KEY-----\ntail "), "source"),
        F.concat(F.lit("j eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl "), "source"),
        F.concat(F.lit("MY_API_KEY=v"), "doc_id", F.lit(" "), "source"),
        F.concat(F.lit("max_tokens="), n, F.lit(" "), "source"),
        F.concat(F.lit("monkey="), "source"),
        F.concat(F.lit('{"password": "p'), "doc_id", F.lit('"}')),
        F.concat(F.lit("db_secret: s"), "doc_id", F.lit("; "), "source"),
    )
    rows = c.read(spark, sf_dir, "documents").withColumn("body", body)
    return rows.select("doc_id", redaction.mask(F.col("body")).alias("masked"), redaction.count(F.col("body")).cast("int").alias("found"))


@query("fn_masked_json", "", """SELECT doc_id, '{"command":"run ' || source || '","token":"********"}' AS masked FROM documents""")
def masked_json(spark, sf_dir):
    given = F.to_json(F.struct(F.concat(F.lit("run "), "source").alias("command"), F.concat(F.lit("ghp_"), F.repeat(F.lit("y"), 20)).alias("token")))
    return c.read(spark, sf_dir, "documents").select("doc_id", display.mask_json(given).alias("masked"))


# ── time ───────────────────────────────────────────────────────────────
@query("fn_epochs", "", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS seconds, epoch_us(date_trunc('millisecond', ts)) AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS written FROM events")
def epochs(spark, sf_dir):
    rows = c.read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return rows.select("event_id", F.unix_micros(json.epoch(F.unix_seconds(ts))).alias("seconds"), F.unix_micros(json.epoch(F.unix_millis(ts), "ms")).alias("millis"), arguments.rfc3339(ts).alias("written"))


_AGE = """SELECT doc_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 604800 THEN (s // 86400) || 'd'
 WHEN s < 5184000 THEN (s // 604800) || 'w' WHEN s < 31536000 THEN (s // 2592000) || 'mo' ELSE (s // 31536000) || 'y' END AS age FROM (SELECT doc_id, doc_id * doc_id * 7 AS s FROM documents)"""


@query("fn_relative_age", "", _AGE)
def relative_age(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp")
    then = F.timestamp_seconds(F.unix_seconds(now) - F.col("doc_id") * F.col("doc_id") * 7)
    return c.read(spark, sf_dir, "documents").select("doc_id", arguments.relative_age(then, now).alias("age"))


# ── texts and names ────────────────────────────────────────────────────
@query("fn_locators", "conv", "SELECT conv_id, i, 'simple:session-' || conv_id || '#' || (i + 1) AS whole, 'simple:' || left('session-' || conv_id, 8) || '#' || (i + 1) AS short FROM conv")
def locators(spark, sf_dir):
    rows = c.conversation_blocks(spark, sf_dir).select(F.regexp_extract("doc", r"(\d+)$", 1).cast("long").alias("conv_id"), F.col("msg_idx").cast("long").alias("i"))
    whole = text.locator(F.lit("simple"), F.concat(F.lit("session-"), "conv_id"), F.col("i"))
    return rows.select("conv_id", "i", whole.alias("whole"), text.short_locator(whole).alias("short"))


@query("fn_query_terms", "", """SELECT doc_id, 'src/' || source || '.rs,lib/' || lang AS paths, CASE WHEN doc_id % 2 = 0 THEN 'error-' || lang ELSE '' END AS errors FROM documents""")
def query_terms(spark, sf_dir):
    asked = F.concat(F.lit("(src/"), "source", F.lit(".rs), of lib/"), "lang", F.lit(": "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("error-"), "lang")).otherwise("plain"))
    rows = c.read(spark, sf_dir, "documents").withColumn("q", asked)
    return rows.select("doc_id", F.array_join(path_terms_of(F.col("q")), ",").alias("paths"), F.array_join(error_terms_of(query_terms_of(F.col("q"))), ",").alias("errors"))


@query("fn_plain_lines", "", r"""SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS one, regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') AS scrubbed FROM documents""")
def plain_lines(spark, sf_dir):
    return c.read(spark, sf_dir, "documents").select("doc_id", text.one_line(F.col("text")).alias("one"), text.scrub(F.col("text")).alias("scrubbed"))


@query("fn_terminal", "", "SELECT doc_id, lang || ' ' || source AS bare FROM documents")
def terminal(spark, sf_dir):
    shown = F.concat(F.lit("\x1b[1;31m"), "lang", F.lit("\x1b[0m\x1b]0;title\x07 "), "source")
    return c.read(spark, sf_dir, "documents").select("doc_id", text.strip_ansi(shown).alias("bare"))


_NAMES = """SELECT doc_id, '-work-' || source || '-a-b' AS project, '/work/' || source || '/a b+c' AS uri, CASE WHEN doc_id % 3 = 0 THEN 'a_' || source || '_' WHEN doc_id % 3 = 1 THEN 'artifact' ELSE '_' END AS safe,
 doc_id % 3 = 0 AS fit FROM documents"""


@query("fn_names", "", _NAMES)
def names(spark, sf_dir):
    d = F.col("doc_id")
    name = _case(d, F.concat(F.lit("a/"), "source", F.lit("?")), F.lit("  "), F.lit(".."))
    own = _case(d, F.concat(F.lit("id-"), "source"), F.concat(F.lit("a/"), "source"), F.lit(".."))
    return c.read(spark, sf_dir, "documents").select(
        "doc_id",
        text.encode_project_dir(F.concat(F.lit("/work/"), "source", F.lit("/a.b"))).alias("project"),
        text.file_uri_path(F.concat(F.lit("file:///work/"), "source", F.lit("/a%20b+c"))).alias("uri"),
        text.safe_name(name).alias("safe"),
        text.safe_id(own).alias("fit"),
    )


@query("fn_tool_inputs", "", """SELECT doc_id, 'image/png' AS media, 'aGk' || doc_id AS data, '{"input":' || doc_id || '}' AS wrapped, '{"a":"' || lang || '"}' AS dropped FROM documents""")
def tool_inputs(spark, sf_dir):
    url = json.data_url(F.concat(F.lit("data:image/png;base64,aGk"), "doc_id"))
    both = F.to_json(F.struct(F.col("lang").alias("a"), F.col("source").alias("b")))
    return c.read(spark, sf_dir, "documents").select("doc_id", url["media_type"].alias("media"), url["data"].alias("data"), json.wrap_object(F.col("doc_id").cast("string")).alias("wrapped"), json.drop_keys(both, ["b"]).alias("dropped"))


# ── arguments on the driver ────────────────────────────────────────────
_REFS = ["abc", "abc#3", "abc#3-5", "a#b#2-", "abc#-4"]


@query("fn_references", "", "SELECT * FROM (VALUES ('abc', 'abc', -1, -1), ('abc#3', 'abc', 2, 3), ('abc#3-5', 'abc', 2, 5), ('a#b#2-', 'a#b', 1, -1), ('abc#-4', 'abc', 0, 4)) t(ref, id, first, last)")
def references(spark, sf_dir):
    found = [(r, *arguments.parse_ref(r)) for r in _REFS]
    ends = lambda span: (-1, -1) if span is None else (span[0], -1 if span[1] is None else span[1])
    return spark.createDataFrame([(r, i, *ends(span)) for r, i, span in found], "ref string, id string, first int, last int")


@query("fn_dates", "", "SELECT * FROM (VALUES ('2024-03-01', 1709251200, 1709337599), ('2024-03-01T12:00:00Z', 1709294400, 1709294400), ('2024-03-01T12:00:00+02:00', 1709287200, 1709287200)) t(given, first, last)")
def dates(spark, sf_dir):
    given = ["2024-03-01", "2024-03-01T12:00:00Z", "2024-03-01T12:00:00+02:00"]
    seconds = lambda g, end: int(arguments.parse_date(g, end, UTC).timestamp())
    return spark.createDataFrame([(g, seconds(g, False), seconds(g, True)) for g in given], "given string, first int, last int")


@query("fn_metadata_specs", "", "SELECT * FROM (VALUES ('a', '2'), ('b', 'x=y'), ('c', '3')) t(name, value)")
def metadata_specs(spark, sf_dir):
    found = json.metadata_specs(["a=1", "b=x=y", '{"c": 3, "a": 2}'])
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(found.items())], "name string, value string")


# ── sources and sessions ───────────────────────────────────────────────
def _conversations(spark, sf_dir: str) -> Sessions:
    return Sessions(c.conversation_sessions(spark, sf_dir), c.conversation_blocks(spark, sf_dir))


@query("discover_newest_first", "csess", "SELECT h || ':' || id AS doc, ts FROM csess, (VALUES ('amp'), ('pi')) t(h)")
def discover_newest_first(spark, sf_dir):
    s = _conversations(spark, sf_dir)
    stores = {h: base.ADAPTERS[h](**native.native_tables(s, h)) for h in ("pi", "amp", "freebuff")}
    return base.discover(stores, ["pi", "amp"]).select("doc", "ts")


@query("list_harness", "csess", "SELECT id FROM csess")
def list_harness(spark, sf_dir):
    s = c.conversation_sessions(spark, sf_dir)
    every = s.unionByName(s.withColumns({"harness": F.lit("codex"), "doc": F.concat(F.lit("codex:"), "id")}))
    return every.where(F.col("harness").isin("simple")).select("id")


@query("search_one_session", "clines", "SELECT msg_idx, CAST(line_idx AS BIGINT) AS line_idx, line FROM clines WHERE doc = 'simple:conv-1' AND origin <> 'tool_result' AND contains(lower(line), 'tion')")
def search_one_session(spark, sf_dir):
    lines = _conversations(spark, sf_dir).lines().where("doc = 'simple:conv-1'")
    return search.search_one(lines, search.Query("tion", limit=None)).select("msg_idx", F.col("line_idx").cast("long").alias("line_idx"), "line")


@query("removed_docs", "", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def removed_docs(spark, sf_dir):
    rows = c.read(spark, sf_dir, "documents").select("doc_id")
    return incremental.remove(rows, c.read(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("upsert_keeps_the_last", "", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_keeps_the_last(spark, sf_dir):
    rows = c.read(spark, sf_dir, "events").select("user_id", "event_id")
    return incremental.upsert(rows.where("event_id < 0"), rows, ["user_id"], order="event_id")


# ── verdicts and selections ────────────────────────────────────────────
_P = "CAST((doc_id * 37 % 101) / 100.0 AS FLOAT)"


@query("scorer_decisions", "", f"SELECT 'd' || doc_id AS cand, {_P} AS relevance, {_P} >= 0.5::FLOAT AS retrieve FROM documents")
def scorer_decisions(spark, sf_dir):
    def ranker(_, frame):
        return frame.assign(probability=frame["cand"].str[1:].astype("int64") * 37 % 101 / 100.0)

    rows = c.read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("cand"), F.col("text").alias("content"))
    return scoring.rank_with(rows, "query", ranker)


@query("ordered_verdicts", "", "SELECT cand, CAST(row_number() OVER (ORDER BY relevance DESC, cand) - 1 AS BIGINT) AS pos FROM (SELECT 'simple:doc-' || doc_id AS cand, CAST(0.5 + quality * 0.25 + toxic * 0.125 - (doc_id % 8) * 0.015625 AS FLOAT) AS relevance FROM labels)")
def ordered_verdicts(spark, sf_dir):
    labels = c.read(spark, sf_dir, "labels")
    relevance = (F.lit(0.5) + F.col("quality") * 0.25 + F.col("toxic") * 0.125 - (F.col("doc_id") % 8) * 0.015625).cast("float")
    decisions = labels.select(F.concat(F.lit("simple:doc-"), "doc_id").alias("cand"), relevance.alias("relevance"), (F.col("quality") == 1).alias("retrieve"))
    rows = scoring.verdicts(decisions.select("cand"), decisions, decisions.where("false").select("cand"), retrieval.Options())
    return scoring.numbered(rows).select("cand", "pos")


@query("savings", "", "SELECT doc_id, CASE WHEN n_chars > 0 THEN CAST(floor((n_chars - n_chars // 3) * 100 / n_chars) AS BIGINT) END AS saved FROM documents")
def savings(spark, sf_dir):
    rows = c.read(spark, sf_dir, "documents")
    return rows.select("doc_id", display.savings_percent(F.col("n_chars"), F.floor(F.col("n_chars") / 3)).cast("long").alias("saved"))


@query("project_counts", "csess", "SELECT replace(cwd, '/work/', '') AS project, count(*) AS n FROM csess GROUP BY cwd")
def project_counts(spark, sf_dir):
    s = c.conversation_sessions(spark, sf_dir)
    chunks = s.select(text.project_label(F.col("cwd")).alias("project"), F.col("seq").alias("rank"))
    return retrieval.project_counts(chunks).select("project", "n")


@query("chunk_origins", "csess", "SELECT CAST(row_number() OVER (ORDER BY seq) AS INT) AS msg_idx, id, CAST(seq % 3 AS INT) AS source_idx FROM csess")
def chunk_origins(spark, sf_dir):
    s = c.conversation_sessions(spark, sf_dir)
    chunks = s.select("id", F.col("seq").cast("float").alias("relevance"), F.lit(0).alias("rank"), F.when(F.col("seq") % 3 > 0, (F.col("seq") % 3).cast("int")).alias("msg_idx"))
    return retrieval.chunk_origins(chunks).select("msg_idx", "id", F.col("source_idx").cast("int").alias("source_idx"))


@query("prepended", "conv", "SELECT CAST(i AS INT) AS msg_idx, text FROM conv WHERE conv_id = 1 UNION ALL SELECT CAST(i + (SELECT count(*) FROM conv WHERE conv_id = 1) AS INT), text FROM conv WHERE conv_id = 2")
def prepended(spark, sf_dir):
    blocks = c.conversation_blocks(spark, sf_dir)
    return retrieval.prepend(blocks.where("doc = 'simple:conv-2'"), blocks.where("doc = 'simple:conv-1'")).select("msg_idx", "text")


@query("parent_lineage", "csess", "SELECT doc, CASE WHEN seq % 2 = 0 THEN 'conv-' || (seq // 2) ELSE 'lost-' || seq END AS parent FROM csess")
def parent_lineage(spark, sf_dir):
    s = c.conversation_sessions(spark, sf_dir).withColumn("file", F.concat(F.lit("/s/"), "id", F.lit(".jsonl")))
    file = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("/s/conv-"), F.floor(F.col("seq") / 2), F.lit(".jsonl"))).otherwise(F.concat(F.lit("/s/lost-"), "seq", F.lit(".jsonl")))
    return display.parent_lineage(s, s.select("doc", file.alias("parent_file")))


# ── verbs ──────────────────────────────────────────────────────────────
_RANKED = " SELECT id, msg_idx, relevance FROM ch WHERE relevance >= 0.15::FLOAT AND id NOT IN ({out}) ORDER BY relevance DESC, id, msg_idx, doc LIMIT 12"


@query("retrieve_local", "clines", _term_sql() + _RANKED.format(out="'conv-3', 'conv-4'"))
def retrieve_local(spark, sf_dir):
    options = retrieval.Options(exclude_sessions=["conv-3", "conv-4"])
    return verbs.retrieve_local(_conversations(spark, sf_dir), _QUERY, NOW, options).select("id", "msg_idx", "relevance")


@query("retrieve_and_optimize", "clines", _term_sql() + """, t AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id, msg_idx, doc) - 1 AS rank FROM ch WHERE relevance >= 0.15::FLOAT ORDER BY rank LIMIT 12)
 SELECT CAST(row_number() OVER (ORDER BY relevance, rank) AS INT) AS msg_idx, greatest(0::FLOAT, least(1::FLOAT, 0.4::FLOAT * (0.55::FLOAT + (1::FLOAT - 0.55::FLOAT) * relevance))) AS importance FROM t""")
def retrieve_and_optimize(spark, sf_dir):
    found = verbs.retrieve_and_optimize(_conversations(spark, sf_dir), _QUERY, NOW)
    items = trim.relevance_weighted(trim.decide(found.assembled), verbs.relevance_by_position(found.chunks, "simple:retrieved"))
    return items.where("msg_idx > 0").select("msg_idx", "importance")


@query("handoff", "items", "SELECT replace(doc, 'simple:', '') AS id, CAST(count(*) AS BIGINT) AS records FROM items WHERE decision <> 'drop' GROUP BY doc")
def handoff(spark, sf_dir):
    rows = verbs.handoff(event_sessions(spark, sf_dir), "freebuff")["messages"]
    return rows.groupBy(F.col("thread_id").alias("id")).agg(F.count("*").alias("records"))
