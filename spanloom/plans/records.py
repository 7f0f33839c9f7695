"""Queries over records: filters, sets, totals, sessions, exports, graphs, numbers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..operators import bm25, exports, numbers, records, suppression
from ..sources import sinks
from ..sources.tables import table
from .derived import register
from .lexical import bm25_sql, sql_tokens

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_missing(spark, sf_dir):
    """Documents without a label."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti")


@query("SELECT source, string_agg(lang, ',' ORDER BY o) AS langs FROM (SELECT source, lang, min(doc_id) AS o FROM documents GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    """Languages of every source in order of first appearance."""
    d = records.ordered_distinct(table(spark, sf_dir, "documents"), "source", "lang", "doc_id")
    return d.select("source", F.array_join("values", ",").alias("langs"))


@query("""SELECT n_name, count(*) FILTER (o_orderstatus = 'F') AS done, round(sum(o_totalprice), 2) AS total, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / sum(o_totalprice), 6) AS share
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def overview_totals(spark, sf_dir):
    """Totals of every nation's orders and the share of the finished ones."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    done = F.col("o_orderstatus") == "F"
    return j.groupBy("n_name").agg(F.count_if(done).alias("done"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("c_custkey").alias("customers"), F.round(F.sum(F.when(done, F.col("o_totalprice"))) / F.sum("o_totalprice"), 6).alias("share"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2")
def group_count(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + 0 AS g1, grouping(o_orderpriority) + 0 AS g2, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, sf_dir):
    """Counts over all combinations of status and priority, and their totals."""
    c = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return c.agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS stdev, round(var_samp(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS pstdev,
min(l_quantity) AS least, max(l_quantity) AS most, arg_max(q, (n, -q)) AS mode FROM lineitem JOIN (SELECT l_returnflag AS f, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) ON f = l_returnflag AND q = l_quantity GROUP BY 1""")
def stats_functions(spark, sf_dir):
    """The statistics that analysts may call, of quantities by return flag."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*records.statistics("l_quantity"))
    return s.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "variance", "pstdev")], "median", "least", "most", "mode")


@query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents GROUP BY 2")
def exact_dedupe(spark, sf_dir):
    """The first document of every distinct text."""
    d = sinks.distinct_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return sinks.with_fingerprint(d, "text").select("doc_id", "sha256")


_BITS = 62
_HASH = f"(SELECT vec_id AS id, list_sum(list_transform(generate_series(1, {_BITS}), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS h FROM embeddings)"


def _hashes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", records.bit_hash("embedding", _BITS).alias("hash"))


@query(f"SELECT a.id AS query, b.id, bit_count(xor(a.h, b.h))::INT AS distance FROM {_HASH} a, {_HASH} b WHERE a.id % 20 = 0 AND bit_count(xor(a.h, b.h)) <= 9")
def near_dupe_hamming(spark, sf_dir):
    """All vectors whose sign words are within nine bits of those of every twentieth vector."""
    h = _hashes(spark, sf_dir).select("id", "hash")
    return records.hamming_search(h.where("id % 20 = 0").withColumnRenamed("id", "query"), h, 9, _BITS)


@query(f"""WITH RECURSIVE h AS (SELECT x.id, label, h, row_number() OVER (PARTITION BY label ORDER BY x.id) AS k FROM {_HASH} x JOIN embeddings ON vec_id = x.id),
w AS (SELECT label, id, k, TRUE AS keep, [h] AS kept FROM h WHERE k = 1
  UNION ALL SELECT label, id, k, NOT near, CASE WHEN near THEN kept ELSE list_append(kept, h) END FROM (SELECT h.*, w.kept, len(list_filter(w.kept, lambda x: bit_count(xor(x, h.h)) <= 9)) > 0 AS near FROM w JOIN h USING (label) WHERE h.k = w.k + 1))
SELECT label, id FROM w WHERE keep""")
def near_dupe_greedy(spark, sf_dir):
    """Vectors of each label kept in order, without those within nine bits of a kept one."""
    return suppression.greedy_kept(_hashes(spark, sf_dir), "label", "id", "id", "hash", 9, width=_BITS).select("label", "id")


@query(
    f"""WITH a AS ({bm25_sql(tail="SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 4")}),
w AS (SELECT item_id AS query, list_sort(list_distinct({sql_tokens('text')})) AS w FROM benchmark),
f AS (SELECT query, list_distinct(flatten(list({sql_tokens('text')}))) AS f FROM a JOIN documents ON doc_id = doc GROUP BY 1),
m AS (SELECT query, max(score) FILTER (rank = 1) AS top, avg(score) FILTER (rank > 1) AS rest FROM a GROUP BY 1)
SELECT query, round(len(list_filter(w, lambda x: list_contains(f, x)))::DOUBLE / len(w), 6) AS coverage, array_to_string(list_filter(w, lambda x: NOT list_contains(f, x)), ' ') AS missing, round((top - rest) / top, 6) AS margin FROM w JOIN f USING (query) JOIN m USING (query)"""
)
def set_coverage(spark, sf_dir):
    """How far the four best documents cover a passage's words, which are missing, and the margin of the best."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    top = bm25.top(docs, items, 4)
    from ..functions.text import lexical_tokens

    words = items.select(F.col("item_id").alias("query"), F.array_sort(F.array_distinct(lexical_tokens(F.col("text")))).alias("w"))
    found = top.join(docs.select(F.col("doc_id").alias("doc"), F.array_distinct(lexical_tokens(F.col("text"))).alias("t")), "doc")
    found = found.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("f"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.avg(F.when(F.col("rank") > 1, F.col("score"))).alias("rest"))
    share = F.size(F.array_intersect("w", "f")) / F.size("w")
    return words.join(found, "query").select("query", F.round(share, 6).alias("coverage"), F.array_join(F.array_except("w", "f"), " ").alias("missing"), F.round((F.col("top") - F.col("rest")) / F.col("top"), 6).alias("margin"))


@query("""SELECT conv_id, turn, md5(text) AS digest, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS place FROM (SELECT *, row_number() OVER w AS back, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE back <= 6 AND chars <= 2000""")
def session_history(spark, sf_dir):
    """The last six turns of a conversation that fit 2,000 characters, in order."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = table(spark, sf_dir, "conversations").withColumn("back", F.row_number().over(w)).withColumn("chars", F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = t.where("back <= 6 AND chars <= 2000")
    return kept.select("conv_id", "turn", F.md5("text").alias("digest"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("place"))


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx FROM events")
def turn_sequence(spark, sf_dir):
    """The number of every event in its user's log, from 0."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("idx"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    """The last event of every user."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value > 10) SELECT user_id, event_type, event_id, value FROM a WHERE rn = 1""")
def upsert_latest(spark, sf_dir):
    """A log folded to the latest row per key, small values deleted first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    e = sinks.delete(e, e.where("value <= 10"), ["event_id"])
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    keyed = [x.withColumn("version", F.struct("ts", "event_id")) for x in (old, new)]
    return sinks.upsert(*keyed, ["user_id", "event_type"], "version").select("user_id", "event_type", "event_id", "value")


_URLS = (
    "", "ftp://a.example/x", "https://youtu.be/abc", "https://www.youtube.com/watch", "http://127.0.0.1/", "http://10.1.2.3:80/x", "https://192.168.0.9", "http://172.32.0.1/", "https://user:pw@8.8.8.8/v.mp4", "https://notyoutube.com/", "https:///x", "HTTPS://EXAMPLE.COM/A",
    "http://169.254.169.254/latest/meta-data/", "http://metadata.google.internal/computeMetadata/v1/", "http://127.0.0.1:8000/api/videos", "http://localhost:6333/collections", "http://LOCALHOST./x", "http://10.1.2.3/a.mp4", "http://172.16.5.5/a.mp4", "http://192.168.0.10/a.mp4", "http://[::1]/a.mp4", "http://0.0.0.0/a.mp4",
    "file:///etc/passwd", "gopher://internal/x", "http://[fe80::1]:80/", "http://[FD12:3456::1]/", "http://[ff02::1]/", "http://[::ffff:10.0.0.1]/", "http://[::ffff:8.8.8.8]/", "http://[2001:db8::1]/v.mp4", "http://[::]/", "http://[1:2]/", "http://2130706433/", "http://0x7f.1/", "http://0177.0.0.1/", "http://a@[::1]@b.example/", "http://192.0.1.1/", "http://198.19.255.255/", "http://198.20.0.0/", "http://100.127.1.1/", "http://100.128.1.1/", "http://223.255.255.255/", "http://224.0.0.1/",
    "http://[::ffff:7f00:1]/", "http://[::ffff:a9fe:a9fe]/x", "http://[::127.0.0.1]/", "http://[2002:7f00:1::]/", "http://[2002:808:808::1]/", "http://[64:ff9b::7f00:1]/", "http://[64:ff9b::808:808]/", "http://[::ffff:0:10.0.0.1]/", "http://[2001:0:1::f5ff:fffe]/",
    "http://[::ffff:808:808]/", "http://[1:2:3:4:5:6:7:8]/", "http://[1::2::3]/", "http://[1:2:3:4:5:6:7:8:9]/", "http://[1:2:3:4:5:6:7::]/", "http://[2001:db8::1%25eth0]/", "http://[::ffff:999.0.0.1]/", "http://[12345::1]/", "http://[:1:2:3:4:5:6:7]/", "http://[::1", "http://\uff11\uff12\uff17.0.0.1/",
)
_VALUES = ", ".join(f"({-1 - i}, '{u}')" for i, u in enumerate(_URLS))


# The SQL states the same in its own way: an IPv6 address becomes its 32 hexadecimal digits, networks are patterns of written forms.
_DOTTED_BLOCKED = r"(0|10|127|22[4-9]|2[345]\d|169\.254|192\.168|192\.0\.0|198\.1[89]|172\.(1[6-9]|2\d|3[01])|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7]))(\.\d+)+"
_DOTTED_OF = "printf('%d.%d.%d.%d', ('0x' || {x}[1:2])::INT, ('0x' || {x}[3:4])::INT, ('0x' || {x}[5:6])::INT, ('0x' || {x}[7:8])::INT)"


@query(
    rf"""WITH u AS (SELECT page_id AS id, trim(url) AS url FROM pages UNION ALL SELECT * FROM (VALUES {_VALUES})), h AS (SELECT *, rtrim(regexp_extract(lower(url), '^https?://([^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 2), '.') AS host FROM u),
i AS (SELECT *, CASE WHEN starts_with(host, '[') THEN regexp_replace(regexp_replace(host, '^\[|\]$', '', 'g'), '%.*$', '') END AS inner6 FROM h),
j AS (SELECT *, regexp_extract(inner6, '(?:^|:)((?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|[01]?\d?\d))$', 1) AS v4 FROM i),
k AS (SELECT *, CASE WHEN v4 <> '' THEN inner6[1:length(inner6) - length(v4)] || printf('%x:%x', split_part(v4, '.', 1)::INT * 256 + split_part(v4, '.', 2)::INT, split_part(v4, '.', 3)::INT * 256 + split_part(v4, '.', 4)::INT) ELSE inner6 END AS w FROM j),
l AS (SELECT *, CASE WHEN length(w) - length(replace(w, '::', '')) = 2 THEN CASE WHEN length(replace(w, '::', ':')) - length(replace(w, ':', '')) - 1 <= 7 THEN
    replace(w, '::', CASE WHEN starts_with(w, '::') THEN '' ELSE ':' END || repeat('0:', 8 - len(list_filter(string_split(w, ':'), lambda g: g <> ''))::INT) || CASE WHEN ends_with(w, '::') THEN '' ELSE '' END) END WHEN NOT contains(w, '::') THEN w END AS wide FROM k),
m AS (SELECT *, CASE WHEN regexp_full_match(rtrim(wide, ':'), '([0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}') THEN array_to_string(list_transform(string_split(rtrim(wide, ':'), ':'), lambda g: lpad(g, 4, '0')), '') END AS x FROM l),
n AS (SELECT *, CASE WHEN regexp_matches(x, '^(0{{24}}|0{{20}}ffff|0{{16}}ffff0000|0064ff9b0{{16}})') THEN {_DOTTED_OF.format(x="x[25:32]")} WHEN x[1:4] = '2002' THEN {_DOTTED_OF.format(x="x[5:12]")}
    WHEN x[1:8] = '20010000' THEN {_DOTTED_OF.format(x="translate(x[25:32], '0123456789abcdef', 'fedcba9876543210')")} END AS inside FROM m)
SELECT id, CASE WHEN url = '' THEN 'empty' WHEN length(url) > 2048 THEN 'too_long' WHEN lower(split_part(url, ':', 1)) NOT IN ('http', 'https') THEN 'scheme' WHEN host = '' THEN 'no_host'
WHEN regexp_full_match(host, '(www\.|.*\.)?(youtube|vimeo|dailymotion|tiktok|instagram|facebook|x|twitter)\.com|(www\.|.*\.)?(youtu\.be|twitch\.tv)') THEN 'page_host'
WHEN regexp_full_match(host, '(.*\.)?(localhost|localdomain|internal|local)') THEN 'blocked'
WHEN regexp_full_match(coalesce(inside, host), '{_DOTTED_BLOCKED}') AND regexp_matches(coalesce(inside, host), '^\d+\.\d+\.\d+\.\d+$') THEN 'blocked'
WHEN starts_with(host, '[') AND (x IS NULL OR regexp_matches(x, '^(f[cd]|fe[89ab]|ff)')) THEN 'blocked' WHEN regexp_matches(host, '[\x{{FF00}}-\x{{FFEF}}\x{{3002}}]') THEN 'blocked'
WHEN regexp_full_match(host, '[0-9a-fx.]*') AND regexp_matches(host, '^(\d+$|0x|0\d)') THEN 'blocked' ELSE 'ok' END AS verdict FROM n"""
)
def url_admissible(spark, sf_dir):
    """Whether each address may be fetched, and else why not."""
    fixed = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(_URLS)], "id long, url string")
    u = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(fixed)
    return u.select("id", pr.url_verdict(F.col("url")).alias("verdict"))


_HEADERS = ("0000001866747970697336F6D000000000", "1A45DFA3934282886D6174726F736B61", "504B03041400000008000000", "7F454C4602010100000000000000", "524946460000000041564920", "47400010000000000000000000", "255044462D312E340A0000000000", "0011", "00112233445566778899AABBCC")
_HEADERS = tuple(h if len(h) % 2 == 0 else h[:-1] for h in _HEADERS)


@query(
    f"""WITH f AS (SELECT page_id AS id, hex(encode(left(html, 16))) AS h FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f"({-1 - i}, '{h}')" for i, h in enumerate(_HEADERS))}))
SELECT id, CASE WHEN length(h) < 24 THEN 'small' {' '.join(f"WHEN starts_with(h, '{m}') THEN '{n}'" for m, n in pr.FORBIDDEN)} {' '.join(f"WHEN substr(h, {2 * o + 1}, {len(m)}) = '{m}' THEN '{n}'" for o, m, n in pr.CONTAINERS)} ELSE 'unknown' END AS verdict FROM f"""
)
def media_sniff(spark, sf_dir):
    """What the first bytes of each file are."""
    fixed = spark.createDataFrame([(-1 - i, bytearray.fromhex(h)) for i, h in enumerate(_HEADERS)], "id long, header binary")
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode(F.substring("html", 1, 16), "UTF-8").alias("header")).unionByName(fixed)
    return f.select("id", pr.media_verdict(F.col("header")).alias("verdict"))


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.col("role").alias("speaker"), "text", (F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 10).cast("double").alias("end"))


_CUE = r"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') = '' THEN '...' ELSE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') END"
_STAMP = lambda s, mark: f"printf('%02d:%02d:%02d{mark}000', ({s}) // 3600, ({s}) // 60 % 60, ({s}) % 60)"


@query(f"""SELECT conv_id, md5(string_agg(n || chr(10) || {_STAMP('turn * 10', ',')} || ' --> ' || {_STAMP('turn * 10 + 10', ',')} || chr(10) || '[' || role || '] ' || {_CUE} || chr(10), chr(10) ORDER BY turn)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""")
def export_srt(spark, sf_dir):
    """Every conversation as SRT."""
    return exports.to_srt(_turns(spark, sf_dir), "conv_id", "turn").select("conv_id", F.md5("body").alias("digest"))


@query(f"""SELECT conv_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg({_STAMP('turn * 10', '.')} || ' --> ' || {_STAMP('turn * 10 + 10', '.')} || chr(10) || '<v ' || role || '>' || {_CUE} || chr(10), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def export_vtt(spark, sf_dir):
    """Every conversation as WebVTT."""
    return exports.to_vtt(_turns(spark, sf_dir), "conv_id", "turn").select("conv_id", F.md5("body").alias("digest"))


@query(f"""WITH r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)),
g AS (SELECT conv_id, run, '[' || left({_STAMP('min(turn) * 10', '.')}, 8) || '] ' || any_value(role) || ': ' || string_agg({_CUE}, ' ' ORDER BY turn) AS l FROM r GROUP BY 1, 2)
SELECT conv_id, md5(string_agg(l, chr(10) || chr(10) ORDER BY run)) AS digest FROM g GROUP BY 1""")
def export_txt(spark, sf_dir):
    """Every conversation as readable paragraphs."""
    return exports.to_text(_turns(spark, sf_dir), "conv_id", "turn").select("conv_id", F.md5("body").alias("digest"))


_CELL = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\n\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_GUARD = r"CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE text END"


@query(f"WITH g AS (SELECT conv_id, turn, role, {_GUARD} AS g FROM conversations) SELECT conv_id, turn, md5(turn || ',' || {_CELL('role')} || ',' || {_CELL('g')}) AS digest FROM g")
def export_csv_rows(spark, sf_dir):
    """Every turn as a CSV line."""
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", F.md5(exports.csv_row(t, {"turn": F.col("turn"), "speaker": F.col("speaker"), "text": F.col("text")})).alias("digest"))


@query("""SELECT c.conv_id, md5(to_json({'schema': 'analysis@1', 'record': {'conv_id': c.conv_id, 'turns': c.n}, 'segments': list({'turn': t.turn, 'speaker': t.role} ORDER BY t.turn)})::VARCHAR) AS digest
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c JOIN conversations t USING (conv_id) GROUP BY c.conv_id, c.n""")
def bundle_json(spark, sf_dir):
    """Every conversation as one JSON document with its turns nested."""
    t = _turns(spark, sf_dir)
    parents = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return exports.bundle(parents, "conv_id", {"segments": (t.select("conv_id", "turn", "speaker"), ["turn"])}, "analysis@1").select("conv_id", F.md5("body").alias("digest"))


#: Parts as a graph: each is built into the one of half its key and the one of a third of it.
_SQL_EDGES = "e AS (SELECT DISTINCT p_partkey AS node, unnest([p_partkey // 2, p_partkey // 3]) AS needs FROM part), r AS (SELECT * FROM e WHERE needs <> node AND needs IN (SELECT p_partkey FROM part))"


def _edges(spark, sf_dir):
    into = F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.explode(into).alias("needs")).withColumn("needs", F.when(F.col("needs") != F.col("node"), F.col("needs")))


@query(f"WITH RECURSIVE {_SQL_EDGES}, w(node, depth) AS (SELECT p_partkey, 0 FROM part UNION SELECT r.node, w.depth + 1 FROM r JOIN w ON r.needs = w.node) SELECT node, max(depth)::INT AS depth FROM w GROUP BY 1")
def dag_topo_order(spark, sf_dir):
    """The level of every part: the longest way down to it."""
    return records.graph_depths(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_SQL_EDGES}, w(node, ancestor) AS (SELECT node, needs FROM r UNION SELECT w.node, r.needs FROM w JOIN r ON r.node = w.ancestor) SELECT node, ancestor FROM w")
def ancestors(spark, sf_dir):
    """What each part is built into, directly or not."""
    edges = _edges(spark, sf_dir)
    return records.graph_ancestors(edges.join(edges.select(F.col("node").alias("needs")).distinct(), "needs", "left_semi"))


_SPEECHES = (
    "Revenue was forty two million dollars in the first quarter, fifty one million in the second, the third quarter came in at sixty eight million, and the fourth quarter reached ninety one million.",
    "Q1 $42M, Q2 $51M, Q3 $68M and Q4 $91M", "23.5% of 1,200 users", "nothing to count here",
)


@query()
def number_series(spark, sf_dir):
    """Series of numbers said in fixed sentences and in all conversations, with growth."""
    said = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(_SPEECHES)], "id long, text string")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    series = numbers.build_series(numbers.extract_numbers(said.unionByName(turns), "id", "text"), "id")
    return series.join(numbers.series_statistics(series, "id"), "id", "left")


_SCALES = "CASE lower(regexp_extract(m, '[A-Za-z%]+$')) " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in numbers.SUFFIXES.items()) + " ELSE 1 END"


@query(f"""WITH m AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '(?i)q?[$€£]?\\s*(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+(?:\\.[0-9]+)?)\\s*(?:{"|".join(numbers.SUFFIXES)})?'), lambda m: NOT regexp_matches(m, '^[qQ][0-9]'))) AS m FROM documents),
v AS (SELECT doc_id, replace(regexp_extract(m, '[0-9][0-9,]*(\\.[0-9]+)?'), ',', '')::DOUBLE * {_SCALES} AS v, CASE WHEN regexp_matches(m, '(?i)(%|percent)$') THEN '%' ELSE regexp_extract(m, '[$€£]') END AS unit FROM m)
SELECT doc_id, count(*) AS n, min(v) AS least, max(v) AS most, array_to_string(list_sort(list(DISTINCT unit)), '') AS units FROM v GROUP BY 1""")
def document_numbers(spark, sf_dir):
    """Numbers in digits in every document: how many, their least and greatest value, their units."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    each = d.select("doc_id", F.explode(numbers.numbers_in_digits("text")).alias("x"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("x.value").alias("least"), F.max("x.value").alias("most"), F.array_join(F.array_sort(F.collect_set("x.unit")), "").alias("units"))


@query()
def document_series(spark, sf_dir):
    """Series of numbers said in all documents, with growth."""
    series = numbers.build_series(numbers.extract_numbers(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    return series.join(numbers.series_statistics(series, "doc_id"), "doc_id", "left")


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND contains(lower(text || ' ' || source), 'the') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def filtered_page(spark, sf_dir):
    """A page of the library: filtered, searched, ordered, cut."""
    d = table(spark, sf_dir, "documents").where(records.search_filter(["src1", "src2"], group_col="source") & (F.col("lang") == "en") & records.contains_text("the", F.col("text"), F.col("source")))
    return records.page(d.select("doc_id", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 10)
