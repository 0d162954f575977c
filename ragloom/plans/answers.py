"""Named queries of subjects and candidates on their way to an answer, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.operators import candidates, subjects
from ragloom.plans.catalogue import query, table

# --- subjects (7.7, 11.15) -------------------------------------------------------------------------------------------------------------------
_HITS_SQL = r"""m AS (SELECT coalesce(city, '') AS session_id, client_id AS pos, trim(name) AS mention FROM clients WHERE source <> 'crm' AND trim(name) <> ''),
a AS (SELECT name AS alias, master_id AS subject_id, name AS standard_name FROM clients WHERE source = 'crm' AND name IS NOT NULL UNION SELECT name, NULL, name FROM vendors WHERE name IS NOT NULL),
n AS (SELECT t, regexp_replace(lower(t), '[^\w\p{L}]+', '', 'g') AS s FROM (SELECT mention AS t FROM m UNION SELECT alias FROM a)),
g AS (SELECT DISTINCT t, s[i:i+2] AS g FROM (SELECT t, s, unnest(range(1, greatest(length(s) - 1, 2))) AS i FROM n WHERE s <> '')), c AS (SELECT t, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT x.t AS mention, y.t AS alias, count(*) AS k FROM g x JOIN g y USING (g) WHERE x.t IN (SELECT mention FROM m) AND y.t IN (SELECT alias FROM a) GROUP BY ALL),
h AS (SELECT mention, alias, k / (x.n + y.n - k) AS score FROM k JOIN c x ON x.t = mention JOIN c y ON y.t = alias WHERE 100 * k > 60 * (x.n + y.n - k)),
r AS (SELECT mention, score, subject_id, standard_name, row_number() OVER (PARTITION BY mention ORDER BY score DESC, subject_id NULLS FIRST, standard_name NULLS FIRST, alias) AS rank FROM h JOIN a USING (alias) QUALIFY rank <= 5)"""


def _subject_inputs(spark, sf_dir):
    clients = table(spark, sf_dir, "clients")
    session = F.coalesce("city", F.lit("")).alias("session_id")
    mentions = clients.where("source <> 'crm'").select(session, F.col("client_id").alias("at"), F.col("name").alias("mention"))
    aliases = clients.where("source = 'crm'").select(F.col("name").alias("alias"), F.col("master_id").alias("subject_id"), F.col("name").alias("standard_name"))
    # vendors have no subject: their names take a mention's turn and confirm nothing
    aliases = aliases.unionByName(table(spark, sf_dir, "vendors").select(F.col("name").alias("alias"), F.lit(None).cast("long").alias("subject_id"), F.col("name").alias("standard_name")))
    sessions = clients.select(session).unionByName(table(spark, sf_dir, "client_changes").select(session))
    return sessions, mentions, aliases


@query(f"WITH {_HITS_SQL} SELECT mention, rank, round(score, 6) AS score, subject_id, standard_name FROM r")
def subject_alias_hits(spark, sf_dir):
    _, mentions, aliases = _subject_inputs(spark, sf_dir)
    return subjects.alias_hits(mentions, aliases).withColumn("score", F.round("score", 6))


@query(f"""WITH {_HITS_SQL}, s AS (SELECT mention, min(rank) FILTER (score > 0.75) AS sure FROM r GROUP BY ALL),
o AS (SELECT mention, row_number() OVER (PARTITION BY mention ORDER BY rank) - 1 AS slot, standard_name FROM r JOIN s USING (mention) WHERE sure IS NULL QUALIFY slot < 2),
f AS (SELECT session_id, 'confirmed' AS status, min({{'pos': pos, 'slot': 0, 'name': standard_name}}) AS p, subject_id FROM m JOIN s USING (mention) JOIN r ON r.mention = m.mention AND r.rank = s.sure
  WHERE subject_id IS NOT NULL AND standard_name <> '' GROUP BY session_id, subject_id
  UNION ALL SELECT session_id, 'ambiguous', min({{'pos': pos, 'slot': slot, 'name': standard_name}}), NULL FROM m JOIN o USING (mention) WHERE standard_name <> '' GROUP BY session_id, standard_name),
e AS (SELECT DISTINCT coalesce(city, '') AS session_id FROM (SELECT city FROM clients UNION SELECT city FROM client_changes)),
t AS (SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM f WHERE status = 'confirmed') THEN 'confirmed' WHEN session_id IN (SELECT session_id FROM f) THEN 'ambiguous'
  WHEN session_id IN (SELECT session_id FROM m) THEN 'not_found' ELSE 'no_mention' END AS status FROM e)
SELECT session_id, status, p.pos AS at, p.slot AS slot, subject_id, p.name AS standard_name FROM t LEFT JOIN f USING (session_id, status)""")
def subject_confirmation(spark, sf_dir):
    sessions, mentions, aliases = _subject_inputs(spark, sf_dir)
    return subjects.confirm_subjects(sessions, mentions, subjects.alias_hits(mentions, aliases))


# --- candidates (2.2, 11.4, 11.8, 11.12) -----------------------------------------------------------------------------------------------------
#: A page asks about itself: its paragraphs in order, the same by length, and its links as a web search's result.
_ANCHOR = """<a href="([^"]*)">([^<]*)</a>"""
_LISTS_SQL = f"""p AS (SELECT page_id AS query_id, url AS page_url, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), url) AS page_title,
  regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps, regexp_extract_all(html, '{_ANCHOR}', 1) AS hrefs, regexp_extract_all(html, '{_ANCHOR}', 2) AS names FROM pages),
q AS (SELECT query_id, page_url, page_title, unnest(range(1, 1 + len(ps))) AS pos, unnest(ps) AS content FROM p),
l AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY length(content) DESC, pos) AS by_length, page_title, CASE WHEN query_id % 2 = 1 THEN page_url END AS other_title, content, left(md5(content), 12) AS chunk_id FROM q),
u AS (SELECT query_id, unnest(range(1, 1 + len(hrefs))) AS pos, trim(unnest(hrefs)) AS url, trim(unnest(names)) AS content FROM p),
w AS (SELECT query_id, pos, url, content, CASE WHEN pos % 4 = 0 THEN url ELSE content END AS title, CASE pos % 3 WHEN 0 THEN pos / 4 ELSE 0.0::DOUBLE END AS score FROM u WHERE url <> '' AND content <> '' AND pos % 5 > 0),
i AS (SELECT query_id, 'local:' || chunk_id AS identity, round(1 / (60 + min(pos)) + 1 / (60 + min(by_length)), 9) AS score, 'original,hyde' AS channels, 'local' AS source_type, query_id::VARCHAR AS document_id, chunk_id,
    any_value(CASE WHEN other_title IS NULL THEN page_title ELSE least(page_title, other_title) END) AS title, any_value(content) AS content, NULL AS url FROM l GROUP BY query_id, chunk_id
  UNION ALL SELECT query_id, 'web:' || regexp_replace(url, '/+$', ''), round(1 / (60 + min(pos)), 9), 'web', 'web', NULL, NULL, arg_min(title, [content || '"', title || '"', url]), arg_min(content, [content || '"', title || '"', url]), arg_min(url, [content || '"', title || '"', url])
    FROM w GROUP BY query_id, regexp_replace(url, '/+$', '')),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS rank FROM i QUALIFY rank <= 10)"""


def _lists(spark, sf_dir):
    found = F.expr("regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("page_url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"), found.alias("ps"), *(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(i)).alias(c) for i, c in ((1, "hrefs"), (2, "names"))))
    by_length = F.sort_array(F.transform("ps", lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("content"))))["content"]

    def chunks(texts, source_title, file_title):
        rows = pages.select("query_id", F.posexplode(texts).alias("at", "content"), source_title.alias("source_title"), file_title.alias("file_title"))
        return candidates.local_candidates(rows.select("query_id", (F.col("at") + 1).alias("rank"), F.lit(0.0).alias("score"), F.col("query_id").alias("document_id"), F.left(F.md5("content"), F.lit(12)).alias("chunk_id"), "content", "source_title", "file_title", F.lit(True).alias("enabled")))

    def result(href, name, i):
        at = i + 1
        text = F.to_json(F.struct(F.when(at % 5 > 0, href).alias("url"), F.when(at % 4 > 0, name).alias("title"), name.alias("snippet")))
        score = F.when(at % 3 == 0, (at / 4).cast("string")).when(at % 3 == 1, F.lit('"0.9"')).otherwise("-1")
        return F.concat(F.left(text, F.length(text) - 1), F.lit(',"score":'), score, F.lit("}"))

    payload = F.transform(F.arrays_zip("hrefs", "names"), lambda z, i: result(z["hrefs"], z["names"], i))
    web = pages.select("query_id", F.concat(F.lit('{"pages":['), F.array_join(payload, ","), F.lit("]}")).alias("payload"))
    return {
        "original": chunks(F.col("ps"), F.col("page_title"), F.col("page_url")),
        "hyde": chunks(by_length, F.lit(" "), F.when(F.col("query_id") % 2 == 1, F.col("page_url"))),
        "web": candidates.web_candidates(web, "payload"),
    }


@query(f"WITH {_LISTS_SQL} SELECT query_id, rank, identity, score, channels, source_type, document_id, chunk_id, title, content, url FROM f")
def fused_candidates(spark, sf_dir):
    return candidates.fuse_candidates(_lists(spark, sf_dir), 10)


@query(f"""WITH {_LISTS_SQL}, e AS (SELECT query_id, 'original' AS channel, pos AS rank, 'local' AS source_type, chunk_id, NULL AS url, 0.0::DOUBLE AS score, content FROM l UNION ALL SELECT query_id, 'hyde', by_length, 'local', chunk_id, NULL, 0.0::DOUBLE, content FROM l
  UNION ALL SELECT query_id, 'web', pos, 'web', NULL, url, score, content FROM w)
SELECT e.query_id, channel, e.rank AS rank, e.source_type AS source_type, e.chunk_id AS chunk_id, e.url AS url, e.score AS score, f.rank IS NOT NULL AS entered_rerank, coalesce(f.rank <= 3, false) AS became_citation, CASE WHEN f.rank <= 2 THEN 0.5::DOUBLE ELSE 1 / f.rank END AS rerank_score, sha256(e.content) AS content_sha256
FROM e LEFT JOIN f ON f.query_id = e.query_id AND f.source_type = e.source_type AND coalesce(f.chunk_id, f.url) = coalesce(e.chunk_id, e.url)""")
def channel_hits(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    best = candidates.fuse_candidates(lists, 10)
    # the two best are scored twice: the last score counts
    scored = best.select("query_id", "source_type", "chunk_id", "url", F.explode(F.when(F.col("rank") <= 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("at"), "rank")
    scored = scored.withColumn("rerank_score", F.when(F.col("at") == 2, 0.5).otherwise(1 / F.col("rank")))
    return candidates.channel_hits(lists, scored, best.where("rank <= 3"))
