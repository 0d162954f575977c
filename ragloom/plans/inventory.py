"""More named queries: joins, sets, windows, curation and lifecycle steps over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import comparisons, evidence, lifecycle, metrics, predicates, sets
from ragloom.plans.catalogue import query, table
from ragloom.plans.storage import stored

# --- predicates (3.x) ------------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size IN (1, 5, 7, 9) ")
def structured_identifier_filter(spark, sf_dir):
    names = {"equipment_model": "p_brand", "part_number": "p_size"}
    return table(spark, sf_dir, "part").where(predicates.structured({"equipment_model": ["Brand#11", "Brand#12", "Brand#13"], "part_number": [1, 5, 7, 9]}, rename=names)).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber >= 2 AND l_linenumber < 5")
def management_filter(spark, sf_dir):
    names = {"document": "l_orderkey", "version": "l_returnflag", "enabled": "l_linestatus", "index": "l_linenumber"}
    return table(spark, sf_dir, "lineitem").where(predicates.managed(version="R", index_min=2, index_max=5, names=names)).select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, CASE WHEN o.n IS NOT NULL THEN 'editor' END AS role,
coalesce(c_custkey = 7 OR c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND o.n IS NOT NULL), false) AS readable, coalesce(c_custkey = 7 OR o.n IS NOT NULL, false) AS writable
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def document_permissions(spark, sf_dir):
    members = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("editor").alias("role")).distinct()
    rows = table(spark, sf_dir, "customer").join(members, "c_custkey", "left")
    visibility = F.when(F.col("c_mktsegment") == "BUILDING", "public").when(F.col("c_mktsegment") == "MACHINERY", "shared").otherwise("private")
    return rows.select("c_custkey", "role", predicates.can_read(visibility, F.col("c_custkey"), F.col("role"), 7).alias("readable"), predicates.can_write(F.col("c_custkey"), F.col("role"), 7).alias("writable"))


@query("""SELECT s_suppkey, CASE WHEN s > 0.75 THEN 'confirmed' WHEN s > 0.60 THEN 'candidate' ELSE 'none' END AS band FROM (SELECT s_suppkey, s_acctbal / 10000.0 AS s FROM supplier)""")
def score_bands(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", predicates.score_band(F.col("s_acctbal") / 10000.0).alias("band"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AND n > 0 AND r > 0 AND top >= 0.75 AND o_orderpriority <> '1-URGENT' AS enough FROM orders JOIN
(SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, max(l_quantity) / 50 AS top FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def evidence_sufficient(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), (F.max("l_quantity") / 50).alias("top"))
    rows = table(spark, sf_dir, "orders").join(seen, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", predicates.sufficient(F.col("o_orderstatus") == "F", F.col("n"), F.col("r"), F.col("top"), F.col("o_orderpriority") != "1-URGENT").alias("enough"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def snapshot_completed(spark, sf_dir):
    done = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    gone = F.when(F.col("o_orderpriority") == "5-LOW", "2024-01-01")
    return table(spark, sf_dir, "orders").where(predicates.completed(done, F.lit("completed"), gone)).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 80 THEN 'too_short' END, CASE WHEN contains(text, 'licensed') THEN 'boilerplate' END,
CASE WHEN right(rtrim(text), 1) NOT IN ('.', '!', '?') THEN 'no_sentence_end' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents WHERE text IS NOT NULL AND length(text) > 0""")
def completeness_codes(spark, sf_dir):
    rules = [(F.col("n_chars") < 80, "too_short"), (F.contains("text", F.lit("licensed")), "boilerplate"), (~F.right(F.rtrim("text"), F.lit(1)).isin(".", "!", "?"), "no_sentence_end")]
    return table(spark, sf_dir, "documents").where("text IS NOT NULL AND length(text) > 0").select("doc_id", F.array_join(predicates.codes(rules), ",").alias("reasons"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject/safety' WHEN quality = 0 THEN 'reject/quality' WHEN n_chars < 200 THEN 'reject/short' WHEN lang <> 'en' THEN 'accept/other_language' ELSE 'accept/plain' END AS decision
FROM documents JOIN labels USING (doc_id)""")
def selection_decision(spark, sf_dir):
    rules = [(F.col("toxic") == 1, "reject/safety"), (F.col("quality") == 0, "reject/quality"), (F.col("n_chars") < 200, "reject/short"), (F.col("lang") != "en", "accept/other_language")]
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", predicates.first_code(rules, "accept/plain").alias("decision"))


@query("""SELECT doc_id, array_to_string(list_filter(['licensed', 'cookie', 'subscribe'], lambda t: contains(lower(coalesce(text, '')), t)), ',') AS found FROM documents""")
def contamination_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(predicates.contaminated(F.coalesce("text", F.lit("")), ["licensed", "cookie", "subscribe"]), ",").alias("found"))


@query("""SELECT event_id, CASE WHEN props LIKE '%"k"%' THEN 'k' ELSE '' END AS banned FROM events""")
def banned_json_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(predicates.json_keys(F.col("props"), ["k", "secret"]), ",").alias("banned"))


# --- sets (8.x, 3.24, 4.12-4.16) -------------------------------------------------------------------------------------------------------------
_BASKETS = "(SELECT l_orderkey, list_sort(list_distinct(list(l_shipmode))) AS a FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1)"


@query(f"""SELECT l_orderkey, array_to_string(list_sort(list_filter(['RF', 'AF', 'NO'], lambda x: NOT list_contains(a, x))), ',') AS missing, list_has_all(a, ['NO']) AS covers,
len(a) = 2 AND list_has_all(a, ['RF', 'AF']) AS same, array_to_string(list_sort(list_filter(['NF', 'RF'], lambda x: list_contains(a, x))), ',') AS banned FROM {_BASKETS}""")
def set_algebra(spark, sf_dir):
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("a"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return kinds.select("l_orderkey", F.array_join(sets.missing(lit("RF", "AF", "NO"), F.col("a")), ",").alias("missing"), sets.covers(lit("NO"), F.col("a")).alias("covers"), sets.same_members(F.col("a"), lit("RF", "AF")).alias("same"), F.array_join(sets.forbidden(F.col("a"), lit("NF", "RF")), ",").alias("banned"))


@query("""WITH both_ AS (SELECT l_orderkey, l_partkey, 0 AS list, l_linenumber AS place, 'returned' AS source FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, l_partkey, 1, l_linenumber, 'all' FROM lineitem)
SELECT l_orderkey, l_partkey, source, list::BIGINT AS list, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY list, place) AS r FROM both_) WHERE r = 1""")
def ordered_union_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return sets.merged({"returned": rows.where("l_returnflag = 'R'"), "all": rows}, "l_orderkey", "l_partkey", "l_linenumber")


@query("""WITH a AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1)
SELECT nation, a.n AS left_value, b.n AS right_value, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' ELSE 'differs' END AS status FROM a FULL JOIN b USING (nation) WHERE a.n IS DISTINCT FROM b.n""")
def manifest_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return sets.reconcile(a, b, "nation", "n")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL), c AS (SELECT k, count(*) AS n FROM p GROUP BY 1)
SELECT CASE WHEN c_custkey IS NULL THEN 'outside' WHEN n IS NULL THEN 'uncovered' WHEN n > 1 THEN 'overlap' ELSE 'once' END AS status, count(*) AS n FROM (SELECT c_custkey, c.n FROM customer FULL JOIN c ON k = c_custkey) GROUP BY 1""")
def partition_cover(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return sets.partition_report({s: orders.where(F.col("o_orderstatus") == s) for s in ("F", "O")}, table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT l_partkey, count(DISTINCT l_returnflag) AS splits, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def crossing_groups(spark, sf_dir):
    return sets.crossing_groups(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


# --- comparisons (4.7-4.13, 10.19) -----------------------------------------------------------------------------------------------------------
@query("""SELECT l_orderkey, a AS left_value, b AS right_value, b - a AS delta FROM (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS b FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_deltas(spark, sf_dir):
    return comparisons.paired_deltas(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1, 2, "l_quantity")


@query("""SELECT CASE WHEN a AND b THEN 'stable' WHEN NOT a AND NOT b THEN 'still_failing' WHEN b THEN CASE WHEN p THEN 'fixed_evidence' ELSE 'fixed_path' END WHEN e THEN 'regressed_policy' ELSE 'regressed_evidence' END AS why, count(*) AS n
FROM (SELECT x.l_quantity > 25 AS a, y.l_quantity > 25 AS b, x.l_returnflag = y.l_returnflag AS p, x.l_linestatus = y.l_linestatus AS e FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_linenumber = 1 AND y.l_linenumber = 2) GROUP BY 1""")
def run_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    x, y = (rows.where(F.col("l_linenumber") == n).select("l_orderkey", F.struct("l_quantity", "l_returnflag", "l_linestatus").alias(c)) for n, c in ((1, "x"), (2, "y")))
    why = comparisons.run_attribution(F.col("x.l_quantity") > 25, F.col("y.l_quantity") > 25, F.col("x.l_returnflag") == F.col("y.l_returnflag"), F.col("x.l_linestatus") == F.col("y.l_linestatus"))
    return x.join(y, "l_orderkey").groupBy(why.alias("why")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, k AS l_orderkey, q AS l_quantity FROM part LEFT JOIN (SELECT l_partkey, l_orderkey AS k, l_quantity AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1) ON l_partkey = p_partkey""")
def last_evidence_binding(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return comparisons.last_binding(table(spark, sf_dir, "part").select("p_partkey"), lines, "p_partkey", "l_orderkey", ["l_quantity"])


# --- aggregates (5.x) ------------------------------------------------------------------------------------------------------------------------
@query("""SELECT source, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 1000) AS long, count(DISTINCT lower(trim(text))) AS texts, count(DISTINCT lang) FILTER (lang <> 'en') AS others FROM documents GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 1000).alias("long"), F.count_distinct(F.lower(F.trim("text"))).alias("texts"), F.count_distinct(F.when(F.col("lang") != "en", F.col("lang"))).alias("others"))


@query("""SELECT l_returnflag AS mode, l_linestatus AS grp, round(avg(l_quantity), 4) AS mean, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity) AS p95, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")
def per_mode_summary(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("ragloom_lineitem")
    return spark.sql("SELECT l_returnflag AS mode, l_linestatus AS grp, round(avg(l_quantity), 4) AS mean, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity) AS p95, count(*) AS n FROM ragloom_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")


@query("""SELECT b, round(avg(m), 4) AS mean_margin, round(min(m), 4) AS least_margin, sum(CASE WHEN m < 0 THEN 1 ELSE 0 END)::BIGINT AS inverted FROM (SELECT l_suppkey % 5 AS b, l_orderkey, min(l_extendedprice) FILTER (l_returnflag = 'N') - max(l_extendedprice) FILTER (l_returnflag <> 'N') AS m FROM lineitem GROUP BY ALL) WHERE m IS NOT NULL GROUP BY 1""")
def margin_rollup(spark, sf_dir):
    good = F.col("l_returnflag") == "N"
    margins = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("b"), "l_orderkey").agg((F.min(F.when(good, F.col("l_extendedprice"))) - F.max(F.when(~good, F.col("l_extendedprice")))).alias("m"))
    return margins.where("m IS NOT NULL").groupBy("b").agg(F.round(F.avg("m"), 4).alias("mean_margin"), F.round(F.min("m"), 4).alias("least_margin"), F.count_if(F.col("m") < 0).alias("inverted"))


@query("""SELECT l_orderkey, bool_and(l_tax > 0) AS available, CASE WHEN bool_and(l_tax > 0) THEN sum(l_linenumber) ELSE 0 END::BIGINT AS l_linenumber FROM lineitem GROUP BY 1""")
def usage_rollup(spark, sf_dir):
    return lifecycle.usage(table(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_tax") > 0), "l_orderkey", "ok", ["l_linenumber"])


@query("SELECT user_id, max(value) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def streaming_usage_peak(spark, sf_dir):
    return lifecycle.peak(table(spark, sf_dir, "events"), "user_id", ["value", "event_id"])


@query("SELECT l_orderkey, count(*) AS turns, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS unbroken FROM lineitem GROUP BY 1")
def trajectory_continuity(spark, sf_dir):
    return lifecycle.unbroken(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT n_name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal >= 0 GROUP BY 1) ON s_nationkey = n_nationkey""")
def dataset_member_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS versions, max(p_size) AS latest FROM part GROUP BY 1")
def version_map(spark, sf_dir):
    return lifecycle.versions(table(spark, sf_dir, "part"), "p_brand", "p_size").withColumn("versions", F.array_join(F.col("versions").cast("array<string>"), ","))


@query("""SELECT o_orderstatus, sha256(string_agg(o_orderkey::VARCHAR || ':' || o_orderpriority, chr(10) ORDER BY o_orderkey::VARCHAR || ':' || o_orderpriority)) AS fingerprint FROM orders GROUP BY 1""")
def set_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "o_orderkey", "o_orderpriority"))), "\n"), 256).alias("fingerprint"))


# --- windows (6.x) ---------------------------------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, n AS newest_good FROM orders LEFT JOIN (SELECT o_custkey AS c, o_orderkey AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1) ON c = o_custkey""")
def newest_completed_per_group(spark, sf_dir):
    return lifecycle.folded(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "newest_good")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events""")
def previous_observation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return rows.select("event_id", lifecycle.previous("bought", "user_id", "event_id").alias("before"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS best_acceptable, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS best FROM lineitem""")
def path_rank_per_case(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber")).cast("long").alias("rank"), F.max(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice"))).over(w).alias("best_acceptable"), F.max("l_extendedprice").over(w).alias("best"))


@query("""WITH u AS (SELECT p_partkey, string_split(p_name, ' ') AS u FROM part), r AS (SELECT p_partkey, 2 AS k, i, array_to_string(u[i:i+1], ' ') AS t FROM (SELECT *, unnest(range(1, len(u))) AS i FROM u) UNION ALL SELECT p_partkey, 3, i, array_to_string(u[i:i+2], ' ') FROM (SELECT *, unnest(range(1, len(u) - 1)) AS i FROM u))
SELECT p_partkey, count(*) AS n, sum(length(t))::BIGINT AS chars FROM r WHERE length(t) BETWEEN 8 AND 40 GROUP BY 1""")
def adjacent_segments(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select("p_partkey", F.explode(lifecycle.adjacent(F.split("p_name", " "), (2, 3), 8, 40)).alias("t"))
    return runs.groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


@query("SELECT s_suppkey, ['amber', 'blue', 'coral'][1 + (s_suppkey + 4) % 3] AS pool FROM supplier")
def round_robin_pool(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", lifecycle.round_robin(F.col("s_suppkey"), 4, ["amber", "blue", "coral"]).alias("pool"))


@query("""SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS share,
count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM customer""")
def range_frames(spark, sf_dir):
    w = Window.partitionBy("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.ntile(4).over(w.orderBy("c_acctbal", "c_custkey")).cast("long").alias("quarter"), F.round(F.cume_dist().over(w.orderBy("c_acctbal")), 6).alias("share"), F.count("*").over(w.orderBy("c_acctbal").rangeBetween(-500, 500)).alias("near"))


# --- candidates, citations, metrics (7.x, 11.x, 12.x) ----------------------------------------------------------------------------------------
_TERMS = "(SELECT l_partkey AS id, l_suppkey AS term, round(sum(l_quantity) / 50, 4) AS weight FROM lineitem GROUP BY ALL)"


@query(f"""WITH t AS {_TERMS}, s AS (SELECT q.id AS query_id, i.id, round(sum(q.weight * i.weight), 6) AS score FROM t q JOIN t i USING (term) WHERE q.id % 20 = 0 AND q.id <> i.id GROUP BY ALL)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def learned_sparse_topk(spark, sf_dir):
    terms = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("term")).agg(F.round(F.sum("l_quantity") / 50, 4).alias("weight"))
    # both sides and the sizes of their blocks are read from it
    terms = stored(terms, "sparse-terms")
    return evidence.sparse_top_k(terms.where("id % 20 = 0"), terms, 5)


@query("""SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, citation FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS citation FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem WHERE l_returnflag <> 'A') WHERE r = 1) WHERE citation <= 3""")
def citation_builder(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_returnflag") != "A", F.col("l_quantity")))
    return evidence.citations(rows, "l_orderkey", "l_suppkey", "l_quantity", "l_linenumber", 3)


@query("""SELECT l_orderkey, candidates, reranked, top, exact, CASE WHEN reranked = 0 THEN 'not_reranked' WHEN top >= 0.75 THEN 'sufficient' ELSE 'low_score' END AS status FROM
(SELECT l_orderkey, count(*) AS candidates, count(*) FILTER (l_returnflag = 'R') AS reranked, max(l_discount * 10) AS top, bool_or(l_linestatus = 'O') AS exact FROM lineitem GROUP BY 1)""")
def observation_builder(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_discount") * 10).withColumn("kept", F.col("l_returnflag") == "R")
    return evidence.observation(rows, "l_orderkey", "score", "kept", {"exact": F.col("l_linestatus") == "O"})


@query("""SELECT conv_id, string_agg(left(coalesce(text, ''), 40), ' | ' ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3 GROUP BY 1""")
def answer_context(spark, sf_dir):
    firsts = evidence.excerpts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3, 40)
    return firsts.select("conv_id", F.array_join("excerpts", " | ").alias("context"))


@query("""SELECT p_brand, rich, p_size, p_type FROM (SELECT p_brand, p_size, p_type, (p_size > 0)::BIGINT + (CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS rich, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END DESC, p_partkey) AS r FROM (SELECT p_brand, p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS p_type FROM part)) WHERE r = 1""")
def richest_candidate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")))
    return evidence.richest(rows, ["p_brand"], ["p_size", "p_type"], "p_partkey")


@query("""SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT + contains(lower(text), ' of ')::INT) / 3.0, 6) AS coverage FROM documents WHERE text IS NOT NULL""")
def answer_coverage(spark, sf_dir):
    points = F.array(F.lit("The"), F.lit("LICENSE"), F.lit(" of "))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.round(evidence.coverage(F.col("text"), points, F.lower), 6).alias("coverage"))


@query("""WITH p AS (SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, s IN ('NN', 'N', 'RA', 'AAN') AS matches, 1 AS shortest FROM p""")
def path_match(spark, sf_dir):
    paths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("p"))
    wanted = F.array(*(F.array(*map(F.lit, p)) for p in ("NN", "N", "RA", "AAN")))
    matches, shortest = evidence.path_match(F.transform("p", lambda s: s["l_returnflag"]), wanted)
    return paths.select("l_orderkey", matches.alias("matches"), shortest.alias("shortest"))


@query("SELECT sha256(coalesce(l_orderkey::VARCHAR, '') || chr(1) || coalesce(l_linenumber::VARCHAR, '') || chr(1) || l_returnflag) AS key, l_orderkey, l_linenumber FROM lineitem")
def evidence_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.sha2(evidence.evidence_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")), 256).alias("key"), "l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS rank, l_returnflag = 'R' AS hit, count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
t AS (SELECT l_orderkey, count(*) AS got, max(n) AS n, count(*) FILTER (hit) AS hits, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r WHERE rank <= 3 GROUP BY 1),
i AS (SELECT k, sum(1 / log2(j + 1)) AS ideal FROM (SELECT unnest([1, 2, 3]) AS k) a, (SELECT unnest([1, 2, 3]) AS j) b WHERE j <= k GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN n > 0 THEN hits / n ELSE 0 END, 6) AS recall, round(CASE WHEN n > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM t LEFT JOIN i ON k = least(n, got, 3)""")
def ranking_metrics_retrieved(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("hit"))
    counts = rows.groupBy("l_orderkey").agg(F.count_if("hit").alias("n"))
    return evidence.retrieved_metrics(rows.join(counts, "l_orderkey"), "l_orderkey", "n", 3)


_PARTS = "l_quantity / 50 AS r, l_discount * 10 AS m, l_tax * 10 AS d, l_linenumber AS k, l_returnflag = 'R' AS a, l_linestatus = 'O' AS b FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, CASE WHEN b THEN least(.4 * r + .25 * m + .25 * d + .1, .4) ELSE .4 * r + .25 * m + .25 * d + .1 END)), 6) AS retrieval,
round(least(1, greatest(0, CASE WHEN a THEN CASE WHEN k > 3 THEN least(r, .6) ELSE r END WHEN k = 1 THEN 1 ELSE .4 END)), 6) AS citation, round(.6::DOUBLE * a::INT + .2::DOUBLE * b::INT + .1::DOUBLE * (k > 2)::INT + .1::DOUBLE * (k > 4)::INT, 6) AS behaviour
FROM (SELECT l_orderkey, l_linenumber, {_PARTS})""")
def reward_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(e) for e in _PARTS.removesuffix(" FROM lineitem").split(", ")))
    c = F.col
    return rows.select("l_orderkey", "l_linenumber", F.round(metrics.retrieval_score(c("r"), c("m"), c("d"), F.lit(1.0), c("b")), 6).alias("retrieval"), F.round(metrics.citation_score(c("a"), c("r"), F.when(c("k") > 3, 1).otherwise(0), c("k") - 1), 6).alias("citation"), F.round(metrics.behaviour_score(c("a"), c("b"), c("k") > 2, c("k") > 4), 6).alias("behaviour"))


# --- identifiers on mixed separators (9.6, 10.1) ---------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, 'SOP' || n || ' SOP-' || n || ' SOP ' || n || ' AB' || m || ' AB-' || m || ' AB ' || m AS variants FROM (SELECT p_partkey, '20' || p_size || p_partkey AS n, p_size || 'X' AS m FROM part)""")
def identifier_variants_mixed(spark, sf_dir):
    text = F.concat(F.lit("看 SOP 20"), "p_size", F.lit("-"), "p_partkey", F.lit("，ab_"), "p_size", F.lit("__x rev or no code"))
    return table(spark, sf_dir, "part").select("p_partkey", T.identifier_variants(text).alias("variants"))


@query("""SELECT p_partkey, 'E0' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS alarm, 'SOP-' || p_partkey AS sop, 'AB-' || p_size AS part FROM part""")
def identifier_extract(spark, sf_dir):
    text = F.concat(F.lit("报警 e-0"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("，SOP "), "p_partkey", F.lit("；PART NUMBER: ab-"), "p_size", F.lit(" 怎么办"))
    ids = T.extract_identifiers(text)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.array_join(ids[k], ",").alias(c) for k, c in (("alarm_code", "alarm"), ("sop_code", "sop"), ("part_number", "part"))))


# --- lifecycle and curation (13.x, 15.x) -----------------------------------------------------------------------------------------------------
@query("""SELECT user_id, CASE f WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS state, steps FROM (SELECT user_id, count(*) AS steps, min_by(event_type, event_id) FILTER (event_type IN ('error', 'purchase')) AS f FROM events GROUP BY 1)""")
def task_progress(spark, sf_dir):
    return lifecycle.progress(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type")


@query("""SELECT p_partkey, p_size + CASE WHEN p_partkey % 3 = 0 AND p_size = 1 + p_partkey % 50 THEN 1 ELSE 0 END AS new_version, CASE WHEN p_partkey % 3 <> 0 THEN 'untouched' WHEN p_size = 1 + p_partkey % 50 THEN 'rebuilt' ELSE 'conflict' END AS outcome FROM part""")
def version_rebuild(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return lifecycle.rebuilt(part, "p_partkey", "p_size", part.where("p_partkey % 3 = 0").select("p_partkey", (1 + F.col("p_partkey") % 50).alias("expected_version")))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'changed' END, CASE WHEN NOT contains(coalesce(text, ''), ' the ') THEN 'phrase_missing' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def content_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    frozen = docs.select("doc_id", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")), 256).alias("content_sha256"))
    return lifecycle.drift(docs, frozen, "doc_id", "text", [" the "])


@query("""SELECT p_partkey, o AS old_value, n AS new_value, CASE WHEN o IS NULL THEN 'write' ELSE 'refuse' END AS action FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS o, CASE WHEN p_size > 40 THEN p_size ELSE 7 END AS n FROM part) WHERE o IS NULL OR o <> n""")
def backfill_plan(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return lifecycle.backfill_plan(part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("v")), part.select("p_partkey", F.when(F.col("p_size") > 40, F.col("p_size")).otherwise(7).alias("v")), "p_partkey", "v")


@query("SELECT c_mktsegment, count(*) AS n_rows, count(DISTINCT c_nationkey) AS n_groups, count(*) >= 25 AND count(DISTINCT c_nationkey) >= 20 AS enough FROM customer GROUP BY 1")
def inventory_minimums(spark, sf_dir):
    return lifecycle.minimums(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", 25, 20)


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
SELECT user_id, min(ts) AS began, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n")
