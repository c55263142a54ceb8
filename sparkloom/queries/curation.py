"""Curation: levels, dialogs, deduplication, validation, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.answers import canonical_json, choice_letter
from sparkloom.functions.hashing import options_with_answer, order_key, stable_id
from sparkloom.functions.text import camel_to_words, classify_keywords, collapse_spaces, normalize_name, portable_path, unsafe_path, word_count
from sparkloom.operators import aggregate, normalize, select, setops, validate
from sparkloom.operators.joins import contains_longest
from sparkloom.plans.curation import LEVELS, curate
from sparkloom.queries import query, table

TASKS = ["en", "fr", "src1", "src12", "src12_de", "src3_en", "src"]


@query("""
SELECT CASE WHEN n_chars > 20000 THEN 'l3' WHEN lang = 'en' THEN 'l1' WHEN lang IN ('de','fr') THEN 'l2' WHEN lang = 'es' THEN 'l3' END AS level, lang, count(*) AS n
FROM documents GROUP BY ALL""")
def curriculum_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = F.when(F.col("n_chars") > 20000, "l3")
    level = normalize.curriculum_level(explicit, F.col("lang"), LEVELS)
    return table(spark, sf_dir, "documents").select(level.alias("level"), "lang").groupBy("level", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t(task) AS (VALUES ('en'),('fr'),('src1'),('src12'),('src12_de'),('src3_en'),('src')),
d AS (SELECT doc_id, lower(source || '_' || lang) AS id FROM documents)
SELECT d.doc_id, t.task FROM d JOIN t ON contains(d.id, t.task) QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY length(t.task) DESC, t.task DESC) = 1""")
def task_infer_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "source", "lang").alias("id"))
    names = spark.createDataFrame([(t,) for t in TASKS], "task string")
    return contains_longest(docs, "id", names, "task", "doc_id").where("task is not null").select("doc_id", "task")


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x__class0' || (1 + doc_id % 4) || '__y' WHEN 1 THEN 'qa_SRC12_de_' || doc_id ELSE 'plain_' || doc_id END AS id FROM documents)
SELECT doc_id, CASE WHEN contains(lower(id), 'src12_de') THEN 'src12_de' WHEN regexp_extract(id, '__class(\\d\\d)__', 1) = '01' THEN 'one' WHEN regexp_extract(id, '__class(\\d\\d)__', 1) = '02' THEN 'two' ELSE '' END AS task FROM d""")
def task_infer_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    row_id = F.when(i % 3 == 0, F.concat(F.lit("x__class0"), (1 + i % 4).cast("string"), F.lit("__y"))).when(i % 3 == 1, F.concat(F.lit("qa_SRC12_de_"), i.cast("string"))).otherwise(F.concat(F.lit("plain_"), i.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", normalize.infer_task(row_id, ["src12", "src12_de"], {1: "one", 2: "two"}).alias("task"))


@query("""
WITH t AS (SELECT conv_id, turn, CASE lower(role) WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE lower(role) END AS r, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, count(*) FILTER (WHERE r IN ('human','gpt','system')) AS n_turns, coalesce(string_agg(r, ',' ORDER BY turn) FILTER (WHERE r IN ('human','gpt','system')), '') AS roles,
 md5(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE r IN ('human','gpt','system')), '')) AS digest,
 coalesce(bool_or(r = 'human'), false) AND coalesce(bool_or(r = 'gpt'), false) AS valid
FROM t GROUP BY conv_id""")
def conversation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = normalize.collect_turns(table(spark, sf_dir, "conversations")).withColumn("turns", F.filter("turns", lambda t: t["from"].isin(*normalize.KNOWN_ROLES) & t["value"].isNotNull()))
    roles, texts = F.transform("turns", lambda t: t["from"]), F.transform("turns", lambda t: t["value"])
    return convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(roles, ",").alias("roles"), F.md5(F.array_join(texts, "|").cast("binary")).alias("digest"), normalize.has_both_roles(F.col("turns")).alias("valid"))


@query("""
WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system')
SELECT conv_id, max(n) % 2 = 0 AND bool_and(role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END) AS ok FROM t GROUP BY conv_id""")
def dialog_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = normalize.collect_turns(table(spark, sf_dir, "conversations").where("role <> 'system'"))
    return convs.select("conv_id", validate.alternation_ok(F.transform("turns", lambda t: t["from"])).alias("ok"))


@query("""
WITH t AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, v AS violation FROM t, LATERAL (SELECT unnest([CASE WHEN n < 2 THEN 'too_few_turns' END, CASE WHEN u = 0 THEN 'no_human' END, CASE WHEN a = 0 THEN 'no_gpt' END]) AS v) x WHERE v IS NOT NULL""")
def sft_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = normalize.collect_turns(table(spark, sf_dir, "conversations"))
    return validate.violations(convs, "conv_id", validate.sft_checks(F.col("turns")))


@query("""
WITH a AS (SELECT 'd' || (doc_id % 700) AS id, 'documents' AS source, 0 AS o, doc_id AS k FROM documents), b AS (SELECT 'd' || page_id AS id, 'pages' AS source, 1 AS o, page_id AS k FROM pages),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT CASE WHEN o = min(o) OVER (PARTITION BY id) THEN id ELSE source || ':' || id END AS id, source, k FROM u""")
def mixture_union_dedup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 700).cast("string")).alias("id"), F.col("doc_id").alias("k"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("id"), F.col("page_id").alias("k"))
    return setops.union_sources({"documents": docs, "pages": pages})


@query("""
SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))
    return select.first_by(docs, ["digest"], ["doc_id"])


@query("""
SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) = 1""")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return select.last_by(docs, ["digest"], ["doc_id"])


@query("""
WITH s AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_retailprice DESC, p_partkey) = 1)
SELECT p_partkey, p_brand, p_type, p_size, (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey))::INTEGER AS rank FROM s QUALIFY rank <= 5""")
def best_per_signature_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return select.best_per_signature(part, ["p_brand", "p_type", "p_size"], ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).drop("p_retailprice")


@query("""
SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey))::INTEGER AS rank FROM lineitem QUALIFY rank <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return select.top_k(items, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3)


@query("""
WITH j AS (SELECT d.source, CASE WHEN l.toxic = 1 THEN 'delete' WHEN l.quality = 1 THEN 'keep' ELSE 'review' END AS decision FROM documents d JOIN labels l USING (doc_id))
SELECT source, count(*) FILTER (WHERE decision = 'keep') AS n_keep, count(*) FILTER (WHERE decision = 'review') AS n_review, count(*) FILTER (WHERE decision = 'delete') AS n_delete, count(*) AS n_total,
 round(count(*) FILTER (WHERE decision = 'keep') / count(*)::DOUBLE, 6) AS keep_ratio FROM j GROUP BY source""")
def decision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    decided = joined.withColumn("decision", F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "keep").otherwise("review"))
    return aggregate.decision_counts(decided, "source", "decision", ["keep", "review", "delete"]).withColumn("keep_ratio", F.round("keep_ratio", 6))


@query("""
WITH r AS (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN contains(text, '###') THEN 'markup' ELSE 'kept' END AS reason FROM documents)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def drop_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("empty", F.col("text").isNull() | (F.trim("text") == "")), ("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 20000), ("markup", F.contains("text", F.lit("###")))]
    return aggregate.reason_histogram(table(spark, sf_dir, "documents").withColumn("reason", validate.first_reason(checks)), "reason")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount >= 0.09 THEN 'discount' END, CASE WHEN l_tax >= 0.07 THEN 'tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_filter(f, lambda x: x IN ('large','returned'))), ',') AS hard, array_to_string(list_sort(list_filter(f, lambda x: x NOT IN ('large','returned'))), ',') AS soft FROM r WHERE len(f) > 0""")
def multi_reason_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("large", F.col("l_quantity") > 45), ("discount", F.col("l_discount") >= 0.09), ("tax", F.col("l_tax") >= 0.07), ("returned", F.col("l_returnflag") == "R")]
    rows = table(spark, sf_dir, "lineitem").withColumn("f", validate.all_reasons(checks)).where(F.size("f") > 0).withColumn("s", validate.split_reasons(F.col("f"), ["large", "returned"]))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("s.hard", ",").alias("hard"), F.array_join("s.soft", ",").alias("soft"))


PRIVATE_SQL = r"(/(?:home|root|mnt|data|Users|workspace)/|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bsk-[A-Za-z0-9]{16,}|\bhf_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16})"


@query(f"""
SELECT doc_id FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 10 WHEN 0 THEN ' /home/u/x' WHEN 1 THEN ' sk-abcdefghijklmnop0' WHEN 2 THEN ' -----BEGIN RSA PRIVATE KEY-----' ELSE '' END AS t FROM documents) WHERE regexp_matches(t, '{PRIVATE_SQL}')""")
def private_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.functions.text import is_private

    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 10 == 0, " /home/u/x").when(F.col("doc_id") % 10 == 1, " sk-abcdefghijklmnop0").when(F.col("doc_id") % 10 == 2, " -----BEGIN RSA PRIVATE KEY-----").otherwise("")).alias("text"))
    return texts.where(is_private(F.col("text"))).select("doc_id")


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)
SELECT page_id, starts_with(path, '/') OR list_contains(string_split(path, '/'), '..') AS unsafe, CASE WHEN starts_with(path, '/en/') THEN substr(path, 5) ELSE path END AS portable FROM p""")
def media_path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^https?://[^/]*", "")
    return table(spark, sf_dir, "pages").withColumn("path", path).select("page_id", unsafe_path(F.col("path")).alias("unsafe"), portable_path(F.col("path"), "/en").alias("portable"))


@query("""
WITH n AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM n),
b AS (SELECT stratum, n, least(n, floor(100 * n / total::DOUBLE))::BIGINT AS base, 100 * n / total::DOUBLE - least(n, floor(100 * n / total::DOUBLE)) AS deficit FROM n, t),
q AS (SELECT stratum, least(n, base + CASE WHEN row_number() OVER (ORDER BY base >= n, deficit DESC, stratum) <= 100 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END) AS quota FROM b)
SELECT d.doc_id, d.lang FROM documents d JOIN q ON d.lang = q.stratum QUALIFY row_number() OVER (PARTITION BY d.lang ORDER BY sha1('9:' || d.doc_id), d.doc_id) <= any_value(q.quota) OVER (PARTITION BY d.lang)""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return select.stratified_sample(docs, "lang", "doc_id", 100, 9).select("doc_id", "lang")


@query("""
SELECT source, lang, CASE WHEN concat('0x', substr(sha1('11:' || source || '/' || (doc_id // 10)), 1, 12))::BIGINT / 281474976710656.0 < 0.2 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL""")
def hash_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 10).cast("string"))
    return select.hash_split(table(spark, sf_dir, "documents"), key, 11, 0.2).groupBy("source", "lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT source, CASE WHEN concat('0x', substr(sha1('3:' || doc_id), 1, 12))::BIGINT / 281474976710656.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT source, count(DISTINCT split) AS splits FROM s GROUP BY source HAVING count(DISTINCT split) > 1""")
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.functions.hashing import split_name

    return validate.split_leaks(table(spark, sf_dir, "documents").withColumn("split", split_name(F.col("doc_id"), 3, 0.1)), "split", "source")


@query("""
SELECT 'lang' AS side, lang AS value, count(DISTINCT source) AS n FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1
UNION ALL SELECT 'source', source, count(DISTINCT lang) FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")
def mapping_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.mapping_breaks(table(spark, sf_dir, "documents"), "lang", "source")


@query("""
SELECT CASE WHEN grouping(lang) = 0 AND grouping(source) = 0 THEN 'lang:source' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS grain, lang, source, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), (source), ())""")
def release_summary_gsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.multi_grain_counts(table(spark, sf_dir, "documents").select("lang", "source"), [["lang"], ["lang", "source"], ["source"], []])


@query("""
WITH a AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), e(k, n) AS (VALUES (0, 5), (1, 4), (2, 5), (7, 1))
SELECT coalesce(a.k, e.k)::INTEGER AS k, a.n AS actual, e.n::BIGINT AS expected FROM a FULL JOIN e ON a.k = e.k WHERE a.n IS DISTINCT FROM e.n""")
def paper_count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    expected = spark.createDataFrame([(0, 5), (1, 4), (2, 5), (7, 1)], "k int, n long")
    return validate.expected_counts(actual, expected, "k")


@query("""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no, ((row_number() OVER (ORDER BY doc_id) - 1) % 4) AS shard FROM documents""")
def modulo_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.modulo_shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 4)


@query("""
SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total_before FROM documents""")
def running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.running_total(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), ["doc_id"])


@query()
def size_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return select.size_shards(docs, F.col("n_chars"), 60_000, ["doc_id"], group=["source"])


@query("""
SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey))::INTEGER AS turn_no FROM orders ORDER BY turn_no, o_orderpriority LIMIT 500""")
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.round_robin(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", [F.col("o_orderkey")], 500)


@query("""
WITH u AS (SELECT 'p' AS source, p_partkey AS k, row_number() OVER (ORDER BY p_partkey) / 0.7::DOUBLE AS place FROM part UNION ALL SELECT 's', s_suppkey, row_number() OVER (ORDER BY s_suppkey) / 0.3::DOUBLE FROM supplier),
c AS (SELECT min(e) AS cut FROM (SELECT max(place) AS e FROM u GROUP BY source))
SELECT source, k, round(place, 6) AS place FROM u, c WHERE place <= cut""")
def interleave_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return setops.interleave({"p": part, "s": supplier}, {"p": 0.7, "s": 0.3}, [F.col("k")]).withColumn("place", F.round("place", 6))


@query("""
SELECT n_nationkey, c.i::INTEGER AS copy_no FROM nation, (SELECT unnest(range(0, 3)) AS i) c""")
def repeat_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.repeat_rows(table(spark, sf_dir, "nation").select("n_nationkey"), 3, "n_nationkey")


@query("""
WITH o AS (SELECT n_nationkey, row_number() OVER (ORDER BY sha1('5:' || n_nationkey), n_nationkey) - 1 AS i, count(*) OVER () AS total FROM nation),
d AS (SELECT floor(concat('0x', substr(sha1('5:draw:' || j), 1, 12))::BIGINT / 281474976710656.0 * (SELECT any_value(total) FROM o))::BIGINT AS i FROM range((SELECT count(*) FROM nation), 60) AS r(j))
SELECT n_nationkey, 1 AS copy_no FROM o UNION ALL SELECT n_nationkey, (1 + row_number() OVER (PARTITION BY n_nationkey))::INTEGER FROM d JOIN o USING (i)""")
def resample_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.resample(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 60, 5)


@query("""
WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)
SELECT n_nationkey, false AS padded FROM r UNION ALL SELECT n_nationkey, true FROM r WHERE i <= (8 - (SELECT count(*) FROM nation) % 8) % 8""")
def pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.pad_to_multiple(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 8)


@query("""
SELECT p_partkey, (ntile(6) OVER (ORDER BY p_partkey) - 1)::INTEGER AS chunk FROM part""")
def chunk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.chunks(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 6)


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'only_first', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    sets = setops.key_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return reduce(lambda a, b: a.union(b), [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, df in sets.items()])


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, count(*) AS n_refs FROM orders GROUP BY o_custkey""")
def manifest_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.collapse_references(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus"])
    return out.select("o_custkey", F.array_join("o_orderpriority_set", ",").alias("priorities"), F.array_join("o_orderstatus_set", ",").alias("statuses"), "n_refs")


@query("""
WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS v FROM orders GROUP BY 1) SELECT x AS value, count(*) AS "count" FROM (SELECT unnest(v) AS x FROM s) GROUP BY x""")
def membership_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.membership_counts(aggregate.collapse_references(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderpriority"]), "o_orderpriority_set")


@query("""
SELECT 'null_text' AS violation, count(*) AS n FROM documents WHERE text IS NULL HAVING count(*) > 0
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'label_without_document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) HAVING count(*) > 0
UNION ALL SELECT 'toxic_but_good', count(*) FROM labels WHERE toxic = 1 AND quality = 1 HAVING count(*) > 0
UNION ALL SELECT 'repeated_text', count(*) FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""")
def preflight_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = {
        "null_text": docs.where("text is null"),
        "duplicate_id": validate.duplicate_ids(docs, "doc_id"),
        "label_without_document": labels.join(docs, "doc_id", "left_anti"),
        "toxic_but_good": labels.where("toxic = 1 and quality = 1"),
        "repeated_text": validate.duplicate_ids(docs.select(F.md5(F.col("text").cast("binary")).alias("h")), "h"),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("violation"), "n") for k, df in found.items()]
    return reduce(lambda a, b: a.union(b), rows).where("n > 0")


@query(r"""
SELECT doc_id, upper(list_last(regexp_extract_all(t, '(?i)(?:answer|option|choice)\s*(?:is|:|=)\s*([A-E])\b', 1))) AS letter
FROM (SELECT doc_id, 'Answer: ' || substr('ABCDE', 1 + (doc_id % 5)::INTEGER, 1) || ' then ' || coalesce(text, '') || ' option = ' || substr('abcdexyz', 1 + (doc_id % 8)::INTEGER, 1) AS t FROM documents)""")
def choice_letter_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    t = F.concat(F.lit("Answer: "), F.substring(F.lit("ABCDE"), 1 + i % 5, F.lit(1)), F.lit(" then "), F.coalesce("text", F.lit("")), F.lit(" option = "), F.substring(F.lit("abcdexyz"), 1 + i % 8, F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", choice_letter(t).alias("letter"))


@query(r"""
SELECT p_partkey, lower(trim(regexp_replace(trim(regexp_replace(replace(p_name || '_' || CASE p_partkey % 3 WHEN 0 THEN 'II' WHEN 1 THEN 'xi' ELSE 'IV' END, '_', ' '), '\s+', ' ', 'g')), '(?i)[ _]+(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)$', ''))) AS name,
 regexp_replace('pad' || upper(left(p_name, 1)) || substr(p_name, 2), '([a-z0-9])([A-Z])', '\1 \2', 'g') AS words FROM part""")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    named = F.concat(F.col("p_name"), F.lit("_"), F.when(i % 3 == 0, "II").when(i % 3 == 1, "xi").otherwise("IV"))
    camel = F.concat(F.lit("pad"), F.upper(F.left("p_name", F.lit(1))), F.col("p_name").substr(F.lit(2), F.length("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", normalize_name(named).alias("name"), camel_to_words(camel).alias("words"))


@query(r"""
SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::INTEGER AS words, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("words"), F.md5(collapse_spaces(F.col("text")).cast("binary")).alias("digest"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'license|rights') THEN 'legal' WHEN regexp_matches(lower(text), 'password|token') THEN 'secret' ELSE 'other' END AS label FROM documents""")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify_keywords(F.col("text"), [("legal", ["license", "rights"]), ("secret", ["password", "token"])], "other").alias("label"))


@query("""
WITH o AS (SELECT p_partkey, p_name, p_brand, p_type, list_distinct([p_name, p_brand, p_type, 'none']) AS u FROM part),
s AS (SELECT p_partkey, p_name, list_transform(list_sort(list_transform(u, lambda x: md5(p_partkey || ':' || x) || '|' || x)), lambda y: substr(y, 34)) AS opts FROM o)
SELECT p_partkey, array_to_string(opts, '|') AS options, substr('ABCDEFGH', list_position(opts, p_name)::INTEGER, 1) AS answer FROM s""")
def stable_option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = options_with_answer(F.col("p_name"), F.array("p_brand", "p_type", F.lit("none")), F.col("p_partkey"))
    return table(spark, sf_dir, "part").withColumn("o", made).select("p_partkey", F.array_join("o.options", "|").alias("options"), F.col("o.answer").alias("answer"))


@query("""
SELECT doc_id, sha1(source || '/' || lang) AS id, row_number() OVER (ORDER BY sha1('42:' || doc_id), doc_id) AS place FROM documents""")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", stable_id(F.concat_ws("/", "source", "lang")).alias("id"), order_key(42, F.col("doc_id")).alias("order_"))
    placed = select.global_row_number(docs, ["order_", "doc_id"])
    return placed.select("doc_id", "id", (F.col("row_no") + 1).cast("long").alias("place"))


@query("""
SELECT event_id, '{"k":' || json_extract(props, '$.k')::VARCHAR || '}' AS canonical FROM events""")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", canonical_json(F.col("props")).alias("canonical"))


@query()
def diversity_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return select.diversity_greedy(part, ["p_brand"], ["p_type", "p_size"], "p_size", "p_partkey", 10)


@query()
def capped_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return select.grouped_greedy(orders, ["o_orderstatus"], ["o_totalprice", "o_orderkey"], select.pick_capped("o_custkey", "o_orderpriority", 40, 150))


@query("""
WITH q AS (SELECT * FROM part), r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM q),
c AS (SELECT p_partkey, p_type, i, CASE WHEN i > CASE p_type WHEN 'ECONOMY' THEN 20 WHEN 'SMALL' THEN 5 ELSE 0 END THEN 1 ELSE 0 END AS late FROM r)
SELECT p_partkey, p_type FROM c ORDER BY late, p_partkey LIMIT 40""")
def capped_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return select.capped_with_backfill(part, "p_type", [F.col("p_partkey")], {"ECONOMY": 20, "SMALL": 5}, 40, "p_partkey")


@query("""
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT count(*) AS k FROM n), q AS (SELECT lang, n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM n),
g AS (SELECT lang, n, i, unnest(range(1, n + 1)) AS round FROM q), p AS (SELECT lang, row_number() OVER (ORDER BY round, i) AS taken FROM g), w AS (SELECT lang, count(*) AS quota FROM p WHERE taken <= 400 GROUP BY 1)
SELECT d.doc_id, d.lang FROM documents d JOIN w ON d.lang IS NOT DISTINCT FROM w.lang QUALIFY row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) <= any_value(w.quota) OVER (PARTITION BY d.lang)""")
def balanced_quota_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.capped_balanced(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 400)


CURATION_SQL = """
WITH d AS (SELECT doc_id, lang, source, n_chars, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest, CASE WHEN n_chars > 20000 THEN 'l3' WHEN lang = 'en' THEN 'l1' WHEN lang IN ('de','fr') THEN 'l2' WHEN lang = 'es' THEN 'l3' END AS level FROM documents WHERE text IS NOT NULL),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1),
k AS (SELECT u.* FROM u LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.toxic = 1, false) AND n_chars >= 100),
n AS (SELECT level, count(*) AS n FROM k GROUP BY 1), m AS (SELECT sum(n) AS total FROM n), z AS (SELECT (total // 2)::BIGINT AS lim, total FROM m),
b AS (SELECT level, n, lim, least(n, floor(lim * n / total::DOUBLE))::BIGINT AS base, lim * n / total::DOUBLE - least(n, floor(lim * n / total::DOUBLE)) AS deficit FROM n, z),
q AS (SELECT level, least(n, base + CASE WHEN row_number() OVER (ORDER BY base >= n, deficit DESC, level) <= lim - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END) AS quota FROM b),
s AS (SELECT k.*, row_number() OVER (PARTITION BY k.level ORDER BY sha1('20:' || k.doc_id), k.doc_id) AS i, q.quota FROM k JOIN q USING (level)),
p AS (SELECT level, lang, CASE WHEN concat('0x', substr(sha1('20:' || source || ':' || doc_id), 1, 12))::BIGINT / 281474976710656.0 < 0.05 THEN 'val' ELSE 'train' END AS split FROM s WHERE i <= quota)
SELECT CASE WHEN grouping(lang) = 0 THEN 'level:split:lang' ELSE 'level:split' END AS grain, level, split, lang, count(*) AS n FROM p GROUP BY GROUPING SETS ((level, split), (level, split, lang))
"""


@query(CURATION_SQL)
def curation_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
