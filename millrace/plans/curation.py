"""Further queries: evidence filters, reports, evaluation slices, and tables that are written and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import graph, splits
from millrace.operators import relational as R
from millrace.plans.catalog import _BEST, _IMAGES, QUERIES, _fraction, _pred, _t, images, query
from millrace.sources.tables import Table
from millrace.storage import measured_broadcasts, release, shared_dir, staged

ON = "1997-06-15"


@query("SELECT doc_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars > 0")
def f6_complete(spark, d):
    """Rows whose coordinates (here source, lang, size) are all there."""
    return _t(spark, d, "documents").dropna(subset=["source", "lang"]).where("n_chars > 0").select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def f7_raw_predicate(spark, d):
    return _t(spark, d, "orders").where(F.expr("o_totalprice > 100000 AND o_orderstatus = 'F'")).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def f8_keyset(spark, d):
    """A page by key: the feature is the limit."""
    return _t(spark, d, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 90 END AS z FROM orders)
    WHERE a <= DATE '{ON}' AND DATE '{ON}' <= coalesce(z, DATE '9999-12-31')"""
)
def f10_currently_valid(spark, d):
    """Orders as rules that hold for 90 days; every third has no end."""
    a = F.to_date("o_orderdate")
    return _t(spark, d, "orders").where(R.currently_valid(F.lit(ON).cast("date"), a, F.when(F.col("o_orderkey") % 3 != 0, F.date_add(a, 90)))).select("o_orderkey")


@query(
    f"""SELECT o_orderkey, days, days >= 180 AS stale FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 10000
    ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '{ON}') END::INTEGER AS days FROM orders)"""
)
def f11_staleness(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    days = R.staleness_days(F.lit(ON).cast("date"), text)
    return _t(spark, d, "orders").select("o_orderkey", days.alias("days"), (days >= 180).alias("stale"))


@query("SELECT vec_id FROM embeddings WHERE label BETWEEN 0 AND 6")
def f15_class_bounds(spark, d):
    return _t(spark, d, "embeddings").where(F.col("label").between(0, 6)).select("vec_id")


@query("SELECT p_partkey, w AS word FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w NOT IN ('PROMO', 'BRASS')")
def f16_excluded_items(spark, d):
    """Items of a list that remain when excluded kinds go."""
    words = _t(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))
    return words.where(~F.col("word").isin("PROMO", "BRASS"))


@query(
    """SELECT mode, count(*) AS n FROM (SELECT unnest([CASE WHEN text IS NOT NULL AND n_chars >= 200 AND lang = 'en' THEN 'strict' END, CASE WHEN text IS NOT NULL THEN 'soft' END]) AS mode FROM documents)
    WHERE mode IS NOT NULL GROUP BY 1"""
)
def f17_evidence_modes(spark, d):
    strict = F.col("text").isNotNull() & (F.col("n_chars") >= 200) & (F.col("lang") == "en")
    modes = F.array_compact(F.array(F.when(strict, "strict"), F.when(F.col("text").isNotNull(), "soft")))
    return _t(spark, d, "documents").select(F.explode(modes).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def j7_quarantine(spark, d):
    """Rows without an entry under one version of a list."""
    held = _t(spark, d, "labels").where("quality = 0").select("doc_id")
    return _t(spark, d, "documents").join(held, "doc_id", "left_anti").select("doc_id")


@query(
    """WITH r AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END FROM orders WHERE o_totalprice > 450000)
    SELECT 'with null' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT k FROM r)
    UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM r WHERE k IS NOT NULL)
    UNION ALL SELECT 'empty', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM r WHERE k < 0)"""
)
def j8_null_aware(spark, d):
    """NOT IN over a list with a null, without, and an empty one."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    odd = o.where("o_totalprice > 450000").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("k"))
    r = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).unionByName(odd)
    out = None
    for kind, side in (("with null", r), ("without", r.where("k is not null")), ("empty", r.where("k < 0"))):
        one = R.not_in(c, "c_custkey", side, "k").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j9_in_select(spark, d):
    o = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query(
    """SELECT t.n AS taxon, s_suppkey % 10 AS cell, count(*) AS n FROM (SELECT DISTINCT c_nationkey AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F') t
    JOIN supplier ON s_nationkey = t.n GROUP BY 1, 2"""
)
def j15_by_taxon(spark, d):
    """All observations of the classes of some images, not only those with an image."""
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders").where("o_orderstatus = 'F'")
    taxa = c.join(o, c["c_custkey"] == o["o_custkey"]).select(F.col("c_nationkey").alias("taxon")).distinct()
    s = _t(spark, d, "supplier")
    return taxa.join(s, taxa["taxon"] == s["s_nationkey"]).groupBy("taxon", (F.col("s_suppkey") % 10).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


_RULES = [("p_name", "small ring", "size", 30), ("p_brand", "Brand#2", "size", 25), ("p_type", "PROMO", "bag", 5), ("universal", "*", "bag", 9), ("universal", "*", "size", 10)]


@query(
    f"""WITH r(rank, value, kind, amount) AS (VALUES {", ".join(map(str, _RULES))}),
    l AS (SELECT p_partkey, 0 AS o, 'p_name' AS rank, p_name AS value FROM part UNION ALL SELECT p_partkey, 1, 'p_brand', p_brand FROM part
          UNION ALL SELECT p_partkey, 2, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 3, 'universal', '*' FROM part)
    SELECT p_partkey, kind, rank, amount FROM l JOIN r USING (rank, value) QUALIFY row_number() OVER (PARTITION BY p_partkey, kind ORDER BY o) = 1"""
)
def j20_universal_rule(spark, d):
    """The most specific rule of each kind, down to those that hold for all."""
    rules = spark.createDataFrame(_RULES, "rank string, value string, kind string, amount int")
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return R.latest_rule(p, rules, ["p_name", "p_brand", "p_type"]).select("p_partkey", "kind", "rank", "amount")


@query(f"SELECT vec_id, pred, source, n_chars FROM {_BEST} JOIN documents ON doc_id = vec_id")
def j24_by_row_index(spark, d):
    """Predictions meet their manifest by the row index they carry, in whatever order they come."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    return _pred(spark, d).select("vec_id", F.col("pred").cast("long").alias("pred")).join(docs, "vec_id")


@query("SELECT o_custkey, any_value(c_name) AS name, any_value(c_nationkey) AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a7_dependent_values(spark, d):
    """Columns that depend on the key, by min: the same on every run."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy("o_custkey").agg(F.min("c_name").alias("name"), F.min("c_nationkey").alias("nation"), F.count(F.lit(1)).alias("n"))


_TIER = "CASE WHEN c_acctbal >= 6000 THEN 'A' WHEN c_acctbal >= 3000 THEN 'B' WHEN c_acctbal >= 0 THEN 'C' ELSE 'none' END"


@query(f"SELECT {_TIER} AS tier, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def a11_tier_sums(spark, d):
    c = _t(spark, d, "customer").withColumn("tier", F.expr(_TIER))
    return c.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(
    """SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, round(avg(value) FILTER (WHERE event_type = 'purchase'), 9) AS mean,
    count(*) FILTER (WHERE value IS NULL) AS missing FROM events"""
)
def a14_global_counts(spark, d):
    e = _t(spark, d, "events")
    return e.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"),
        F.round(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), 9).alias("mean"), F.count_if(F.col("value").isNull()).alias("missing"),
    )


@query("SELECT count(DISTINCT label) AS n, min(label) AS low, max(label) AS high, count(DISTINCT label) = max(label) - min(label) + 1 AS dense FROM embeddings")
def a16_density(spark, d):
    n, low, high = F.countDistinct("label"), F.min("label"), F.max("label")
    return _t(spark, d, "embeddings").agg(n.alias("n"), low.alias("low"), high.alias("high"), (n == high - low + 1).alias("dense"))


@query(
    f"""WITH b AS (SELECT *, vec_id % 13 AS observer, vec_id % 5 < 3 AS train FROM {_BEST}),
    s AS (SELECT *, observer IN (SELECT observer FROM b WHERE train AND observer % 4 <> 0) AS seen FROM b WHERE NOT train)
    SELECT seen, count(*) AS n, avg((label = pred)::INT::DOUBLE) AS accuracy FROM s GROUP BY 1"""
)
def a25_unseen_observers(spark, d):
    """Accuracy on observers that training has, and on others."""
    b = _pred(spark, d).withColumn("observer", F.col("vec_id") % 13).withColumn("train", F.col("vec_id") % 5 < 3)
    known = b.where("train and observer % 4 <> 0").select("observer").distinct().withColumn("seen", F.lit(True))
    s = b.where("not train").join(known, "observer", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return s.groupBy("seen").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


_AT = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    f"""WITH b AS (SELECT vec_id, label, pred, conf, list_sum([p[1], p[4], p[7], p[10]]) AS g0, list_sum([p[2], p[5], p[8]]) AS g1, list_sum([p[3], p[6], p[9]]) AS g2 FROM {_BEST}),
    g AS (SELECT *, greatest(g0, g1, g2) AS mass, CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS genus FROM b),
    a AS (SELECT t.threshold, CASE WHEN conf >= t.threshold THEN 'species' WHEN mass >= t.threshold THEN 'genus' ELSE 'silent' END AS said, label = pred AS s, label % 3 = genus AS k
          FROM g CROSS JOIN (SELECT unnest({_AT})::DOUBLE AS threshold) t)
    SELECT threshold, avg((said = 'species')::INT::DOUBLE) AS species, avg((said = 'genus')::INT::DOUBLE) AS genus, avg((said = 'silent')::INT::DOUBLE) AS silent,
    avg(((said = 'species' AND s) OR (said = 'genus' AND k))::INT::DOUBLE) AS useful, avg(((said = 'species' AND NOT s) OR (said = 'genus' AND NOT k))::INT::DOUBLE) AS wrong FROM a GROUP BY 1"""
)
def a27_fallback(spark, d):
    """What is said at each threshold: the class, else its genus (class modulo 3), else nothing; and how often that helps or misleads."""
    b = _pred(spark, d)

    def of_genus(k: int):
        return F.aggregate(F.filter("p", lambda _, i: i % 3 == k), F.lit(0.0), lambda x, y: x + y)

    mass = F.array(*[of_genus(k) for k in range(3)])
    b = b.withColumn("g", mass).withColumn("mass", F.array_max("g")).withColumn("genus", F.array_position("g", F.col("mass")) - 1)
    at = b.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in _AT])))
    said = F.when(F.col("conf") >= F.col("threshold"), "species").when(F.col("mass") >= F.col("threshold"), "genus").otherwise("silent")
    at = at.select("threshold", said.alias("said"), F.when(said == "species", F.col("correct")).when(said == "genus", F.col("label") % 3 == F.col("genus")).alias("right"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return at.groupBy("threshold").agg(
        *[share(F.col("said") == k).alias(k) for k in ("species", "genus", "silent")], share(F.col("right")).alias("useful"), share(~F.col("right")).alias("wrong")
    )


@query(
    f"""SELECT label AS kind, threshold, count(*) FILTER (WHERE conf < threshold) / count(*) AS rejected FROM {_BEST}
    CROSS JOIN (SELECT unnest([0.2, 0.35, 0.5, 0.65])::DOUBLE AS threshold) GROUP BY 1, 2"""
)
def a28_rejection_curve(spark, d):
    """Share of each kind of negative that each threshold turns away."""
    b = _pred(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.2, 0.35, 0.5, 0.65)])))
    return b.groupBy(F.col("label").alias("kind"), "threshold").agg((F.count_if(F.col("conf") < F.col("threshold")) / F.count(F.lit(1))).alias("rejected"))


@query(
    """SELECT user_id, first(value ORDER BY ts, event_id) FILTER (WHERE value > 50) AS first_value, len(list_distinct(list(event_type))) AS kinds FROM events GROUP BY 1"""
)
def a33_accumulate(spark, d):
    """The first value that is there, in time, and the distinct kinds of each key."""
    e = _t(spark, d, "events")
    first = F.min(F.when(F.col("value") > 50, F.struct("ts", "event_id", "value")))["value"]
    return e.groupBy("user_id").agg(first.alias("first_value"), F.size(F.collect_set("event_type")).cast("long").alias("kinds"))


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(CAST(c_custkey AS VARCHAR))) <= 3")
def w9_hash_sample(spark, d):
    return R.capped_per_key(_t(spark, d, "customer"), ["c_nationkey"], [F.sha2(F.col("c_custkey").cast("string"), 256)], 3).select("c_nationkey", "c_custkey")


@query(
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders"""
)
def t4_severity(spark, d):
    """Warnings of a class in order of severity, which is not the alphabet's."""
    from pyspark.sql.window import Window

    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return _t(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, "o_orderkey")).alias("place"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'user') DESC, length(text) > 100 DESC, turn) AS place FROM conversations")
def t5_flags_first(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy((F.col("role") == "user").desc(), (F.length("text") > 100).desc(), "turn")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"))


@query("SELECT n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey ORDER BY n, n_name")
def t9_thin_first(spark, d):
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select("n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy("n", "n_name")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents ORDER BY sha256('check' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def t11_integrity_sample(spark, d):
    """Twenty-five rows to check, the same on every run; the sample is the feature."""
    t = _t(spark, d, "documents").orderBy(F.sha2(F.concat(F.lit("check"), F.col("doc_id").cast("string")), 256), "doc_id").limit(25)
    return t.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query("SELECT l_orderkey, substr(s, 1, 2) || '/' || substr(s, 3, 2) || '/' || s AS place FROM (SELECT l_orderkey, sha256(CAST(min(l_partkey) AS VARCHAR)) AS s FROM lineitem GROUP BY 1) ORDER BY place")
def t14_disk_order(spark, d):
    """Reads in the order of the store's paths."""
    sha = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.min("l_partkey").cast("string"), 256).alias("s"))
    place = F.concat_ws("/", F.substring("s", 1, 2), F.substring("s", 3, 2), "s")
    return sha.select("l_orderkey", place.alias("place")).orderBy("place")


@query(f"SELECT label, avg((label = pred)::INT::DOUBLE) AS accuracy, count(*) AS n FROM {_BEST} GROUP BY 1 ORDER BY accuracy, label LIMIT 5")
def t15_worst(spark, d):
    p = _pred(spark, d).groupBy("label").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return p.orderBy("accuracy", "label").limit(5)


@query("SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark UNION SELECT vec_id FROM embeddings")
def u2_done_ids(spark, d):
    t = lambda n, c: _t(spark, d, n).select(F.col(c).alias("doc_id"))
    return t("labels", "doc_id").unionByName(t("benchmark", "item_id")).unionByName(t("embeddings", "vec_id")).distinct()


@query(
    """SELECT 'east' AS clade, c_custkey FROM customer WHERE c_nationkey IN (8, 9, 12) UNION ALL SELECT 'west', c_custkey FROM customer WHERE c_nationkey IN (1, 2, 24)
    UNION ALL SELECT 'rich', c_custkey FROM customer WHERE c_nationkey IN (1, 6, 7)"""
)
def u3_clades(spark, d):
    """One scan joined with the clades and their members, instead of a branch for each."""
    members = {"east": (8, 9, 12), "west": (1, 2, 24), "rich": (1, 6, 7)}
    clades = spark.createDataFrame([(k, n) for k, ns in members.items() for n in ns], "clade string, c_nationkey int")
    return _t(spark, d, "customer").join(F.broadcast(clades), "c_nationkey").select("clade", "c_custkey")


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 3 = 0 EXCEPT SELECT p_name FROM part WHERE p_partkey % 3 = 1")
def u5_unexpected(spark, d):
    p = _t(spark, d, "part")
    return p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name")).subtract(p.where("p_partkey % 3 = 1").select("p_name"))


@query("SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('s' || CAST(s_suppkey AS VARCHAR))) = 1")
def x10_hash_order(spark, d):
    return R.first_per_key(_t(spark, d, "supplier"), ["s_nationkey"], [F.sha2(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), 256)]).select("s_nationkey", "s_suppkey")


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '{ON}') AS days FROM orders")
def x28_days(spark, d):
    day = F.to_date("o_orderdate")
    return _t(spark, d, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), F.datediff(F.lit(ON).cast("date"), day).cast("long").alias("days"))


@query(
    """SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1000000) WHEN v >= 1000 THEN printf('%.1fk', v / 1000) ELSE printf('%.0f', v) END AS total
    FROM (SELECT o_orderkey, floor(o_totalprice / 100) * 100.0 AS v FROM orders)"""
)
def x33_human(spark, d):
    v = F.floor(F.col("o_totalprice") / 100) * F.lit(100.0)
    return _t(spark, d, "orders").select("o_orderkey", S.human(v).alias("total"))


@query(f"SELECT vec_id, CASE pred WHEN 1 THEN 0.2 WHEN 3 THEN 0.4 ELSE 0.3 END::DOUBLE AS threshold, conf < threshold AS rejected FROM {_BEST}")
def x34_threshold_map(spark, d):
    """A threshold of its own for some classes, looked up by the class index as text."""
    own = F.create_map(*[F.lit(x) for kv in {"1": 0.2, "3": 0.4}.items() for x in kv])
    t = F.coalesce(F.try_element_at(own, F.col("pred").cast("string")), F.lit(0.3))
    return _pred(spark, d).select("vec_id", t.alias("threshold"), (F.col("conf") < t).alias("rejected"))


@query("SELECT o_custkey, max(o_orderdate) AS scanned, max(o_orderkey % 100) AS cap, max(o_orderkey % 100) < 90 AS again FROM orders GROUP BY 1")
def g10_scan_state(spark, d):
    """The last scan of each key and its largest cap; a higher cap asks for another scan."""
    cap = F.max(F.col("o_orderkey") % 100)
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("scanned"), cap.alias("cap"), (cap < 90).alias("again"))


@query(
    f"""WITH i AS (SELECT DISTINCT l_partkey AS content, c_nationkey AS class, o_custkey AS observer, l_orderkey FROM {_IMAGES}),
    s AS (SELECT *, CASE WHEN {_fraction("v2:", "CAST(l_orderkey AS VARCHAR)")} < 0.8 THEN 'train' ELSE 'test' END AS split FROM i)
    SELECT CASE WHEN count(DISTINCT class) > 1 THEN 'cross-class' WHEN count(DISTINCT split) > 1 THEN 'cross-split' WHEN count(DISTINCT observer) > 1 THEN 'cross-observer' ELSE 'same' END AS kind,
    content, count(*) AS copies FROM s GROUP BY content HAVING count(*) > 1"""
)
def g11_duplicates(spark, d):
    """Groups of equal content by the gravest line they cross: class, split, observer, none. Copies are counted, not paired."""
    i = images(spark, d).select(F.col("l_partkey").alias("content"), F.col("c_nationkey").alias("class"), F.col("o_custkey").alias("observer"), "l_orderkey").distinct()
    split = F.when(S.stable_fraction(F.col("l_orderkey").cast("string"), "v2:") < 0.8, "train").otherwise("test")
    many = lambda c: F.countDistinct(c) > 1
    kind = F.when(many("class"), "cross-class").when(many("split"), "cross-split").when(many("observer"), "cross-observer").otherwise("same")
    return i.withColumn("split", split).groupBy("content").agg(kind.alias("kind"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(
    """WITH store AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha, length(coalesce(text, '')) AS n FROM documents WHERE doc_id % 17 <> 0),
    reg AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS sha, n_chars + (CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END) AS n FROM documents WHERE doc_id % 29 <> 0),
    j AS (SELECT s.doc_id AS a, r.doc_id AS b, s.sha AS x, r.sha AS y, s.n AS m, r.n AS n FROM store s FULL JOIN reg r USING (doc_id))
    SELECT CASE WHEN a IS NULL THEN 'missing' WHEN b IS NULL THEN 'orphan' WHEN m <> n THEN 'size' WHEN x <> y THEN 'hash' ELSE 'sound' END AS verdict, count(*) AS n FROM j GROUP BY 1"""
)
def g13_store_verdicts(spark, d):
    """A registry against what the store holds: missing, orphan, wrong size, wrong hash."""
    t = _t(spark, d, "documents")
    body = F.coalesce("text", F.lit(""))
    store = t.where("doc_id % 17 <> 0").select("doc_id", F.sha2(body, 256).alias("x"), F.char_length(body).alias("m"), F.lit(1).alias("s"))
    off = F.when(F.col("doc_id") % 23 == 0, 1).otherwise(0)
    reg = t.where("doc_id % 29 <> 0").select("doc_id", F.when(F.col("doc_id") % 19 == 0, "x").otherwise(F.sha2(body, 256)).alias("y"), (F.col("n_chars") + off).alias("k"), F.lit(1).alias("r"))
    j = store.join(reg, "doc_id", "full")
    verdict = F.when(F.col("s").isNull(), "missing").when(F.col("r").isNull(), "orphan").when(F.col("m") != F.col("k"), "size").when(F.col("x") != F.col("y"), "hash").otherwise("sound")
    return j.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest,
    (SELECT string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) q WHERE q.o_custkey = c_custkey) AS priorities, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def g20_detail(spark, d):
    """All details of every key in one pass a child table, instead of some queries for each key."""
    c, o, n = (_t(spark, d, x) for x in ("customer", "orders", "nation"))
    per = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("largest"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities")
    )
    j = c.join(per, c["c_custkey"] == per["o_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"), "largest", "priorities", F.col("n_name").alias("nation"))


def _table(spark: SparkSession, df: DataFrame) -> Table:
    """A fresh table in the shared folder that holds ``df``."""
    t = Table(spark, f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}", df.schema)
    t.commit(df, 0)
    return t


@query("SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, c_acctbal FROM customer")
def k3_replace(spark, d):
    """One column replaced, written and read back."""
    return staged(_t(spark, d, "customer").select("c_custkey", F.upper("c_mktsegment").alias("c_mktsegment"), "c_acctbal"), "k3")


@query("SELECT l_orderkey, min(l_partkey) AS part FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT l_orderkey, max(l_partkey) FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1")
def k4_idempotent_append(spark, d):
    """Two batches into one table, the second twice: keys that are there stay as they are."""
    li = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"))
    t = _table(spark, li.limit(0))
    t.insert_new(li.where("l_orderkey % 2 = 0"), ["l_orderkey"], [F.col("part")])
    for _ in range(2):
        t.insert_new(li, ["l_orderkey"], [F.desc("part")])
    return t.read()


@query("SELECT l_partkey, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1")
def k5_batch_insert(spark, d):
    """One batch with many rows a key: the first of each goes in."""
    li = _t(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("supplier"))
    t = _table(spark, li.limit(0))
    t.insert_new(li, ["l_partkey"], [F.col("supplier")])
    return t.read()


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 9.0 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer")
def k8_replace_by_key(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    t = _table(spark, c)
    for _ in range(2):
        t.replace_by_key(c.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.lit(9.0)), ["c_custkey"])
    return t.read()


@query("SELECT corpus, id FROM (SELECT 'a' AS corpus, s_suppkey AS id FROM supplier UNION ALL SELECT 'b', p_partkey * 2 FROM part)")
def k9_rebuild(spark, d):
    """The rows of one corpus go and come anew; those of the other stay."""
    a = _t(spark, d, "supplier").select(F.lit("a").alias("corpus"), F.col("s_suppkey").alias("id"))
    p = _t(spark, d, "part")
    t = _table(spark, a.unionByName(p.select(F.lit("b").alias("corpus"), F.col("p_partkey").alias("id"))))
    t.replace_by_key(p.select(F.lit("b").alias("corpus"), (F.col("p_partkey") * 2).alias("id")), ["corpus"])
    return t.read()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def k10_delete(spark, d):
    t = _table(spark, _t(spark, d, "orders").select("o_orderkey", "o_custkey"))
    t.delete_matching(_t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])
    return t.read()


@query("SELECT c_custkey, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'idle' ELSE c_mktsegment END AS segment FROM customer")
def k11_conditional_update(spark, d):
    t = _table(spark, _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")))
    t.update_where_absent(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], segment=F.lit("idle"))
    return t.read()


@query("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50) AS busy FROM supplier")
def k12_add_column(spark, d):
    t = _table(spark, _t(spark, d, "supplier").select("s_suppkey"))
    return t.with_flag(_t(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey")), ["s_suppkey"], "busy").read()


@query("SELECT event_id, event_type, value FROM events")
def z2_replayed_batches(spark, d):
    """A stream of two batches that overlap, the second replayed: every key is there once."""
    from millrace.streaming.incremental import append_stream

    e = _t(spark, d, "events").select("event_id", "event_type", "value")
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for k, part in enumerate((e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1"), e.where("event_id % 3 <> 1"))):
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        append_stream(source, f"{base}/out", ["event_id"], ["event_type", "value"], f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{base}/out")


@query(
    f"""WITH g AS (SELECT CAST(o_orderkey AS VARCHAR) AS g, CASE WHEN {_fraction("v2:", "CAST(o_orderkey AS VARCHAR)")} < 0.8 THEN 'train' ELSE 'test' END AS s FROM orders)
    SELECT count(*) AS n, sha256(string_agg(g || chr(0) || s || chr(10), '' ORDER BY g)) AS fingerprint FROM g"""
)
def a30_fingerprint(spark, d):
    """SHA-256 over all rows (group, split) in order of the group."""
    g = F.col("o_orderkey").cast("string")
    rows = _t(spark, d, "orders").select(g.alias("group_id"), F.when(S.stable_fraction(g, "v2:") < 0.8, "train").otherwise("test").alias("split"))
    return spark.createDataFrame([splits.fingerprint(rows)], "n long, fingerprint string")


def _of_nodes(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """``df``, whose column sha has numbers, with the contents that ``nodes`` (sha, node) numbers so."""
    return df.withColumnRenamed("sha", "node").join(nodes, "node").drop("node")


def assignment_batches(spark: SparkSession, links: DataFrame, batches: list) -> tuple[Table, Table, Table]:
    """(groups, members, quarantine) after the batches, conditions on ``links``, came in one by one.

    ``links`` has sha, taxon, observer and the columns observation and near.
    Components are built over all that has come in so far; what is persisted is
    only added to. Contents are numbered once in order of their sha, so rounds
    and groups are numbers, and sha stands in the persisted tables alone. Every
    step is written once, so no plan holds those before it.
    """
    kind = dict(links.dtypes)["taxon"]
    groups = _table(spark, spark.createDataFrame([], f"group_id string, taxon {kind}, split string, observers array<string>, assigned_at long"))
    members = _table(spark, spark.createDataFrame([], "sha string, group_id string"))
    held = _table(spark, spark.createDataFrame([], "sha string, reason string, detail string"))
    came = F.coalesce(*[F.when(b, k) for k, b in enumerate(batches)])
    with measured_broadcasts(spark):
        numbered = R.dense_ids(links.select("sha").where("sha IS NOT NULL"), "sha", out="node")
        nodes = staged(numbered, "assign-nodes")
        release(numbered)
        rows = staged(
            links.select("sha", "taxon", "observer", "observation", "near", came.alias("came")).where("came IS NOT NULL").join(nodes, "sha").drop("sha"), "assign-rows"
        )
        decided = [spark.createDataFrame([], f"group_id long, name string, taxon {kind}, split string, observers array<string>, assigned_at long")]
        placed = [spark.createDataFrame([], "sha long, group_id long")]
        for k in range(len(batches)):
            seen = rows.where(F.col("came") <= k).drop("came")
            conflicts = seen.groupBy("node").agg(F.min("taxon").alias("a"), F.max("taxon").alias("z")).where("a <> z").select("node")
            clean = staged(seen.join(conflicts, "node", "left_anti"), "assign-clean")
            ends = graph.components(graph.leak_edges(clean, "observation", "near", key="node"))
            found = clean.select("node").distinct().join(ends, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
            before = reduce(DataFrame.unionByName, decided)
            comp = staged(splits.standing(found, before, reduce(DataFrame.unionByName, placed)), "assign-standing")
            release(ends)
            met = staged(splits.touched(comp, nodes), "assign-met")
            fresh = comp.where("group_id IS NULL").select(F.col("node").alias("sha"), "root")
            fresh = staged(fresh.join(met.select("root", "group_id", "n_splits"), "root", "left"), "assign-fresh")
            free = fresh.where("n_splits IS NULL").select("sha", "root")
            waiting = splits.pending(free, clean.select(F.col("node").alias("sha"), "taxon", "observer"))
            waiting = staged(waiting.join(nodes.select(F.col("node").alias("root"), F.col("sha").alias("name")), "root"), "assign-pending")
            new = splits.decided(waiting, before, "name").drop("taxon")
            new = staged(new.join(waiting.withColumnRenamed("root", "group_id"), "group_id").withColumn("assigned_at", F.lit(k).cast("long")), "assign-groups")
            joined = fresh.where("n_splits = 1").select("sha", "group_id").unionByName(free.withColumnRenamed("root", "group_id"))
            joined = staged(joined, "assign-members")
            bridges = fresh.where("n_splits > 1").select("sha", "root").join(met.select("root", "detail"), "root")
            quarantined = bridges.select("sha", F.lit("bridges_split_conflict").alias("reason"), "detail")
            held.insert_new(_of_nodes(quarantined, nodes), ["sha"], [F.col("detail")])
            groups.insert_new(new.drop("group_id").withColumnRenamed("name", "group_id"), ["group_id"], [F.col("split")])
            decided.append(new.select(*before.columns))
            names = reduce(DataFrame.unionByName, decided).select("group_id", "name")
            members.commit(_of_nodes(joined.join(names, "group_id").select("sha", F.col("name").alias("group_id")), nodes), members.version(), keep=True)
            placed.append(joined)
            decided[-1]._staged_at = new._staged_at
            release(clean, comp, met, fresh, waiting)
        release(nodes, rows, *placed, *decided)
    return groups, members, held


def order_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders as contents: class (nation modulo 5), observer (customer), observation (customer and month), near copies (price to 20)."""
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).withColumn("taxon", (F.col("c_nationkey") % 5).cast("int"))
    return j.select(
        "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"), "taxon", F.col("o_custkey").cast("string").alias("observer"),
        F.concat_ws("/", "o_custkey", F.date_format("o_orderdate", "yyyy-MM")).alias("observation"),
        F.concat_ws("/", "taxon", F.floor(F.col("o_totalprice") / 20)).alias("near"),
    )


@query()
def g4_batches(spark, d):
    """Three batches of orders into persisted groups: where each order ended, or why it is held back. No SQL: each batch depends on what was persisted."""
    links = order_links(spark, d)
    k = F.col("o_orderkey") % 4
    groups, members, held = assignment_batches(spark, links.withColumn("k", k), [F.col("k") < 2, F.col("k") == 2, F.col("k") == 3])
    placed = members.read().join(groups.read().select("group_id", "split", "assigned_at"), "group_id")
    kept = held.read().select("sha", F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("long").alias("assigned_at"), "reason")
    return placed.withColumn("reason", F.lit(None).cast("string")).unionByName(kept)


#: All queries: those of the catalog and of this module.
REGISTERED = QUERIES
