"""Entities bound to the star-schema tables, as frames and as the same CTEs for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-06-01 00:00:00"
DAY = "2024-01-15 00:00:00"
AFTER = "2024-02-01 00:00:00"


class Model:
    """Lazy entity frames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def companies(self) -> DataFrame:
        n = F.col("s_suppkey")
        status = F.when(n % 10 == 0, "pending").when(n % 10 == 1, "ambiguous").when(n % 10 == 2, "unresolved").otherwise("resolved")
        hint = F.when(n % 7 == 0, "NYSE").when(n % 7 == 1, "LSE").when(n % 7 == 2, "XTRA").when(n % 7 == 3, "TSE").when(n % 7 == 4, "SHSE").when(n % 7 == 5, "OTCPK")
        tail = F.when(n % 10 > 2, "").when(n % 3 == 0, ".L").when(n % 3 == 1, "_F").otherwise(".Y")
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            n.alias("id"), F.concat(F.lit("T"), n.cast("string"), tail).alias("ticker"), F.col("s_name").alias("company_name"), F.concat(F.lit("name "), (n % 40).cast("string")).alias("name_normalized"), F.col("n_name").alias("country"),
            (n % 2 == 0).alias("is_us_listed"), hint.alias("exchange_hint"), status.alias("resolution_status"), F.when(n % 20 == 2, "rejected: other name").alias("resolution_note"), (F.col("s_acctbal") > 0).alias("is_active"),
        )

    @property
    def articles(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1).cast("int")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderstatus").alias("provider"), F.least(F.lit(3), first).alias("source_tier"), (F.col("o_custkey") % 7 == 0).alias("is_market_wide"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("headline"), F.concat(F.lit("https://www.site"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example.com/a/"), F.col("o_orderkey").cast("string")).alias("url"), F.concat(F.lit("desk "), (F.col("o_custkey") % 12).cast("string")).alias("source"),
        )

    @property
    def links(self) -> DataFrame:
        """(orderkey, suppkey) repeats in lineitem, so links are aggregated first."""
        g = self.table("lineitem").groupBy(F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("company_id"))
        flag = F.min("l_returnflag")
        return g.agg(F.when(flag == "A", "ticker").when(flag == "N", "name_match").otherwise("market_scan").alias("match_method"), (0.5 + F.max("l_tax")).cast("decimal(3,2)").alias("confidence"), (1 - F.max("l_discount")).cast("decimal(3,2)").alias("relevance"))

    @property
    def listings(self) -> DataFrame:
        v = F.col("p_size") % 6
        code = F.when(v.isin(0, 4), "US").when(v == 1, "LN").when(v == 2, "GY").when(v == 3, "SS").otherwise("HK")
        mic = F.when(v == 0, "XNYS").when(v == 4, "OOTC").when(v == 1, "XLON").when(v == 2, "XETR").when(v == 3, "XSTO").otherwise("XHKG")
        kind = F.when(F.col("p_type") == "PROMO", "adr").when(F.col("p_type") == "ECONOMY", "other").otherwise("ordinary")
        pairs = self.table("lineitem").select("l_suppkey", "l_partkey").distinct()
        return pairs.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("company_id"), code.alias("exchange_code"), mic.alias("mic"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), kind.alias("security_kind"),
            v.isin(0, 4).alias("is_us"), (F.col("p_size") % 5 == 0).alias("is_primary"), ((F.col("p_partkey") % 100) / 100).cast("decimal(3,2)").alias("confidence"), F.col("p_name").alias("name"), F.when(F.col("l_suppkey") % 4 == 0, F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("resolved_at"),
        )

    @property
    def run_events(self) -> DataFrame:
        """Every outcome event of (run, company); a run is a day."""
        e, kind = F.col("event_id"), F.col("event_type")
        outcome = F.when(kind == "purchase", "ok").when(kind == "view", "no_news").when(kind == "error", "error").when(kind == "click", "rate_limited").otherwise("skipped")
        second = F.when(e % 4 == 0, "ok").when(e % 4 == 1, "no_news").otherwise("error")
        text = F.concat(F.lit('[{"provider":"p'), (e % 3).cast("string"), F.lit('","outcome":"'), outcome, F.lit('","ms":'), (e % 500).cast("string"), F.lit('},{"provider":"p'), ((e + 1) % 3).cast("string"), F.lit('","outcome":"'), second, F.lit('","ms":7}]'))
        day = F.to_date("ts")
        return self.table("events").select(e.alias("seq"), F.dayofmonth(day).cast("long").alias("run_id"), F.col("user_id").alias("company_id"), F.concat(F.lit("p"), ((e + 1) % 3).cast("string")).alias("provider"), outcome.alias("outcome"), F.get_json_object("props", "$.k").cast("long").alias("articles_new"), (e % 500).alias("ms"), day.cast("timestamp").alias("started_at"), F.col("ts").cast("timestamp").alias("at"), text.alias("attempts_json"))

    @property
    def run_rows(self) -> DataFrame:
        """One row per (run, company): the last write."""
        from pressline.operators import analytics

        rows = analytics.last_write(self.run_events, ["run_id", "company_id"], "seq")
        return rows.withColumn("provider_attempts", analytics.attempts(F.col("attempts_json")))

    @property
    def v2_articles(self) -> DataFrame:
        d = F.col("doc_id")
        when = F.timestamp_seconds(F.lit(1704067200) + (d * 97 % 86400) * 60)
        rights = F.struct((d % 3 != 0).alias("bodyAllowed"), (d % 5 == 0).alias("imageAllowed"))
        return self.table("documents").select(
            F.lpad(d.cast("string"), 9, "0").alias("id"), F.col("source").alias("provider_id"), F.substring_index("text", "\n", 1).alias("headline"), F.when(d % 4 != 0, F.col("text")).alias("summary"), F.when(d % 6 != 0, F.col("text")).alias("body"), when.alias("published_at"),
            F.array("lang", F.when(d % 9 == 0, "inflation").otherwise("markets")).alias("topics"), F.when(d % 23 == 0, "macro").alias("genre"), rights.alias("rights"), (d % 17 == 0).alias("deleted"), F.concat(F.lit("https://Img.example.org/"), d.cast("string"), F.lit(".png")).alias("image_url"), (d % 3 + 1).alias("revision"),
        )

    @property
    def v2_status(self) -> DataFrame:
        n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
        return self.table("documents").select("source").distinct().select(F.col("source").alias("provider_id"), (n % 5 != 0).alias("enabled"), (n % 7 != 0).alias("configured"), F.lit(True).alias("display_licensed"), (n % 2 == 0).alias("free"), (n % 3 == 0).alias("full_text_enabled"))

    @property
    def v2_links(self) -> DataFrame:
        return self.table("documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("article_id"), (F.col("doc_id") % 10).alias("company_id"))


CTES = {
    "companies": """companies AS (SELECT s_suppkey AS id,
  'T' || s_suppkey || CASE WHEN s_suppkey % 10 > 2 THEN '' WHEN s_suppkey % 3 = 0 THEN '.L' WHEN s_suppkey % 3 = 1 THEN '_F' ELSE '.Y' END AS ticker,
  s_name AS company_name, 'name ' || (s_suppkey % 40) AS name_normalized, n_name AS country, s_suppkey % 2 = 0 AS is_us_listed,
  CASE s_suppkey % 7 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'LSE' WHEN 2 THEN 'XTRA' WHEN 3 THEN 'TSE' WHEN 4 THEN 'SHSE' WHEN 5 THEN 'OTCPK' END AS exchange_hint,
  CASE s_suppkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'unresolved' ELSE 'resolved' END AS resolution_status,
  CASE WHEN s_suppkey % 20 = 2 THEN 'rejected: other name' END AS resolution_note, s_acctbal > 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "articles": """articles AS (SELECT o_orderkey AS id, o_orderdate AS published_at, o_orderstatus AS provider, least(3, CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS source_tier,
  o_custkey % 7 = 0 AS is_market_wide, 'Order ' || o_orderkey || ' ' || o_orderpriority AS headline,
  'https://www.site' || (o_custkey % 50) || '.example.com/a/' || o_orderkey AS url, 'desk ' || (o_custkey % 12) AS source FROM orders)""",
    "links": """links AS (SELECT l_orderkey AS article_id, l_suppkey AS company_id,
  CASE min(l_returnflag) WHEN 'A' THEN 'ticker' WHEN 'N' THEN 'name_match' ELSE 'market_scan' END AS match_method,
  CAST(0.5 + max(l_tax) AS DECIMAL(3,2)) AS confidence, CAST(1 - max(l_discount) AS DECIMAL(3,2)) AS relevance
  FROM lineitem GROUP BY l_orderkey, l_suppkey)""",
    "listings": """listings AS (SELECT l_suppkey * 1000000 + l_partkey AS id, l_suppkey AS company_id,
  CASE WHEN p_size % 6 IN (0, 4) THEN 'US' WHEN p_size % 6 = 1 THEN 'LN' WHEN p_size % 6 = 2 THEN 'GY' WHEN p_size % 6 = 3 THEN 'SS' ELSE 'HK' END AS exchange_code,
  CASE p_size % 6 WHEN 0 THEN 'XNYS' WHEN 4 THEN 'OOTC' WHEN 1 THEN 'XLON' WHEN 2 THEN 'XETR' WHEN 3 THEN 'XSTO' ELSE 'XHKG' END AS mic, 'P' || p_partkey AS symbol,
  CASE p_type WHEN 'PROMO' THEN 'adr' WHEN 'ECONOMY' THEN 'other' ELSE 'ordinary' END AS security_kind,
  p_size % 6 IN (0, 4) AS is_us, p_size % 5 = 0 AS is_primary, CAST((p_partkey % 100) / 100.0 AS DECIMAL(3,2)) AS confidence, p_name AS name,
  CASE WHEN l_suppkey % 4 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS resolved_at
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)""",
    "run_events": """run_events AS (SELECT event_id AS seq, CAST(day(ts) AS BIGINT) AS run_id, user_id AS company_id, 'p' || ((event_id + 1) % 3) AS provider,
  CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'no_news' WHEN 'error' THEN 'error' WHEN 'click' THEN 'rate_limited' ELSE 'skipped' END AS outcome,
  CAST(json_extract(props, '$.k') AS BIGINT) AS articles_new, event_id % 500 AS ms, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS started_at, ts AS at_ts,
  'p' || (event_id % 3) AS p1, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_news' ELSE 'error' END AS second FROM events)""",
    "run_rows": """run_rows AS (SELECT * FROM run_events QUALIFY row_number() OVER (PARTITION BY run_id, company_id ORDER BY seq DESC) = 1)""",
    "v2": """v2 AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, doc_id, source AS provider_id, split_part(text, chr(10), 1) AS headline,
  CASE WHEN doc_id % 4 <> 0 THEN text END AS summary, CASE WHEN doc_id % 6 <> 0 THEN text END AS body,
  to_timestamp(1704067200 + (doc_id * 97 % 86400) * 60)::TIMESTAMP AS published_at, [lang, CASE WHEN doc_id % 9 = 0 THEN 'inflation' ELSE 'markets' END] AS topics,
  CASE WHEN doc_id % 23 = 0 THEN 'macro' END AS genre, doc_id % 3 <> 0 AS body_allowed, doc_id % 5 = 0 AS image_allowed, doc_id % 17 = 0 AS deleted, doc_id % 3 + 1 AS revision FROM documents)""",
    "v2_status": """v2_status AS (SELECT source AS provider_id, n % 5 <> 0 AS enabled, n % 7 <> 0 AS configured, n % 2 = 0 AS free, n % 3 = 0 AS full_text_enabled
  FROM (SELECT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM (SELECT DISTINCT source FROM documents)))""",
    "v2_links": """v2_links AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS article_id, doc_id % 10 AS company_id FROM documents)""",
}
NEEDS = {"run_rows": ("run_events",)}


def sql(body: str, *names: str) -> str:
    """body after the CTEs that it names."""
    wanted: list[str] = []
    for n in names:
        wanted += [d for d in NEEDS.get(n, ()) if d not in wanted]
        wanted += [n] if n not in wanted else []
    return "WITH " + ",\n".join(CTES[n] for n in wanted) + ("\n, " + body.lstrip()[5:] if body.lstrip().startswith("WITH ") else "\n" + body)
