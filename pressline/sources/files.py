"""File sources: CSV, JSON, XML and evidence files, always with an explicit schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressline import schemas
from pressline.functions import exchange, names, text, url

MAX_SNAPSHOT_ROWS = 200_000
MIN_DIRECTORY_ROWS = 1000


class InvalidSource(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header: doubled quotes, line ends in quotes, BOM; keys by position of the header, values trimmed, missing cells empty, blank rows dropped."""
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8", enforceSchema=True)
    filled = raw.select(*(F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in raw.columns))
    return filled.filter(reduce(lambda a, b: a | b, (F.col(c) != "" for c in raw.columns)))


def boolean(value):
    """true/t/yes/y/1 and false/f/no/n/0 in any case; null for anything else."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)


def catalogue(rows: DataFrame, order: str) -> DataFrame:
    """Valid catalogue rows, the first of each ticker by ``order`` (a line number that the reader gave)."""
    valid = rows.filter((F.col("ticker") != "") & (F.col("company_name") != ""))
    first = F.row_number().over(Window.partitionBy("ticker").orderBy(order))
    out = valid.withColumn("__n", first).filter("__n = 1").drop("__n")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return out.select("ticker", "company_name", names.normalize_name(F.col("company_name")).alias("name_normalized"), blank("sector").alias("sector"), F.upper(blank("country")).alias("country"), boolean(F.col("is_us_listed")).alias("is_us_listed"), blank("exchange_hint").alias("exchange_hint"), order)


def catalogue_audit(rows: DataFrame, order: str) -> DataFrame:
    """issue, subject of each finding: duplicate tickers and names, unknown or missing hints, flags and countries that contradict the hint."""
    kept = catalogue(rows, order)
    hint = F.col("exchange_hint")
    known = exchange.hint_field(hint, "code").isNotNull()
    us = exchange.hint_field(hint, "country") == "US"
    found = F.array_compact(
        F.array(
            F.when(hint.isNull(), F.lit("missing_hint")),
            F.when(hint.isNotNull() & ~known, F.lit("unknown_hint")),
            F.when(known & (F.col("is_us_listed") != us), F.lit("flag_conflict")),
            F.when(known & ~us & (F.col("country") != exchange.hint_field(hint, "country")), F.lit("country_conflict")),
        )
    )
    rowwise = kept.select(F.explode(found).alias("issue"), F.col("ticker").alias("subject"))
    tickers = rows.filter((F.col("ticker") != "") & (F.col("company_name") != "")).groupBy("ticker").count().filter("count > 1").select(F.lit("duplicate_ticker").alias("issue"), F.col("ticker").alias("subject"))
    same = kept.filter("name_normalized <> ''").groupBy("name_normalized").agg(F.countDistinct("ticker").alias("n")).filter("n > 1").select(F.lit("duplicate_name").alias("issue"), F.col("name_normalized").alias("subject"))
    return rowwise.unionByName(tickers).unionByName(same)


def snapshot_valid():
    """Row rule of listing snapshots."""
    c = F.col
    ranged = F.coalesce(c("confidence").between(0, 1), F.lit(True))
    status = c("resolution_status").isin("resolved", "ambiguous", "unresolved", "pending")
    whole = c("symbol").isNotNull() & c("symbol_format").isin("us", "suffixed", "numeric_suffixed", "unknown") & c("security_kind").isNotNull() & c("source").isNotNull() & c("confidence").isNotNull() & c("is_us").isNotNull() & c("is_primary").isNotNull()
    return F.coalesce((F.trim(c("ticker")) != "") & (F.trim(c("company_name")) != "") & status & ranged & (c("exchange_code").isNull() | whole), F.lit(False))


def listing_snapshot(rows: DataFrame) -> DataFrame:
    """rows if all are valid and a ticker has one identity throughout; else InvalidSource, as one bad row rejects the file."""
    n = rows.limit(MAX_SNAPSHOT_ROWS + 1).count()
    if not 1 <= n <= MAX_SNAPSHOT_ROWS:
        raise InvalidSource(f"a snapshot has 1 to {MAX_SNAPSHOT_ROWS} rows")
    if not rows.filter(~snapshot_valid()).isEmpty():
        raise InvalidSource("a row of the snapshot is not valid")
    if not conflicting_identities(rows).isEmpty():
        raise InvalidSource("a ticker of the snapshot has two identities")
    return rows


def conflicting_identities(rows: DataFrame) -> DataFrame:
    """Tickers with more than one (name, country, hint)."""
    who = F.struct("company_name", F.coalesce("country", F.lit("")), F.coalesce("exchange_hint", F.lit("")))
    return rows.groupBy("ticker").agg(F.countDistinct(who).alias("identities")).filter("identities > 1")


def us_directory(rows: DataFrame, least: int = MIN_DIRECTORY_ROWS) -> DataFrame:
    """The symbol directory with its join keys; InvalidSource for a truncated file."""
    if rows.limit(least).count() < least:
        raise InvalidSource("the symbol directory is too short to be whole")
    return rows.select("*", F.upper("symbol").alias("symbol_key"), names.normalize_name(F.col("description")).alias("name_key"), exchange.venue_rank(F.col("mic")).alias("venue_rank"), exchange.is_exchange_listed(F.col("mic")).alias("exchange_listed"))


def ticker_news(rows: DataFrame) -> DataFrame:
    """Ticker-native news (headline, url, datetime in epoch seconds, summary, source, image): rows without url, headline or time are dropped."""
    ok = (F.coalesce(F.trim("url"), F.lit("")) != "") & (F.coalesce(F.trim("headline"), F.lit("")) != "") & (F.coalesce(F.col("datetime"), F.lit(0)) > 0)
    return rows.filter(ok).select("headline", "url", F.nullif(F.trim("summary"), F.lit("")).alias("summary"), "source", F.timestamp_seconds("datetime").alias("published_at"), F.nullif(F.trim("image"), F.lit("")).alias("image_url"))


def entity_news(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Entity-tagged news: only articles that name one of the wanted symbols among their entities."""
    symbols = F.array(*(F.lit(s.upper()) for s in wanted))
    return rows.filter(F.exists("entities", lambda e: F.array_contains(symbols, F.upper(e["symbol"]))))


def rss_items(feeds: DataFrame, xml_col: str, *keep: str) -> DataFrame:
    """Items of RSS documents: title, link, pubDate as timestamp, source, description; one item or many alike."""
    schema = "channel struct<item array<struct<title:string,link:string,pubDate:string,description:string,category:string,guid:string,source:string>>>"
    parsed = feeds.select(*keep, F.from_xml(F.col(xml_col), schema, {"rowTag": "rss", "valueTag": "_VALUE", "ignoreNamespace": "true"}).alias("d"))
    item = parsed.select(*keep, F.explode("d.channel.item").alias("i"))
    when = F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return item.select(*keep, F.trim("i.title").alias("title"), F.trim("i.link").alias("url"), when.alias("published_at"), "i.source", "i.description", "i.category")


def widest_attempt(items: DataFrame, key: str, attempt: str, enough: int = 5) -> DataFrame:
    """Items of the first attempt with enough of them, else of the one with most (the earlier one on ties)."""
    sizes = items.groupBy(key, attempt).count()
    order = Window.partitionBy(key).orderBy((F.col("count") < enough), F.when(F.col("count") < enough, -F.col("count")), attempt)
    best = sizes.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(key, attempt)
    return items.join(best, [key, attempt])


def market_news(rows: DataFrame, order: str) -> DataFrame:
    """Category news: the first category of a URL counts; related becomes an array of upper-case symbols."""
    first = F.row_number().over(Window.partitionBy("url").orderBy(order))
    related = F.filter(F.transform(F.split(F.coalesce("related", F.lit("")), ","), lambda s: F.upper(F.trim(s))), lambda s: s != "")
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n").withColumn("related", related)


# Forms of filings that count as news.
FILING_FORMS = ("8-K", "8-K/A", "6-K", "6-K/A", "10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "40-F")


def filings(submissions: DataFrame) -> DataFrame:
    """Rows of columnar filings: cik, name, filings.recent of parallel arrays."""
    r = "filings.recent."
    zipped = F.arrays_zip(F.col(r + "accessionNumber"), F.col(r + "form"), F.col(r + "acceptanceDateTime"), F.col(r + "primaryDocument"))
    rows = submissions.select("cik", "name", F.explode(zipped).alias("f")).select("cik", "name", F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form"), F.try_to_timestamp("f.acceptanceDateTime").alias("published_at"), F.col("f.primaryDocument").alias("document"))
    kept = rows.filter(F.col("form").isin(*FILING_FORMS))
    fine = F.col("accession").rlike(r"^\d{10}-\d{2}-\d{6}$") & F.col("published_at").isNotNull() & F.col("document").rlike(r"(?i)^[a-z0-9_.-]+\.(?:htm|html|txt)$")
    if not kept.filter(~F.coalesce(fine, F.lit(False))).isEmpty():
        raise InvalidSource("a filing lacks a valid accession, document or time")
    link = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("bigint").cast("string"), F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/"), F.col("document"))
    return kept.select("*", link.alias("url"), F.concat(F.coalesce("name", F.lit("SEC filer")), F.lit(" — "), F.col("form"), F.lit(" filing")).alias("title"))


def atom_filings(entries: DataFrame) -> DataFrame:
    """Feed entries (title, link, category, updated) as filings: form from the category, else the title's first word."""
    form = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.nullif(F.regexp_extract("title", r"^\s*([0-9A-Z/-]+)\s+-\s", 1), F.lit("")))
    cik, accession = url.filing_parts(F.col("link"))
    return entries.select(cik.alias("cik"), accession.alias("accession"), form.alias("form"), "title", "link", "updated").filter(F.col("form").isin(*FILING_FORMS) & F.col("cik").isNotNull())


PROVIDER_ARTICLE = ("provider_id", "source_id", "action", "headline", "summary", "body", "url", "publisher", "published_at", "updated_at", "topics", "companies")


def provider_articles(*sources: DataFrame) -> DataFrame:
    """Union of normalised sources by name; fields that a source lacks are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).alias(c) for c in PROVIDER_ARTICLE))


def upserts_and_removals(news: DataFrame, removed: DataFrame) -> DataFrame:
    """Both phases of a window in one batch: news as upserts, removals as deletes."""
    return news.withColumn("action", F.lit("upsert")).unionByName(removed.withColumn("action", F.lit("delete")), allowMissingColumns=True)


def capped_articles(rows: DataFrame) -> DataFrame:
    """Caps and trims of a provider's articles."""
    return rows.withColumns({"headline": text.capped(F.col("headline"), "headline"), "summary": F.substring("summary", 1, text.CAPS["summary"]), "body": F.substring("body", 1, text.CAPS["body"]), "topics": text.clean_topics(F.col("topics")), "companies": F.slice("companies", 1, text.MAX_COMPANIES)})


def evidence(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Evidence files whose SHA-256 matches expected (name, sha256); InvalidSource if one differs or is missing."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"), "content")
    both = expected.join(found, "name", "left")
    if not both.filter(~F.col("sha256").eqNullSafe(F.col("found"))).isEmpty():
        raise InvalidSource("an evidence file differs from its manifest")
    return both.select("name", F.col("content").cast("string").alias("body"))


SCHEMAS = schemas.ENTITIES
