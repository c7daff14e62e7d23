"""From companies to all their lines: the cascade of passes, the expansion, the asserted lines.

Remote lookups are reference tables here.  ``ids`` is the map of identifiers, a row for each
security on a venue: place (order of the answers), symbol, exchange_code (null: no venue), name,
type1, type2, figi, composite, share_class.  ``directory`` is the domestic symbol directory with
its join keys and a share_class (see sources.files.us_directory).

Every pass is an equi-join on a key (spelling of a ticker, ticker and venue, part of a name) and
every choice a window by company, so no company meets a security that it shares no key with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import exchange, names
from pressline.operators import resolution

# How certain a line is by the way it was found.
CONFIDENCE = {
    "directory": 0.95,
    "scoped_id": 0.95,
    "rename": 0.6,
    "directory_any_hint": 0.95,
    "bare_ticker": 0.8,
    "name_search": 0.7,
    "share_class": 0.9,
    "directory_name": 0.75,
    "asserted_us": 0.5,
}
PREFIXES = (3, 2)  # words of the shortened names that are searched for, in this order

FOUND = ("company_id", "how", "symbol", "exchange_code", "mic", "share_class", "found_name", "score")


def hinted(companies: DataFrame) -> DataFrame:
    """companies with company_key (the normal name), codes (the venues to try), hint_code and local: may the domestic directory answer first?

    Only with a domestic hint or none: a foreign company's ticker is another company's at home.
    """
    hint = F.nullif(F.col("exchange_hint"), F.lit(""))
    domestic = exchange.hint_field(hint, "country") == "US"
    return companies.withColumns({"codes": exchange.candidate_codes(hint), "hint_code": exchange.hint_field(hint, "code"), "local": hint.isNull() | F.coalesce(domestic, F.lit(False)), "company_key": names.normalize_name(F.col("company_name"))})


def by_directory(companies: DataFrame, directory: DataFrame) -> DataFrame:
    """The best directory row of each company under any spelling of its ticker, if the names agree."""
    spelled = companies.select("id", "company_key", F.posexplode(names.ticker_variants(F.col("ticker"))).alias("variant", "symbol_key"))
    hits = spelled.join(directory, "symbol_key").withColumn("score", names.key_similarity(F.col("company_key"), F.col("name_key"))).filter(F.col("score") >= names.MATCH_AT)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "variant", "venue_rank", "symbol", "mic", "figi"))
    best = hits.withColumn("n", place).filter("n = 1")
    return best.select(F.col("id").alias("company_id"), F.lit("directory").alias("how"), "symbol", F.lit("US").alias("exchange_code"), "mic", F.nullif("share_class", F.lit("")).alias("share_class"), F.col("description").alias("found_name"), "score")


def best_by_name(hits: DataFrame, *by: str) -> DataFrame:
    """by and best: the best security for each value of the columns in by (shares alone, names that agree, among near ties of the best score the most useful line; null if none fits), and first, the first answer."""
    quality = exchange.listing_quality(F.col("exchange_code"), F.col("symbol"), F.col("figi"), F.col("composite"), names.home_country(F.col("company_name")))
    return _best_of(hits.withColumns({"quality": quality, "share": exchange.is_equity_line(F.col("type1"), F.col("type2"))}), *by)


def _best_of(hits: DataFrame, *by: str) -> DataFrame:
    """best_by_name of hits with their quality, and share: is it one?"""
    scored = hits.withColumn("score", names.key_similarity(F.col("company_key"), F.coalesce("name_key", F.lit(""))))
    fits = F.col("share") & (F.col("score") >= names.MATCH_AT) & (F.col("quality") >= 0)
    scored = scored.withColumn("fit", F.when(F.coalesce(fits, F.lit(False)), F.col("score")))
    near = F.when(F.col("fit") > F.max("fit").over(Window.partitionBy(*by)) - resolution.NEAR_TIE, F.struct("quality", "score", -F.col("place")))
    row = F.struct("company_key", "name_key", "symbol", "exchange_code", "name", "share_class", "score")
    return scored.withColumn("near", near).groupBy(*by).agg(F.max_by(row, "near").alias("best"), F.min_by(row, "place").alias("first"))


def _found(best: DataFrame, how: Column) -> DataFrame:
    b = best["best"]
    return best.select("company_id", how.alias("how"), b["symbol"].alias("symbol"), b["exchange_code"].alias("exchange_code"), exchange.code_field(b["exchange_code"], "mic").alias("mic"), F.nullif(b["share_class"], F.lit("")).alias("share_class"), b["name"].alias("found_name"), b["score"].alias("score"))


def by_ticker(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """The best security of each company's ticker on any venue."""
    hits = companies.select(F.col("id").alias("company_id"), "company_name", "company_key", F.upper(F.trim("ticker")).alias("key")).join(ids.withColumn("key", F.upper("symbol")), "key")
    return _found(best_by_name(hits, "company_id").filter("best IS NOT NULL"), F.lit("bare_ticker"))


def _shared_words(a: Column, b: Column) -> Column:
    """Number of distinctive words that two normal names share."""
    words = lambda key: F.filter(F.split(key, " "), lambda w: w != "")
    return F.size(F.array_intersect(words(a), words(b)))


def by_venue(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """The security of each company's ticker on the first hinted venue that has one whose name agrees, or is a rename.

    A rename: no name there agrees, and that of the first answer shares a distinctive word with the company's.
    """
    slots = companies.select(F.col("id").alias("company_id"), "company_name", "company_key", F.upper(F.trim("ticker")).alias("key"), F.posexplode("codes").alias("slot", "exchange_code"))
    met = best_by_name(slots.join(ids.withColumn("key", F.upper("symbol")), ["key", "exchange_code"]), "company_id", "slot")
    how = F.when(F.col("best").isNotNull(), "scoped_id").when(F.coalesce(_shared_words(F.col("first.company_key"), F.col("first.name_key")) >= 1, F.lit(False)), "rename")
    met = met.withColumn("how", how).filter("how IS NOT NULL").withColumn("best", F.coalesce("best", "first"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("slot"))
    met = met.withColumn("n", place).filter("n = 1")
    return _found(met, met["how"])


def search_names(name: Column, normal: Column) -> Column:
    """The queries of a name search in order: the name, its normal form, its first three and two words."""
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    short = [F.array_join(F.slice(words, 1, n), " ") for n in PREFIXES]
    return F.array_distinct(F.filter(F.array(F.lower(name), normal, *short), lambda q: q.isNotNull() & (q != "")))


def by_name(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """The best security that a search for each company's name finds: longer forms of the name first, each on the hinted venue, then anywhere.

    A query finds the names that it equals or is the beginning of, up to the prefixes that are searched for.
    Companies that ask alike are one question; of securities that differ for none (name, venue and use
    alike) the first stands for all.  So many companies and securities of few names make no pairs.
    """
    c = companies.select(F.col("id").alias("company_id"), F.struct(search_names(F.col("company_name"), F.col("company_key")).alias("queries"), "company_key", "hint_code", names.home_country(F.col("company_name")).alias("home")).alias("q"))
    c = c.withColumn("question", F.to_json("q"))
    asked = c.dropDuplicates(["question"]).select("question", "q.company_key", "q.hint_code", "q.home", F.posexplode("q.queries").alias("query", "key"))
    use = exchange.listing_quality(F.col("exchange_code"), F.col("symbol"), F.col("figi"), F.col("composite"), F.lit(None).cast("string"))
    fit = ids.filter(F.col("name").isNotNull() & exchange.is_equity_line(F.col("type1"), F.col("type2"))).withColumn("use", use).filter("use >= 0")
    keyed = fit.select("*", F.explode(search_names(F.col("name"), F.col("name_key"))).alias("key"))
    keyed = keyed.groupBy("key", "name_key", "exchange_code", "use").agg(F.min_by(F.struct("place", "symbol", "name", "share_class"), "place").alias("s")).select("key", "name_key", "exchange_code", "use", "s.*")
    hits = asked.join(keyed, "key").withColumn("scope", F.explode(F.when(F.col("exchange_code") == F.col("hint_code"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    at_home = F.coalesce(exchange.code_field(F.upper(F.coalesce("exchange_code", F.lit(""))), "country") == F.col("home"), F.lit(False))
    hits = hits.withColumns({"quality": F.col("use") + F.when(at_home, exchange.HOME_POINTS).otherwise(0), "share": F.lit(True)})
    best = _best_of(hits, "question", "query", "scope").filter("best IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("question").orderBy("query", "scope"))
    answers = best.withColumn("n", place).filter("n = 1").select("question", "best")
    return _found(c.select("company_id", "question").join(answers, "question"), F.lit("name_search"))


def as_is(df: DataFrame) -> DataFrame:
    return df


def primaries(companies: DataFrame, directory: DataFrame, ids: DataFrame, stage: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """The security of each company that has one: FOUND and confidence.

    In this order: the domestic directory where the hint allows it; the hinted venues (agreeing
    name or rename), or the bare ticker of a company that names no venue; the directory whatever
    the hint; the bare ticker.  Companies without any, and those whose security no provider has
    a symbol for, are searched for by name, which replaces what there was.  stage may keep what
    several passes read.
    """
    return _primaries(stage(hinted(companies)), directory, ids, stage)


def _primaries(c: DataFrame, directory: DataFrame, ids: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    ids = stage(ids.withColumn("name_key", names.normalize_name(F.col("name"))))
    local = c.select(F.col("id").alias("company_id"), "local", (F.size("codes") == 0).alias("nowhere"))
    home = by_directory(c, directory).join(local, "company_id").withColumn("pass", F.when(F.col("local"), 0).otherwise(2)).withColumn("how", F.when(F.col("local"), "directory").otherwise("directory_any_hint"))
    bare = by_ticker(c, ids).join(local, "company_id").withColumn("pass", F.when(F.col("nowhere"), 1).otherwise(3))
    venue = by_venue(c, ids).withColumn("pass", F.lit(1))
    every = reduce(lambda a, b: a.unionByName(b), (df.select("pass", *FOUND) for df in (home, venue, bare)))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("pass"))
    first = stage(every.withColumn("n", place).filter("n = 1").drop("n", "pass"))
    usable = F.col("how").isin("directory", "directory_any_hint") | exchange.market_symbol(F.col("exchange_code"), F.col("symbol")).isNotNull()
    kept = first.filter(F.coalesce(usable, F.lit(False))).select(F.col("company_id").alias("id"))
    searched = by_name(c.join(kept, "id", "left_anti"), ids).withColumn("pass", F.lit(0))
    both = searched.unionByName(first.withColumn("pass", F.lit(1)))
    won = both.withColumn("n", place).filter("n = 1").select(*FOUND)
    return won.withColumn("confidence", exchange.lookup(F.col("how"), CONFIDENCE))


def resolve(companies: DataFrame, directory: DataFrame, ids: DataFrame, stage: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """All lines of all companies: company_id, how, found_name, found_confidence (null where nothing was found), exchange_code, symbol, mic, is_us, is_primary, confidence; one row without a line for a company that has none.

    The lines are those of the security itself if it has a venue and a symbol, the directory's
    lines of its share class, and those whose name is its or the company's; what is inferred
    from a security is no more certain than the security.  A company without a domestic line
    whose supplier says twice that it has one gets that line, which then is the sole primary.
    The result has a row for each company and line of its name: as many as there are.
    """
    return _lines(companies, directory, ids, stage, True)


def statuses(companies: DataFrame, directory: DataFrame, ids: DataFrame, stage: Callable[[DataFrame], DataFrame] = as_is) -> DataFrame:
    """status of resolve without all the lines: one directory row stands for those of a share class or of a name."""
    return status(_lines(companies, directory, ids, stage, False))


def _lines(companies: DataFrame, directory: DataFrame, ids: DataFrame, stage: Callable[[DataFrame], DataFrame], every: bool) -> DataFrame:
    c = stage(hinted(companies))
    found = _primaries(c, directory, ids, stage).withColumnRenamed("company_id", "id")
    who = c.join(found, "id", "left").select(F.col("id").alias("company_id"), "company_key", "hint_code", "ticker", resolution.may_assert_us(c).alias("assertable"), *FOUND[1:], F.col("confidence").alias("found_confidence"))
    # what each company looks for in the directory, and what it has without it
    keys = F.array_distinct(F.array("company_key", F.when(F.col("found_name").isNotNull(), names.normalize_name(F.col("found_name"))).otherwise(F.col("company_key"))))
    look = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    wanted = F.when(F.col("how").isNotNull(), F.concat(F.array(look("own", F.lit(""))), F.when(F.col("share_class").isNotNull(), F.array(look("class", F.col("share_class")))).otherwise(F.array()), F.transform(F.filter(keys, lambda k: k != ""), lambda k: look("name", k))))
    wanted = F.concat(F.coalesce(wanted, F.array()), F.array(F.struct(F.when(F.col("assertable"), "asserted").otherwise("none").alias("kind"), F.lit("").alias("key"))))
    # a name's lines are those whose name agrees with the company's, which the key alone tells
    asked = who.select("*", F.inline(wanted)).filter((F.col("kind") != "name") | (F.col("key") == F.col("company_key")) | (names.key_similarity(F.col("company_key"), F.col("key")) >= names.MATCH_AT))
    us = directory.select(F.struct("symbol", "mic", F.nullif("share_class", F.lit("")).alias("share_class")).alias("row"), F.inline(F.array(F.struct(F.lit("class").alias("kind"), F.nullif("share_class", F.lit("")).alias("key")), F.struct(F.lit("name").alias("kind"), F.nullif("name_key", F.lit("")).alias("key"))))).filter("key IS NOT NULL")
    us = us if every else us.groupBy("kind", "key").agg(F.max("row").alias("row"))
    met = asked.join(us, ["kind", "key"], "left")
    named = (F.col("kind") == "name") & F.col("row").isNotNull()
    sibling = (F.col("kind") == "class") & F.col("row").isNotNull()
    own = (F.col("kind") == "own") & (F.trim(F.coalesce("exchange_code", F.lit(""))) != "") & (F.trim(F.coalesce("symbol", F.lit(""))) != "")
    same_class = F.coalesce(F.col("row.share_class") == F.col("share_class"), F.lit(False))
    sure = F.least(F.when(sibling | same_class, F.lit(CONFIDENCE["share_class"])).otherwise(CONFIDENCE["directory_name"]), F.col("found_confidence"))
    line = (
        F.when(own, F.struct(F.col("exchange_code"), F.col("symbol"), F.col("mic"), exchange.is_us_code(F.col("exchange_code")).alias("is_us"), F.lit(True).alias("marked"), F.col("found_confidence").alias("confidence")))
        .when(named | sibling, F.struct(F.lit("US").alias("exchange_code"), F.col("row.symbol").alias("symbol"), F.col("row.mic").alias("mic"), F.lit(True).alias("is_us"), F.lit(False).alias("marked"), sure.alias("confidence")))
        .when(F.col("kind") == "asserted", F.struct(F.lit("US").alias("exchange_code"), F.col("ticker").alias("symbol"), F.lit(None).cast("string").alias("mic"), F.lit(True).alias("is_us"), F.lit(False).alias("marked"), F.lit(CONFIDENCE["asserted_us"]).alias("confidence")))
    )
    met = met.withColumn("line", line).withColumn("asserted", F.col("kind") == "asserted")
    of_company = Window.partitionBy("company_id")
    met = met.withColumn("has_us", F.max(F.when(~F.col("asserted"), F.col("line.is_us"))).over(of_company)).filter(~(F.col("asserted") & F.coalesce("has_us", F.lit(False))))
    facts = ["company_id", "how", "found_name", "found_confidence", "hint_code"]
    once = met.groupBy(*facts, "line.exchange_code", "line.symbol").agg(
        F.max_by(F.struct("line.mic", "line.is_us"), F.struct("line.confidence", F.coalesce("line.mic", F.lit("")))).alias("b"), F.bool_or("line.marked").alias("marked"), F.max("line.confidence").alias("confidence"), F.bool_and("asserted").alias("asserted")
    )
    once = once.withColumn("some", F.max(F.col("symbol").isNotNull()).over(of_company)).filter("symbol IS NOT NULL OR NOT some")
    rank = F.when(F.col("asserted"), 0).when(F.col("marked"), 1).when(F.col("exchange_code") == F.col("hint_code"), 2).when(F.col("b.is_us") & (F.coalesce("b.mic", F.lit("")) != "OOTC"), 3).otherwise(4)
    place = F.row_number().over(of_company.orderBy(rank, F.col("confidence").desc(), "exchange_code", "symbol"))
    return once.select("company_id", F.coalesce("how", F.when(F.col("symbol").isNotNull(), "asserted_us")).alias("how"), "found_name", "found_confidence", "exchange_code", "symbol", "b.mic", "b.is_us", F.when(F.col("symbol").isNotNull(), place == 1).alias("is_primary"), "confidence")


def status(resolved: DataFrame) -> DataFrame:
    """One row for each company of ``resolve``: company_id, how, found_name, confidence (of what it rests on) and resolution_status."""
    has = F.count("symbol") > 0
    sure = F.coalesce(F.max("found_confidence"), F.when(has, F.max("confidence")))
    return resolved.groupBy("company_id").agg(F.max("how").alias("how"), F.max("found_name").alias("found_name"), sure.alias("confidence"), F.when(has, "resolved").otherwise("unresolved").alias("resolution_status"))
