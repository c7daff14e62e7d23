"""Resolution of companies to listings: candidates, picks, expansion and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions import exchange, names

NEAR_TIE = 0.05

def ticker_candidates(companies: DataFrame, directory: DataFrame) -> DataFrame:
    """Directory rows under any spelling of a company's ticker; variant 0 is the ticker as given."""
    spelled = companies.select("id", "company_name", F.posexplode(names.ticker_variants(F.col("ticker"))).alias("variant", "symbol_key"))
    return spelled.join(directory, "symbol_key")


def name_candidates(companies: DataFrame, directory: DataFrame) -> DataFrame:
    """Directory rows with the company's normal name."""
    keyed = companies.withColumn("name_key", names.normalize_name(F.col("company_name"))).filter("name_key <> ''").select("id", "company_name", "name_key")
    return keyed.join(directory, "name_key")


def similar(left: DataFrame, right: DataFrame, threshold: float = names.MATCH_AT) -> DataFrame:
    """Pairs of left (lid, lname) and right (rid, rname) at least as similar as the threshold.

    Blocking: names that are that similar share a token, a token prefix of three letters, or
    are aliases or one word written apart, so pairs come from equi-joins on such keys only.
    """

    def keys(df, i, n):
        key = names.normalize_name(F.col(n))
        tokens = F.filter(F.split(key, " "), lambda t: t != "")
        joined = F.concat(F.lit("="), F.replace(key, F.lit(" "), F.lit("")))
        # the longest token that a shorter one may be a prefix of differs, so three letters are the common part
        heads = F.transform(F.filter(tokens, lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("^"), F.substring(t, 1, 3)))
        aliases = F.filter(F.split(F.coalesce(exchange.lookup(key, _alias_blocks()), F.lit("")), ","), lambda x: x != "")
        return df.select(i, n, key.alias(f"{n}_key"), F.explode(F.array_distinct(F.concat(tokens, heads, F.array(joined), aliases))).alias("block"))

    pairs = keys(left, "lid", "lname").join(keys(right, "rid", "rname"), "block").select("lid", "lname_key", "rid", "rname_key").distinct()
    return pairs.withColumn("similarity", names.key_similarity(F.col("lname_key"), F.col("rname_key"))).filter(F.col("similarity") >= threshold)


def _alias_blocks() -> dict[str, str]:
    """Normal form to the keys of its alias pairs."""
    out: dict[str, list[str]] = {}
    for i, pair in enumerate(sorted({(names.key_of(a), names.key_of(b)) for a, b in names.ALIASES})):
        for name in pair:
            out.setdefault(name, []).append(f"~{i}")
    return {k: ",".join(v) for k, v in out.items()}


def best_candidate(candidates: DataFrame, by=("company_id",), last: str = "symbol") -> DataFrame:
    """One candidate for each value of by (score, quality, last): among those within 0.05 of the best score the best quality, then score, then last.

    The near-tie rule taken pairwise is no order; this is its closest total one.
    """
    by = list(by)
    ok = candidates.filter((F.col("score") >= names.MATCH_AT) & (F.col("quality") >= 0))
    top = ok.withColumn("top", F.max("score").over(Window.partitionBy(*by))).filter(F.col("score") > F.col("top") - NEAR_TIE)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("quality").desc(), F.col("score").desc(), last))
    return top.withColumn("__n", place).filter("__n = 1").drop("__n", "top")


def rename_accepted(left: Column, right: Column) -> Column:
    """A ticker that fits but a name that does not: at least one shared token makes it a rename, none a collision."""
    return names.shared_tokens(left, right) >= 1


def expand(primary: DataFrame, siblings: DataFrame, named: DataFrame, hints: DataFrame) -> DataFrame:
    """All lines of a company (company_id, exchange_code, symbol, mic, is_us, is_primary, confidence).

    Siblings and name matches are no more certain than the primary; equal lines keep the most
    confident row and any primary mark; where none is primary, the hinted venue, then a US line
    on an exchange, then the first one is.
    """
    cols = ["company_id", "exchange_code", "symbol", "mic", "is_us", "is_primary", "confidence"]
    cap = primary.groupBy("company_id").agg(F.max("confidence").alias("cap"))
    rest = siblings.select(*cols).unionByName(named.select(*cols)).join(cap, "company_id").withColumn("confidence", F.least("confidence", "cap")).select(*cols)
    return joined_lines(primary.select(*cols).unionByName(rest), hints)


def joined_lines(lines: DataFrame, hints: DataFrame) -> DataFrame:
    """Equal lines put together, and one primary for each company (see expand); hints: company_id, hint_code."""
    best = F.max_by(F.struct("mic", "is_us"), F.struct("confidence", F.coalesce("mic", F.lit("")))).alias("b")
    once = lines.groupBy("company_id", "exchange_code", "symbol").agg(best, F.bool_or("is_primary").alias("marked"), F.max("confidence").alias("confidence"))
    once = once.select("company_id", "exchange_code", "symbol", "b.mic", "b.is_us", "marked", "confidence").join(hints, "company_id", "left")
    rank = F.when(F.col("marked"), 0).when(F.col("exchange_code") == F.col("hint_code"), 1).when(F.col("is_us") & (F.col("mic") != "OOTC"), 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(rank, F.col("confidence").desc(), "exchange_code", "symbol"))
    return once.withColumn("is_primary", place == 1).drop("marked", "hint_code")


def may_assert_us(companies: DataFrame) -> Column:
    """Does the supplier say twice (hint and flag), with a plain ticker, that the company has a US line?"""
    hinted = F.coalesce(exchange.hint_field(F.col("exchange_hint"), "country") == "US", F.lit(False))
    return F.coalesce(hinted & F.coalesce(F.col("is_us_listed"), F.lit(False)) & F.col("ticker").rlike("^[A-Z][A-Z0-9]{0,5}$"), F.lit(False))


def asserted_us(companies: DataFrame, lines: DataFrame) -> DataFrame:
    """Companies whose supplier says US twice (hint and flag) with a plain ticker, and that have no US line: one asserted line each, which becomes the sole primary."""
    none = companies.filter(may_assert_us(companies)).join(lines.filter("is_us").select(F.col("company_id").alias("id")), "id", "left_anti")
    return none.select(F.col("id").alias("company_id"), F.lit("US").alias("exchange_code"), F.col("ticker").alias("symbol"), exchange.hint_field(F.col("exchange_hint"), "mic").alias("mic"), F.lit(True).alias("is_us"), F.lit(True).alias("is_primary"), F.lit(0.5).alias("confidence"))


def with_asserted(lines: DataFrame, asserted: DataFrame) -> DataFrame:
    chosen = asserted.select("company_id").withColumn("__sole", F.lit(True))
    old = lines.join(chosen, "company_id", "left").withColumn("is_primary", F.col("is_primary") & F.col("__sole").isNull()).drop("__sole")
    return old.unionByName(asserted, allowMissingColumns=True)


def fetch_listing(listings: DataFrame) -> DataFrame:
    """The US line to ask a US provider about, and whether its silence means anything."""
    off = F.coalesce(F.col("mic") != "OOTC", F.lit(False))
    points = F.when(off, 100).otherwise(0) + F.when(F.col("security_kind") == "adr", 30).when(F.col("security_kind") == "ordinary", 20).otherwise(0) + F.when(F.col("is_primary"), 10).otherwise(0) + F.col("confidence").cast("double") * 10
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(points.desc(), "id"))
    return listings.filter("is_us").withColumn("place", place).filter("place = 1").drop("place").withColumn("silence_counts", off)


def top_symbols(listings: DataFrame, n: int = 3) -> DataFrame:
    """Up to n distinct qualified symbols of each company, best first; lines that can't be qualified are left out."""
    off = F.coalesce(F.col("mic") != "OOTC", F.lit(False))
    points = F.when(off, 100).otherwise(0) + F.when(F.col("is_primary"), 40).otherwise(0) + F.when(F.col("security_kind") == "ordinary", 20).when(F.col("security_kind") == "adr", 15).otherwise(0) + F.col("confidence").cast("double") * 10
    query = F.when(F.col("is_us"), F.nullif(F.col("symbol"), F.lit(""))).otherwise(exchange.market_symbol(F.col("exchange_code"), F.col("symbol")))
    scored = listings.withColumns({"query": query, "points": points}).filter("query IS NOT NULL")
    once = scored.groupBy("company_id", "query").agg(F.max(F.struct("points", (-F.col("id")).alias("k"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("b.points").desc(), F.col("b.k").desc()))
    return once.withColumn("place", place).filter(F.col("place") <= n).select("company_id", "query", "place")


def first_per_symbol(listings: DataFrame) -> DataFrame:
    """Symbol to company, the company with the smallest id where several share it."""
    return listings.groupBy(F.upper("symbol").alias("symbol")).agg(F.min("company_id").alias("company_id"))


def us_symbols(listings: DataFrame) -> DataFrame:
    """Distinct upper-case US symbols of each company, in order."""
    return listings.groupBy("company_id").agg(F.array_sort(F.collect_set(F.when(F.col("is_us"), F.upper("symbol")))).alias("symbols"))


def story_mentions(stories: DataFrame, companies: DataFrame) -> DataFrame:
    """Pairs (story_id, company_id) where the story names the company exactly.

    A name of several words is met as a whole: of the places where a story has a first word of
    names, the phrases as long as such names are joined to them.  One of a single word is met by that word,
    which is the name.  So no story meets a company whose name it does not have, however many names
    begin alike.
    """
    from pressline.functions import relevance

    phrase = F.array_join("tokens", " ")
    who = companies.select(F.col("id").alias("company_id"), "company_name", names.name_tokens(F.col("company_name")).alias("tokens")).select("company_id", "company_name", F.get("tokens", 0).alias("word"), F.size("tokens").alias("n"), phrase.alias("phrase")).filter(F.length("phrase") >= 4)
    words = F.filter(F.split(F.regexp_replace(F.array_join(relevance.story_words(F.col("text")), " "), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    told = stories.select("story_id", "text", words.alias("words"))
    single = told.select("story_id", "text", F.explode(F.array_distinct("words")).alias("word")).join(who.filter("n = 1"), "word").filter(relevance.mentions_exactly(F.col("company_name"), F.col("text")))
    several = who.filter("n > 1")
    heads = several.groupBy("word").agg(F.collect_set("n").alias("lengths"))
    met = told.select("story_id", "words", F.posexplode("words").alias("at", "word")).join(heads, "word")
    phrases = met.select("story_id", F.explode(F.transform("lengths", lambda n: F.array_join(F.slice("words", F.col("at") + 1, n), " "))).alias("phrase")).distinct()
    return single.select("story_id", "company_id").unionByName(phrases.join(several.select("phrase", "company_id"), "phrase").select("story_id", "company_id")).distinct()


def unseen_lines(companies: DataFrame, arrays: DataFrame) -> DataFrame:
    """Known listings that are not among a resolution's parallel arrays (company_id, exchanges, symbols)."""
    kept = arrays.select("company_id", F.inline(F.arrays_zip(F.col("exchanges").alias("exchange_code"), F.col("symbols").alias("symbol"))))
    return companies.join(kept, ["company_id", "exchange_code", "symbol"], "left_anti")
