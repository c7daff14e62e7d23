"""Source tiers, name verification and relevance scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.names import name_tokens, normalize_name
from pressline.functions.text import fold_accents

# Publishers by tier, tried in this order.
TIERS = (
    (1, r"\b(reuters|bloomberg|associated press|^ap$|dow jones|wall street journal|wsj|financial times|\bft\b|nikkei|handelsblatt|les echos|el pais|the times|new york times|nytimes|washington post|guardian|bbc|cnbc|npr|axios|politico)\b"),
    (2, r"\b(marketwatch|barron|investor's business daily|investors business daily|forbes|fortune|business insider|the economist|morningstar|investing\.com|reuters events|globe and mail|south china morning post|straits times|economic times|business standard|livemint|handelsbanken)\b"),
    (3, r"\b(yahoo|seeking ?alpha|benzinga|zacks|motley fool|simply wall st|tipranks|insider monkey|gurufocus|chartmill|fintel|stocktwits|kalkine|scanx|marketscreener|tradingview|newsfile|globe ?newswire|business ?wire|pr ?newswire|accesswire)\b"),
)
# The patterns of the one-off back-fill, which have no word boundaries.
BACKFILL = (
    (1, "(reuters|bloomberg|associated press|dow jones|wall street journal|wsj|financial times|nikkei|handelsblatt|new york times|nytimes|washington post|guardian|bbc|cnbc|npr|axios|politico)"),
    (2, r"(marketwatch|barron|investor's business daily|forbes|fortune|business insider|economist|morningstar|investing\.com|globe and mail|south china morning post|straits times|economic times|business standard|livemint)"),
)
# Names that are everyday words.
AMBIGUOUS = [
    "kid", "move", "auto", "safari", "admiral", "gap", "next", "shell", "orange", "apple", "amazon", "target",
    "sound", "future", "capital", "national", "general", "united", "american", "global", "first", "premier",
    "pioneer", "summit", "eagle", "phoenix", "atlas", "titan", "delta", "alpha", "omega", "vantage", "spark", "core",
    "edge", "peak", "bridge", "harbour", "harbor", "crown", "royal", "star", "sun", "moon", "river", "field", "stone",
    "iron", "steel", "gold", "silver", "booking", "partners", "mosaic", "advance", "liberty", "heritage", "legacy",
    "frontier", "cardinal", "corning", "public", "middle", "graphic", "element",
]
# Fixed value: words that show an article to be about business.
FINANCE = r"\b(shares?|stock|stocks|equity|earnings|revenue|profit|loss|guidance|forecast|dividend|buyback|acquisition|acquires?|merger|takeover|ipo|listing|delisting|quarterly|q[1-4]|fiscal|results|outlook|analyst|rating|upgrade|downgrade|price target|market cap|ceo|cfo|chairman|board|nasdaq|nyse|lse|ftse|dax|nikkei|investors?|shareholders?|trading|valuation|bond|debt|financing|contract|contract award|regulator|antitrust|sec filing|customer|supplier|deal|stake|funding|invest(?:ment|or)?|sales|layoffs|factory|plant|expansion|rival|competitor|launch)\b"
FLOOR = 0.35


def source_tier(source: Column) -> Column:
    """1 to 3; 3 for null, blank and unknown sources."""
    out = F.lit(3)
    for tier, pattern in reversed(TIERS):
        out = F.when(source.rlike("(?i)" + pattern), tier).otherwise(out)
    return out


def backfilled_tier(source: Column, stored: Column) -> Column:
    """Stored tier after the one-off back-fill."""
    first = F.when(source.rlike("(?i)" + BACKFILL[0][1]), 1).otherwise(stored)
    return F.when((first == 3) & source.rlike("(?i)" + BACKFILL[1][1]), 2).otherwise(first)


def story_text(headline: Column, summary: Column) -> Column:
    return F.concat(headline, F.lit(" "), F.coalesce(summary, F.lit("")))


def story_words(text: Column) -> Column:
    """Words of a story, folded as company names are (but apostrophes and contractions stay as they are)."""
    return F.split(F.lower(F.regexp_replace(fold_accents(text), "&", "")), "[^a-z0-9_]+")


def verify_name(company: Column, headline: Column, summary: Column) -> tuple[Column, Column]:
    """Does the story plausibly concern the company?  The verdict and its reason."""
    text = story_text(headline, summary)
    tokens = F.filter(name_tokens(company), lambda t: F.length(t) >= 2)
    words = story_words(text)
    present = F.size(F.filter(tokens, lambda t: F.array_contains(words, t)))
    n, token = F.size(tokens), F.get(tokens, 0)
    business = text.rlike("(?i)" + FINANCE)
    kind = F.when(F.array_contains(F.array(*(F.lit(a) for a in AMBIGUOUS)), token) | (F.length(token) <= 2), "short or ambiguous").otherwise("distinctive")
    verified = F.when(n >= 2, present >= 2).otherwise((n == 1) & (present > 0) & business)
    reason = (
        F.when(n == 0, F.lit("company name has no distinctive tokens"))
        .when((n >= 2) & (present >= 2), F.format_string("matched %d/%d name tokens", present, n))
        .when(n >= 2, F.format_string("only %d/%d name tokens present", present, n))
        .when(present == 0, F.format_string('name "%s" not mentioned', token))
        .when(~business, F.format_string('single-word name "%s" with no financial context in the article', token))
        .otherwise(F.format_string('%s name "%s" with financial context', kind, token))
    )
    return F.coalesce(verified, F.lit(False)), reason


def mentions_exactly(company: Column, text: Column) -> Column:
    """Strict check for market-wide stories: the whole phrase, or a verified single word that is capitalised if it is an everyday one."""
    phrase = normalize_name(company)
    flat = F.concat(F.lit(" "), F.array_join(F.split(F.lower(F.regexp_replace(fold_accents(text), "&", "")), "[^a-z0-9]+"), " "), F.lit(" "))
    capital = F.concat(F.lit("(^|[^A-Za-z])"), F.initcap(phrase), F.lit(r"\b"))
    ambiguous = F.array_contains(F.array(*(F.lit(a) for a in AMBIGUOUS)), phrase)
    single = verify_name(company, text, F.lit(None).cast("string"))[0] & (~ambiguous | F.regexp(text, capital))
    return F.coalesce((F.length(phrase) >= 4) & F.when(phrase.contains(" "), flat.contains(F.concat(F.lit(" "), phrase, F.lit(" ")))).otherwise(single), F.lit(False))


def score(method: Column, company: Column, headline: Column, summary: Column, source: Column) -> tuple[Column, Column, Column]:
    """Stored relevance (0..1, two decimals), its reasons, and whether the link is verified."""
    verified, why = verify_name(company, headline, summary)
    native = method == "ticker"
    tier = source_tier(source)
    base = F.when(native, F.lit("0.90").cast("decimal(4,2)")).otherwise(F.lit("0.60").cast("decimal(4,2)"))
    bonus = F.when(tier == 1, F.lit("0.10").cast("decimal(4,2)")).when(tier == 3, F.lit("-0.05").cast("decimal(4,2)")).otherwise(F.lit("0.00").cast("decimal(4,2)"))
    ok = native | verified
    value = F.when(ok, F.least(F.greatest(base + bonus, F.lit(0).cast("decimal(4,2)")), F.lit(1).cast("decimal(4,2)"))).otherwise(F.lit(0).cast("decimal(4,2)")).cast("decimal(3,2)")
    reason = F.when(ok, F.concat_ws("; ", F.when(native, "ticker-native").otherwise(why), F.when(tier == 1, "primary source").when(tier == 3, "aggregator"))).otherwise(why)
    return value, reason, ok


def roundup_penalty(companies: Column) -> Column:
    """What an article loses at read time for being filed against many companies."""
    d = lambda x: F.lit(x).cast("decimal(3,2)")
    return F.when(companies >= 8, d("0.35")).when(companies >= 4, d("0.15")).otherwise(d("0.00"))


def effective_relevance(best: Column, companies: Column) -> Column:
    """Best stored relevance (0.9 without links) less the penalty, not below 0."""
    return F.greatest(F.lit(0.0), F.round(F.coalesce(best.cast("decimal(3,2)"), F.lit("0.90").cast("decimal(3,2)")) - roundup_penalty(companies), 2).cast("double"))
