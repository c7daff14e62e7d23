"""Company names as Column expressions: normal form, similarity, search form, ticker spellings."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.text import fold_accents

# Words that never tell two companies apart.
NOISE = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "cos", "ltd", "limited", "plc", "llc", "lp", "llp",
    "trust", "the", "companies", "sa", "sas", "sca", "se", "ag", "kgaa", "nv", "bv", "as", "asa", "ab", "oyj", "oy",
    "spa", "srl", "aps", "a", "s", "gmbh", "pcl", "tbk", "bhd", "pte", "pt", "abp", "hf", "ehf", "holding",
    "holdings", "hldgs", "hldg", "group", "grp", "groupe", "adr", "adrs", "ads", "gdr", "gdrs", "spon", "spons",
    "sponsored", "unspon", "unsponsored", "repr", "reptg", "represented", "reg", "registered", "regd", "shs",
    "shares", "share", "stk", "stock", "cl", "class", "series", "ser", "ord", "ordinary", "npv", "new", "unitary",
    "b", "c", "and", "of", "for",
]
# Contractions of reference sources.
ABBREVIATIONS = {
    "intl": "international", "intn": "international", "intnl": "international", "natl": "national",
    "amer": "american", "wash": "washington", "mfg": "manufacturing", "mfrs": "manufacturers", "inds": "industries",
    "indus": "industries", "svc": "services", "svcs": "services", "serv": "services", "tech": "technologies",
    "techs": "technologies", "technol": "technologies", "pharm": "pharmaceuticals", "pharma": "pharmaceuticals",
    "fin": "financial", "finl": "financial", "rlty": "realty", "ppty": "property", "prop": "properties",
    "comms": "communications", "comm": "communications", "sys": "systems", "labs": "laboratories",
    "entmt": "entertainment", "enterp": "enterprises", "dev": "development", "mgmt": "management",
}
# Names of one company that surface forms do not link.
ALIASES = (
    ("wabtec", "westinghouse air brake technologies"),
    ("muenchener rueckver", "munich reinsurance"),
    ("muenchener rueckversicherungs", "munich reinsurance"),
    ("novozymes", "novonesis"),
    ("adobe systems", "adobe"),
    ("acs actividades constr y srvcs", "acs actividades de construccion y servicios"),
    ("acs actividades constr y srvcs", "acs actividades cons y services"),
    ("acs actividades constr y srvcs", "acs actividades cons y serv"),
    ("novozymes", "novonesis novozymes"),
    ("l e lundbergforetagen publ", "lundbergs"),
    ("l e lundbergforetagen", "lundbergs"),
    ("construcciones y auxiliar de ferrocarriles", "caf"),
)
# Legal forms and the country they imply, first match wins.
LEGAL_FORMS = ((r"\bab\b|\bpubl\b", "SE"), (r"\ba/s\b|\baps\b", "DK"), (r"\basa\b", "NO"), (r"\boyj\b|\babp\b", "FI"), (r"\bspa\b|\bs\.p\.a\b|\bsrl\b", "IT"), (r"\bnv\b|\bn\.v\b|\bbv\b", "NL"), (r"\bag\b|\bgmbh\b|\bkgaa\b", "DE"), (r"\bplc\b", "GB"), (r"\bnyrt\b|\brt\b", "HU"))
MATCH_AT = 0.6


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def name_tokens(name: Column) -> Column:
    """Distinctive tokens of a name, in order."""
    t = F.regexp_replace(F.lower(fold_accents(name)), "&", "")
    t = F.regexp_replace(t, r"\.(com|net|org|io|ai|co)\b", "")
    t = F.regexp_replace(F.regexp_replace(t, "['’.]", ""), "[^a-z0-9]+", " ")
    table = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    words = F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(table, w), w))
    words = F.filter(words, lambda w: (w != "") & ~F.array_contains(_strings(NOISE), w))
    marker = (F.size(words) > 1) & (F.length(F.element_at(words, -1)) == 1)
    return F.when(marker, F.slice(words, 1, F.size(words) - 1)).otherwise(words)


def normalize_name(name: Column) -> Column:
    """Equality key of a company name; '' for null or blank names."""
    return F.coalesce(F.array_join(name_tokens(F.when(name != "", name)), " "), F.lit(""))


def key_of(name: str) -> str:
    """normalize_name of one string, for tables that are built on the driver."""
    folded = "".join(c for c in unicodedata.normalize("NFD", name) if not "̀" <= c <= "ͯ").lower().replace("&", "")
    folded = re.sub(r"['’.]", "", re.sub(r"\.(com|net|org|io|ai|co)\b", "", folded, flags=re.A))
    words = [ABBREVIATIONS.get(w, w) for w in re.sub("[^a-z0-9]+", " ", folded).split()]
    words = [w for w in words if w not in NOISE]
    return " ".join(words[:-1] if len(words) > 1 and len(words[-1]) == 1 else words)


@functools.cache
def _alias_keys() -> tuple[str, ...]:
    pairs = {(key_of(a), key_of(b)) for a, b in ALIASES}
    return tuple(sorted(f"{a}|{b}" for x, y in pairs for a, b in ((x, y), (y, x))))


def is_alias(left_key: Column, right_key: Column) -> Column:
    """Are two normal forms curated names of one company?"""
    return (left_key != "") & (right_key != "") & F.array_contains(_strings(_alias_keys()), F.concat(left_key, F.lit("|"), right_key))


def let(body, **columns: Column) -> Column:
    """body of named columns that are evaluated once, however often body uses them."""
    bound = F.struct(*(c.alias(k) for k, c in columns.items()))
    return F.get(F.transform(F.array(bound), lambda row: body(**{k: row[k] for k in columns})), 0)


def _shared(short: Column, long_: Column) -> Column:
    """Tokens of the shorter name that the longer one has, clipped ones at a discount."""

    def prefix(token, least):
        return F.exists(long_, lambda o: (F.length(o) >= least) & (o.startswith(token) | token.startswith(o)))

    def credit(token):
        clipped = F.when(token == F.element_at(short, -1), prefix(token, 3)).otherwise((F.size(short) >= 3) & (F.length(token) >= 4) & prefix(token, 4))
        return F.when(F.array_contains(long_, token), 1.0).when((F.length(token) < 3) | (F.size(short) < 2), 0.0).when(clipped, 0.85).otherwise(0.0)

    return F.aggregate(F.array_distinct(short), F.lit(0.0), lambda acc, t: acc + credit(t))


def _graded(shared: Column, na: Column, nb: Column) -> Column:
    fewer = F.least(na, nb)
    score = shared / fewer * 0.75 + shared / (na + nb - shared) * 0.25
    return (
        F.when(shared == 0, 0.0)
        .when((shared == fewer) & (fewer >= 2), F.least(F.lit(1.0), F.greatest(score, F.lit(0.75))))
        .when((shared <= 1) & ((na > 1) | (nb > 1)), F.least(score, F.lit(0.59)))
        .otherwise(F.least(F.lit(1.0), score))
    )


def _by_tokens(ta: Column, tb: Column) -> Column:
    left_first = F.size(ta) <= F.size(tb)
    sides = {"short": F.when(left_first, ta).otherwise(tb), "long_": F.when(left_first, tb).otherwise(ta)}
    counts = {"na": F.size(F.array_distinct(ta)), "nb": F.size(F.array_distinct(tb))}
    return let(lambda shared, na, nb: _graded(shared, na, nb), shared=let(_shared, **sides), **counts)


def key_similarity(a: Column, b: Column) -> Column:
    """0..1 for two normal forms; not symmetric where both have as many tokens, as the left one is then the shorter."""

    def of(a, b):
        same = (a == b) | (F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit("")))
        graded = let(_by_tokens, ta=F.split(a, " "), tb=F.split(b, " "))
        return F.when(is_alias(a, b), 1.0).when((a == "") | (b == ""), 0.0).when(same, 1.0).otherwise(graded)

    return let(of, a=a, b=b)


def name_similarity(left: Column, right: Column) -> Column:
    return key_similarity(normalize_name(left), normalize_name(right))


def shared_tokens(left: Column, right: Column) -> Column:
    """Number of distinctive tokens that two names share."""
    tokens = lambda n: F.filter(F.split(normalize_name(n), " "), lambda t: t != "")
    return F.size(F.array_intersect(tokens(left), tokens(right)))


def searchable_name(name: Column) -> Column:
    """Name for a news search: no brackets, no legal forms, case kept; the trimmed name if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"\|", " ")
    words = F.transform(F.split(t, r"[\s,]+"), lambda w: F.regexp_replace(w, r"[^A-Za-z0-9&.\-']", ""))
    kept = F.filter(words, lambda w: (w != "") & ~F.array_contains(_strings(NOISE), F.replace(F.lower(w), F.lit("."), F.lit(""))))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.trim(name), F.lit(""))


def ticker_variants(ticker: Column) -> Column:
    """The upper-case ticker, then its spellings with the other venue separator."""
    t = F.upper(F.trim(ticker))
    return F.filter(F.array_distinct(F.array(t, F.replace(t, F.lit("_"), F.lit(".")), F.replace(t, F.lit("."), F.lit("_")))), lambda v: v != "")


def home_country(name: Column) -> Column:
    """Country that the legal form implies; null if none does."""
    return F.coalesce(*(F.when(name.rlike("(?i)" + p), F.lit(c)) for p, c in LEGAL_FORMS))


_V2_SUFFIX = r"\s+(?:incorporated|inc|corporation|corp|plc|limited|ltd)$"


def issuer_key(name: Column) -> Column:
    """Strict form of an issuer's name: initials joined, punctuation out, one legal suffix off, share class kept."""
    t = F.regexp_replace(F.lower(name), r"\b([a-z])\.(?=[a-z](?:\.|\b))", "$1")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), _V2_SUFFIX, ""))
