"""The cascade of resolution against plain loops in its order; similarity comes from the library's own function, tested elsewhere."""

import pytest
from pyspark.sql import functions as F

from pressline.functions import exchange, names
from pressline.operators import cascade
from pressline.sources import files

COMPANIES = [
    (1, "acme", "Acme Steel Works", None, True),  # directory, no hint
    (2, "beta", "Beta Optics plc", "LSE", False),  # foreign hint: the venue, not the home namesake
    (3, "GAMMA_X", "Gamma Foods Inc", "NYSE", True),  # directory under another spelling
    (4, "DELT", "Delta Construction Group", "LSE", False),  # rename on the venue
    (5, "EPS", "Epsilon Mining", "LSE", False),  # collision on the venue, then the bare ticker elsewhere
    (6, "ZETA", "Zeta Water Systems", "XTRA", False),  # foreign hint, only in the home directory
    (7, "ETA", "Eta Telekom Tavkozlesi Nyrt", None, False),  # name search by two words
    (8, "THETA", "Theta Payments", "NYSE", True),  # nothing: asserted
    (9, "IOTA", "Iota Holdings Partners", "NOWHERE", False),  # unknown hint: bare ticker before the directory
    (10, "0E64", "Kappa Catering", "LSE", False),  # a board code that nobody can query: name search replaces it
    (11, "LAM", "Lambda Gas Works", "LSE", False),  # nothing at all
    (12, "MU", "Mu Rail Freight", "XTRA", False),  # second hinted code
    (13, None, "Nu Nameless", None, None),
    (14, "XI", "Xi Paper Mills", "XTRA", True),  # bare ticker, option first, near ties by quality
    (15, "OMI", "Omicron Paper Mills", None, True),  # ids only: no hint
]
DIRECTORY = [
    ("ACME", "ACME STEEL WORKS INC", "XNYS", "SC1"), ("ACMEY", "ACME STEEL WORKS ADR", "OOTC", "SC1B"), ("ACMB", "OTHER NAME", "XNAS", "SC1"),
    ("BETA", "BETA OPTICS INC", "XNYS", "SC2"), ("GAMMA.X", "GAMMA FOODS", "XNAS", ""), ("ZETA", "ZETA WATER SYSTEMS", "OOTC", "SC6"),
    ("EPS", "EPSOM SALTS", "XNYS", "SC5"), ("IOTA", "IOTA HOLDINGS PARTNERS", "XNYS", "SC9"), ("XIPM", "XI PAPER MILLS", "XNYS", "SC14B"),
    ("ACME", "ACMEX", "XNAS", ""), ("KAPPY", "KAPPA CATERING", "OOTC", ""),
]
IDS = [
    ("BETA", "LN", "BETA OPTICS PLC", "Common Stock", "Common Stock", "SC2L"), ("DELT", "LN", "DELTA INFRASTRUCTURE GROUP", "Common Stock", "Common Stock", "SC4"),
    ("EPS", "LN", "SOMETHING ELSE", "Common Stock", "Common Stock", "S"), ("EPS", "SS", "EPSILON MINING AB", "Common Stock", "Common Stock", "SC5S"),
    ("ETAQ", "BU", "ETA TELEKOM", "Common Stock", "", "SC7"), ("ETAO", "GY", "ETA TELEKOM", "Option", "Option", "SC7"), ("IOTA", "SS", "IOTA HOLDINGS PARTNERS AB", "Common Stock", "Common Stock", "SC9S"),
    ("0E64", "LN", "KAPPA CATERING", "Common Stock", "Common Stock", "SC10"), ("KAP", "AV", "KAPPA CATERING", "Common Stock", "Common Stock", "SC10"), ("MU", "GR", "MU RAIL FREIGHT", "Common Stock", "Common Stock", "SC12"),
    ("XI", "GY", "XI PAPER MILLS 2030", "Option", "Option", "o"), ("XI", "SS", "XI PAPER MILLS", "Common Stock", "Common Stock", "SC14"), ("XI", "US", "XI PAPER MILLS LTD", "Common Stock", "Common Stock", "SC14"),
    ("OMI", None, "OMICRON PAPER MILLS", "Common Stock", "Common Stock", "SC15"), ("LAMB", "LN", None, None, None, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    companies = spark.createDataFrame(COMPANIES, "id long, ticker string, company_name string, exchange_hint string, is_us_listed boolean")
    directory = files.us_directory(spark.createDataFrame([(*r, "F" + r[0]) for r in DIRECTORY], "symbol string, description string, mic string, share_class string, figi string"), least=1)
    rows = [(i, *r, f"G{i}", None) for i, r in enumerate(IDS)]
    ids = spark.createDataFrame(rows, "place long, symbol string, exchange_code string, name string, type1 string, type2 string, share_class string, figi string, composite string")
    return companies, directory, ids


@pytest.fixture(scope="module")
def facts(spark, tables):
    """Similarity, shared words, normal forms and venue facts, looked up by the plain version."""
    left = [c[2] for c in COMPANIES]
    right = sorted({d[1] for d in DIRECTORY} | {r[2] for r in IDS if r[2]})
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    pairs = a.crossJoin(b).select("a", "b", names.name_similarity(F.col("a"), F.col("b")).alias("s"), names.shared_tokens(F.col("a"), F.col("b")).alias("t")).collect()
    keys = spark.createDataFrame([(x,) for x in {*left, *right}], "n string").select("n", names.normalize_name(F.col("n")).alias("k"), names.home_country(F.col("n")).alias("h")).collect()
    hints = tables[0].select("id", exchange.candidate_codes(F.col("exchange_hint")).alias("codes"), exchange.hint_field(F.col("exchange_hint"), "country").alias("country"), exchange.hint_field(F.col("exchange_hint"), "code").alias("code")).collect()
    home = {r["n"]: r["h"] for r in keys}
    ids = tables[2].crossJoin(spark.createDataFrame([(x,) for x in left], "c string")).withColumn("h", names.home_country(F.col("c")))
    lines = ids.select("place", "c", exchange.listing_quality(F.col("exchange_code"), F.col("symbol"), F.col("figi"), F.col("composite"), F.col("h")).alias("q"), exchange.is_equity_line(F.col("type1"), F.col("type2")).alias("e"), exchange.market_symbol(F.col("exchange_code"), F.col("symbol")).alias("m")).collect()
    return {"sim": {(r["a"], r["b"]): r["s"] for r in pairs}, "shared": {(r["a"], r["b"]): r["t"] for r in pairs}, "key": {r["n"]: r["k"] for r in keys}, "hint": {r["id"]: r for r in hints}, "line": {(r["place"], r["c"]): r for r in lines}, "home": home}


def plain(facts):
    """Company -> (how, symbol, exchange code), one company and one pass after the other."""

    def best(places, name):
        found = [(facts["sim"][name, IDS[p][2]], facts["line"][p, name]["q"], p) for p in places if IDS[p][2] and facts["line"][p, name]["e"]]
        found = [f for f in found if f[0] >= 0.6 and f[1] >= 0]
        if not found:
            return None
        top = max(f[0] for f in found)
        return sorted((f for f in found if f[0] > top - 0.05), key=lambda f: (-f[1], -f[0], f[2]))[0][2]

    out = {}
    for i, ticker, name, hint, _ in COMPANIES:
        h = facts["hint"][i]
        t = (ticker or "").strip().upper()
        spellings = [v for v in dict.fromkeys([t, t.replace("_", "."), t.replace(".", "_")]) if v]
        rows = sorted((-facts["sim"][name, d[1]], spellings.index(d[0]), n) for n, d in enumerate(DIRECTORY) if d[0] in spellings and facts["sim"][name, d[1]] >= 0.6)
        home = DIRECTORY[rows[0][2]] if rows else None
        record = how = None
        local = not hint or h["country"] == "US"
        if local and home:
            out[i] = ("directory", home[0], "US")
            continue
        same = [p for p, r in enumerate(IDS) if r[0] == t]
        for code in h["codes"] or []:
            there = [p for p in same if IDS[p][1] == code]
            record, how = best(there, name), "scoped_id"
            if record is None and there and IDS[there[0]][2] and facts["shared"][name, IDS[there[0]][2]] >= 1:
                record, how = there[0], "rename"
            if record is not None:
                break
        if not h["codes"]:
            record, how = best(same, name), "bare_ticker"
        if record is None and home:
            out[i] = ("directory_any_hint", home[0], "US")
            continue
        if record is None:
            record, how = best(same, name), "bare_ticker"
        if record is None or facts["line"][record, name]["m"] is None:
            key = facts["key"][name]
            words = key.split()
            queries = [q for q in dict.fromkeys([name.lower(), key, " ".join(words[:3]), " ".join(words[:2])]) if q]
            found = None
            for q in queries:
                answer = [p for p, r in enumerate(IDS) if r[2] and q in {r[2].lower(), facts["key"][r[2]], " ".join(facts["key"][r[2]].split()[:3]), " ".join(facts["key"][r[2]].split()[:2])}]
                for scope in (h["code"], None):
                    found = best([p for p in answer if scope is None or IDS[p][1] == scope], name) if found is None else found
                if found is not None:
                    record, how = found, "name_search"
                    break
        if record is not None:
            out[i] = (how, IDS[record][0], IDS[record][1])
    return out


def test_cascade_follows_its_passes(tables, facts):
    found = cascade.primaries(*tables)
    got = {r["company_id"]: (r["how"], r["symbol"], r["exchange_code"]) for r in found.collect()}
    assert got == plain(facts)
    assert {i: h for i, (h, _, _) in got.items()} == {1: "directory", 2: "scoped_id", 3: "directory", 4: "rename", 5: "bare_ticker", 6: "directory_any_hint", 7: "name_search", 9: "bare_ticker", 10: "name_search", 12: "scoped_id", 14: "rename", 15: "name_search"}
    assert all(r["confidence"] == cascade.CONFIDENCE[r["how"]] for r in found.collect())


def test_lines_of_resolved_companies(tables):
    rows = cascade.resolve(*tables)
    status, every = cascade.status(rows), rows.filter("symbol IS NOT NULL")
    how = {r["company_id"]: (r["how"], r["resolution_status"]) for r in status.collect()}
    assert how[8] == ("asserted_us", "resolved") and how[11] == (None, "unresolved") and how[13] == (None, "unresolved")
    got = {}
    for r in every.collect():
        got.setdefault(r["company_id"], {})[r["exchange_code"], r["symbol"]] = (round(r["confidence"], 4), r["is_primary"])
    assert got[1] == {("US", "ACME"): (0.95, True), ("US", "ACMEY"): (0.75, False), ("US", "ACMB"): (0.9, False)}
    assert got[4] == {("LN", "DELT"): (0.6, True)}
    assert got[2] == {("LN", "BETA"): (0.95, True), ("US", "BETA"): (0.75, False)}
    assert got[8] == {("US", "THETA"): (0.5, True)}
    assert got[10][("US", "KAPPY")] == (0.7, False)  # no more certain than the search that it rests on
    assert all(sum(p for _, p in lines.values()) == 1 for lines in got.values())
    assert 11 not in got and 13 not in got


def test_empty_tables(spark, tables):
    companies, directory, ids = tables
    assert cascade.primaries(companies.limit(0), directory, ids).collect() == []
    rows = cascade.resolve(companies, directory.filter("false"), ids.limit(0)).collect()
    assert {r["company_id"]: r["symbol"] for r in rows} == {c[0]: "THETA" if c[0] == 8 else None for c in COMPANIES}


def join_rows(df):
    """The rows that each join of an executed frame gave."""
    told, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        nodes += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name:
            told.append(node.metrics().apply("numOutputRows").value())
    return told


def test_many_companies_and_securities_of_one_name_make_no_pairs(spark):
    n = F.col("id")
    companies = cascade.hinted(spark.range(400).select("id", F.concat(F.lit("T"), n.cast("string")).alias("ticker"), F.lit("Red Widget Works").alias("company_name"), F.when(n % 2 == 0, "LSE").alias("exchange_hint"), F.lit(False).alias("is_us_listed")))
    ids = spark.range(400).select(n.alias("place"), F.concat(F.lit("S"), n.cast("string")).alias("symbol"), F.when(n % 2 == 0, "GY").otherwise("LN").alias("exchange_code"), F.lit("Red Widget Works").alias("name"), F.lit("Common Stock").alias("type1"), F.when(n < 4, "Option").otherwise("Common Stock").alias("type2"), F.concat(F.lit("F"), n.cast("string")).alias("figi"), F.lit(None).cast("string").alias("composite"), F.lit("").alias("share_class"), F.lit("red widget works").alias("name_key"))
    out = cascade.by_name(companies, ids).select("company_id", "symbol")
    assert sorted(tuple(r) for r in out.collect()) == [(i, "S5" if i % 2 == 0 else "S4") for i in range(400)]
    assert max(join_rows(out)) <= 1000


def test_statuses_are_those_of_all_lines(tables):
    want = sorted(map(str, cascade.status(cascade.resolve(*tables)).collect()))
    assert sorted(map(str, cascade.statuses(*tables).collect())) == want


def test_lines_of_names_that_do_not_agree_are_not_joined(spark):
    """The name of a rename finds none of the many directory rows of that name."""
    companies = spark.range(30).select("id", F.lit("DELT").alias("ticker"), F.lit("Delta Construction Group").alias("company_name"), F.lit("LSE").alias("exchange_hint"), F.lit(False).alias("is_us_listed"))
    directory = files.us_directory(spark.range(100).select(F.concat(F.lit("X"), F.col("id").cast("string")).alias("symbol"), F.lit("DELTA INFRASTRUCTURE GROUP").alias("description"), F.lit("XNYS").alias("mic"), F.lit("").alias("share_class"), F.lit("F").alias("figi")), least=1)
    ids = spark.createDataFrame([(0, "DELT", "LN", "DELTA INFRASTRUCTURE GROUP", "Common Stock", "Common Stock", None, "G", None)], "place long, symbol string, exchange_code string, name string, type1 string, type2 string, share_class string, figi string, composite string")
    out = cascade.resolve(companies, directory, ids).select("company_id", "how", "exchange_code", "symbol")
    assert sorted(tuple(r) for r in out.collect()) == [(i, "rename", "LN", "DELT") for i in range(30)]
    assert max(join_rows(out)) <= 1000
