"""Paged sources: saved pages of a provider's windows, read in batch or as a stream.

A collector saves each page that a provider answers below
``provider=/request=/from=/to=/phase=/page=``: a window from ``from`` to ``to`` (compact UTC
times) of one request (``all``, or a company), its phases one after the other (news before
removals), pages counted from 0.  Pages that follow each other may lie in a bundle
``pages=<first>-<last>`` instead, Parquet files of page and payload; :func:`save` writes these, so that
names and files grow with the bundles and not with the pages.  A page that was saved twice counts once.
:class:`PagedEvidence` is the data source of these folders, registered as ``paged_evidence``: a row for
each page with its payload.

* In batch every (provider, request) is planned by names alone: splits of some PAGES_A_SPLIT files, and
  of ROWS_A_SPLIT pages at most if these are more than one file.
* As a stream an offset is the place ``{from, to, page, phase}`` that is read next, as in the
  checkpoints of the sources (:func:`pressline.functions.control.window_of`).  The collector goes on to
  a page, phase or window only when it has the one before, so the next offset follows from the
  names of folders; a missing page holds the stream until it is there.  The reader keeps nothing:
  a restarted query plans the same pages for the same offsets.

What a page means is the work of Catalyst: :func:`pages_of` parses payloads, :func:`windows` tells
for each window whether it is complete, where reading goes on and what is wrong with it, and
:func:`articles` merges the pages of a window into articles once each.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "paged_evidence"
SCHEMA = "provider string, request string, from string, to string, phase string, page int, payload string"
PAGES_A_SPLIT = 32
ROWS_A_SPLIT, BUNDLE_PAGES, BATCH_PAGES = 2000, 250, 50
PHASES = ("news", "removed")
TIME = "yyyyMMdd'T'HHmmss'Z'"
_FOLDERS = ("provider", "request", "from", "to", "phase", "page")

# Results that a source gives for one window at most, rows of a page at most, and pages of a company's window.
MOST_FOUND, MOST_ROWS, COMPANY_PAGES = 20_000, 100, 3


class Pages(InputPartition):
    """Places, each with the first and last of its pages that are read."""

    def __init__(self, places: list[tuple]):
        super().__init__(places)
        self.places = places


class _Folder:
    """Names and contents of the pages below a path, local or of a file system that Arrow knows."""

    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.path))
        return fs.LocalFileSystem(), self.path

    def places(self, provider: str | None = None, request: str | None = None) -> list[tuple[str, ...]]:
        """(provider, request, from, to, phase, page) of the saved pages, in the order of the windows."""
        from pyarrow import fs

        system, root = self._open()
        below = "/".join([root, *([f"provider={provider}"] if provider else []), *([f"request={request}"] if provider and request else [])])
        found = set()
        for info in system.get_file_info(fs.FileSelector(below, recursive=True, allow_not_found=True)):
            parts = info.path[len(root) :].strip("/").split("/")
            if info.type != fs.FileType.File or parts[-1][:1] in "._" or len(parts) <= len(_FOLDERS):
                continue
            named = [p.partition("=")[2] for p, k in zip(parts, _FOLDERS[:5], strict=False) if p.startswith(k + "=")]
            page = _PAGES.fullmatch(parts[5])
            if len(named) == 5 and page:
                found.add((*named, page[1] or page[2]))
        return sorted(found, key=order)

    def _files(self, place: tuple[str, ...]):
        from pyarrow import fs

        system, root = self._open()
        last = f"{'pages' if '-' in place[5] else 'page'}={place[5]}"
        folder = "/".join([root, *(f"{k}={v}" for k, v in zip(_FOLDERS[:5], place[:5], strict=True)), last])
        return system, sorted(i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and i.base_name[:1] not in "._")

    def payload(self, place: tuple[str, ...]) -> str:
        system, files = self._files(place)
        texts = []
        for f in files:
            with system.open_input_stream(f) as stream:  # decompresses by the name's end
                texts.append(stream.read().decode("utf-8", "replace"))
        return "".join(texts)

    def bundle(self, place: tuple[str, ...], low: int, high: int):
        """Arrow batches of SCHEMA: the pages of a bundle from low to high."""
        import pyarrow as pa
        from pyarrow import parquet

        system, files = self._files(place)
        seen: set[int] = set()
        for f in files:
            with system.open_input_file(f) as stream:
                for batch in parquet.ParquetFile(stream).iter_batches(BATCH_PAGES, columns=["page", "payload"]):
                    kept = [low <= n <= high and not (n in seen or seen.add(n)) for n in batch.column("page").to_pylist()]
                    batch = batch.filter(pa.array(kept, pa.bool_()))
                    if batch.num_rows:
                        yield pa.RecordBatch.from_arrays([*(pa.array([v] * batch.num_rows, pa.string()) for v in place[:5]), batch.column("page").cast(pa.int32()), batch.column("payload").cast(pa.string())], names=[*_FOLDERS, "payload"])

    def rows(self, planned):
        for place, low, high in planned:
            if "-" in place[5]:
                yield from self.bundle(place, low, high)
            else:
                yield (*place[:5], low, self.payload(place))


_PAGES = re.compile("page=([0-9]+)|pages=([0-9]+-[0-9]+)")


def span(page: str) -> tuple[int, int]:
    """First and last page of a place: of one page, or of a bundle."""
    low, _, high = page.partition("-")
    return int(low), int(high or low)


def order(place: tuple[str, ...]) -> tuple:
    provider, request, start, end, phase, page = place
    return provider, request, start, end, PHASES.index(phase) if phase in PHASES else len(PHASES), phase, *span(page)


def planned(places: list[tuple[str, ...]], start: tuple | None = None, end: tuple | None = None) -> list[tuple]:
    """(place, first page, last page): each page of a phase from the first place in order that has it; of a stream, from the key start to before the key end."""
    out, of, done = [], None, -1
    for p in places:
        if p[:5] != of:
            of, done = p[:5], -1
        low, high = span(p[5])
        low, done, key = max(low, done + 1), max(done, high), order(p)[2:6]
        if (start and key < start[:4]) or (end and key > end[:4]):
            continue
        low = max(low, start[4]) if start and key == start[:4] else low
        high = min(high, end[4] - 1) if end and key == end[:4] else high
        if low <= high:
            out.append((p, low, high))
    return out


def splits(items: list[tuple]) -> list[Pages]:
    """Parts of what is planned: of one provider and request, bundles or single pages, up to PAGES_A_SPLIT files and ROWS_A_SPLIT pages."""
    out: list[Pages] = []
    kind, n = None, 0
    for place, low, high in items:
        of, more = (*place[:2], "-" in place[5]), high - low + 1
        if of == kind and len(out[-1].places) < PAGES_A_SPLIT and n + more <= ROWS_A_SPLIT:
            out[-1].places.append((place, low, high))
            n += more
        else:
            out.append(Pages([(place, low, high)]))
            kind, n = of, more
    return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.only = _Folder(options["path"]), (options.get("provider"), options.get("request"))

    def partitions(self):
        return splits(planned(self.folder.places(*self.only))) or [Pages([])]

    def read(self, partition):
        return self.folder.rows(partition.places)


class _Stream(DataSourceStreamReader):
    """The pages of one request of a provider; an offset is the place to read next."""

    def __init__(self, options):
        if not options.get("provider"):
            raise ValueError("a stream of pages is of one provider")
        self.folder, self.only = _Folder(options["path"]), (options["provider"], options.get("request", "all"))

    def initialOffset(self):  # noqa: N802 (the interface's name)
        return {"from": "", "to": "", "page": 0, "phase": PHASES[0]}

    def latestOffset(self):  # noqa: N802
        return after(self.folder.places(*self.only)) or self.initialOffset()

    def partitions(self, start, end):
        return splits(planned(self.folder.places(*self.only), _key(start), _key(end)))

    def read(self, partition):
        return self.folder.rows(partition.places)


def _key(offset: dict) -> tuple:
    phase = offset["phase"]
    return offset["from"], offset["to"], PHASES.index(phase) if phase in PHASES else len(PHASES), phase, int(offset["page"])


def after(places: list[tuple[str, ...]]) -> dict | None:
    """The offset behind the last page that can be read without leaving one out; None where there is none."""
    last, upto = None, -1
    for p in places:
        low, high = span(p[5])
        first = last is None or p[2:5] != last[2:5]
        if low > (0 if first else upto + 1):
            break  # a page is missing
        last, upto = p, high if first else max(upto, high)
    return last and {"from": last[2], "to": last[3], "page": upto + 1, "phase": last[4]}


class PagedEvidence(DataSource):
    """Options: path; provider and request (only these; a stream needs a provider and reads one request)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(self.options)


def read(spark: SparkSession, path: str, **only: str) -> DataFrame:
    """Saved pages in batch."""
    spark.dataSource.register(PagedEvidence)
    return spark.read.format(FORMAT).options(path=path, **only).load()


def read_stream(spark: SparkSession, path: str, provider: str, request: str = "all") -> DataFrame:
    spark.dataSource.register(PagedEvidence)
    return spark.readStream.format(FORMAT).options(path=path, provider=provider, request=request).load()


def save(pages: DataFrame, path: str) -> None:
    """Pages (of SCHEMA) as a collector saves them: bundles of up to BUNDLE_PAGES pages that follow each other."""
    of = _FOLDERS[:5]
    slotted = pages.select(*_FOLDERS, F.coalesce("payload", F.lit("")).alias("payload"), F.floor(F.col("page") / BUNDLE_PAGES).alias("slot"))
    run = F.col("page") - F.dense_rank().over(Window.partitionBy(*of, "slot").orderBy("page"))
    bundle = Window.partitionBy(*of, "slot", "run")
    named = slotted.withColumn("run", run).withColumn("pages", F.concat_ws("-", F.min("page").over(bundle).cast("string"), F.max("page").over(bundle).cast("string")))
    named.select(*of, "pages", "page", "payload").write.mode("append").partitionBy(*of, "pages").parquet(path)


PAYLOAD = "struct<error:struct<code:string,message:string>,meta:struct<found:bigint,returned:bigint,limit:bigint,page:bigint>,data:array<string>>"


def pages_of(pages: DataFrame) -> DataFrame:
    """Pages with found, page_limit, meta_page, error_code and rows (JSON texts); a payload may be an object with data, or an array, or an object of arrays."""
    is_list = F.trim("payload").startswith("[")
    grouped = F.flatten(F.map_values(F.from_json("payload", "map<string,array<string>>")))

    def fields(whole):
        meta = whole["meta"]
        rows = F.when(is_list, F.from_json("payload", "array<string>")).when(F.col("phase") == "removed", F.coalesce(whole["data"], grouped)).otherwise(whole["data"])
        return F.struct(meta["found"].alias("found"), meta["limit"].alias("page_limit"), meta["page"].alias("meta_page"), whole["error"]["code"].alias("error_code"), rows.alias("rows"))

    # one parse a page: what a generator gives is not put together with what reads it
    parsed = F.transform(F.array(F.when(~is_list, F.from_json("payload", PAYLOAD))), fields)
    return pages.select(*_FOLDERS, F.inline(parsed))


def _problem(default_limit: int) -> Column:
    """What makes a page unusable; null of a sound one."""
    c = F.col
    code = F.coalesce(c("error_code"), F.lit(""))
    limit = F.coalesce("page_limit", F.lit(default_limit))
    counted = c("found").isNotNull() | c("page_limit").isNotNull() | c("meta_page").isNotNull()
    odd = counted & ((limit <= 0) | (limit > MOST_ROWS) | ~c("meta_page").eqNullSafe((c("page") + 1).cast("long")) | (F.coalesce(c("found"), F.lit(-1)) < 0))
    return (
        F.when(code.rlike("(?i)usage_limit|rate|quota"), "rate_limited")
        .when(code.rlike("auth|token|access"), "auth")
        .when(code != "", "upstream")
        .when(c("rows").isNull() | odd | (F.size("rows") > limit), "invalid_response")
        .when((c("found") > MOST_FOUND) | (c("page") * limit >= MOST_FOUND), "rate_limited")
    )


_WINDOW = ("provider", "request", "from", "to")


def windows(parsed: DataFrame, *, page_size: int = MOST_ROWS, phases: tuple[str, ...] = ("news",)) -> DataFrame:
    """A row for each window of pages_of: pages, n_rows, problem, complete, and where reading goes on (next_phase, next_page, watermark).

    Pages count up to the first missing or unsound one of the phases in their order.  A phase
    ends with a page that is not full, or with which all that was found is there; a window is
    complete with its last phase, and only then the watermark moves to its end.  problem is that
    of the page at which reading stopped, with next_* at that page, so it is read again.
    """
    limit = F.coalesce("page_limit", F.lit(page_size))
    size = F.size("rows")
    ends = (size < limit) | F.coalesce((F.col("page") + 1) * limit >= F.col("found"), F.lit(False))
    phase = reduce(lambda out, p: out.when(F.col("phase") == p[1], p[0]), enumerate(phases[1:], 1), F.when(F.col("phase") == phases[0], 0))
    rows = parsed.withColumns({"problem": _problem(page_size), "ends": ends, "at": phase, "n": F.when(F.col("rows").isNotNull(), size).otherwise(0)}).filter("at IS NOT NULL")
    w = Window.partitionBy(*_WINDOW).orderBy("at", "page")
    before = F.lag(F.struct("at", "page", F.coalesce("problem", F.lit("")).alias("problem"), "ends")).over(w)
    prev = before
    follows = F.when(prev.isNull(), (F.col("at") == 0) & (F.col("page") == 0)).when(F.col("at") == prev["at"], (F.col("page") == prev["page"] + 1) & ~prev["ends"]).otherwise((F.col("at") == prev["at"] + 1) & (F.col("page") == 0) & prev["ends"])
    rows = rows.withColumn("breaks", ~(F.coalesce(follows, F.lit(False)) & F.coalesce(prev["problem"] == "", F.lit(True))))
    rows = rows.withColumn("broken", F.max("breaks").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sound = ~F.col("broken") & F.col("problem").isNull()
    read = F.when(sound, F.struct("at", "page", "ends"))
    out = rows.groupBy(*_WINDOW).agg(F.count_if(sound).alias("pages"), F.coalesce(F.sum(F.when(sound, F.col("n"))), F.lit(0)).alias("n_rows"), F.max(read).alias("last"), F.min(F.when(~F.col("broken") & F.col("problem").isNotNull(), F.struct("at", "page", "problem"))).alias("stop"))
    last, final = F.col("last"), len(phases) - 1
    complete = F.coalesce((last["at"] == final) & last["ends"], F.lit(False))
    names = F.array(*(F.lit(p) for p in phases))
    next_at = F.when(last.isNull(), 0).otherwise(last["at"] + last["ends"].cast("int"))
    next_page = F.when(last.isNull() | last["ends"], 0).otherwise(last["page"] + 1)
    return out.select(*_WINDOW, "pages", "n_rows", F.col("stop.problem").alias("problem"), complete.alias("complete"), F.when(~complete, F.get(names, next_at)).alias("next_phase"), F.when(~complete, next_page).alias("next_page"), F.when(complete, F.col("to")).alias("watermark"))


def joined(states: DataFrame, *by: Column) -> DataFrame:
    """Rows of windows (of one phase) put together by the columns in by: pages, n_rows, problem, complete, next_page.

    A source gives MOST_FOUND results for a window at most, so a collector narrows a window that has
    more.  The parts are read in their order and each goes on where the one before ended: what
    counts ends with the first that is open or does not follow.  next_page counts all parts' pages.
    """
    named = states.select(*by, "from", "to", "pages", "n_rows", "problem", "complete", "next_page")
    names = named.columns[: len(by)]
    w = Window.partitionBy(*names).orderBy("from", "to")
    open_before = F.max(~F.col("complete")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.lag("to").over(w) != F.col("from")
    rows = named.withColumns({"open": open_before, "gap": gap}).withColumn("gap", F.max("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counts = ~F.coalesce("open", F.lit(False)) & ~F.coalesce("gap", F.lit(False))
    sum_of = lambda c: F.sum(F.when(counts, c))
    out = rows.groupBy(*names).agg(sum_of(F.col("pages")).alias("pages"), sum_of(F.col("n_rows")).alias("n_rows"), F.max(F.when(counts, F.col("problem"))).alias("problem"), F.bool_and(counts & F.col("complete")).alias("complete"), sum_of(F.when(F.col("complete"), F.col("pages")).otherwise(F.col("next_page"))).alias("next_page"))
    return out.withColumn("next_page", F.when(~F.col("complete"), F.col("next_page")))


def checkpoint(state: Column | None = None) -> Column:
    """The JSON checkpoint of a row of windows, as control.window_of reads it."""
    iso = lambda c: F.date_format(F.to_timestamp(c, TIME), "yyyy-MM-dd'T'HH:mm:ssXXX")
    window = F.to_json(F.struct(F.lit("window").alias("kind"), iso(F.col("from")).alias("from"), iso(F.col("to")).alias("to"), F.col("next_page").alias("page"), F.col("next_phase").alias("phase")))
    return F.when(F.col("complete"), F.to_json(F.struct(iso(F.col("watermark")).alias("watermark")))).otherwise(window)


def articles(parsed: DataFrame, row_schema: str, key: str) -> DataFrame:
    """The rows of all sound pages, once for each key of a request (a page or an overlap repeats rows; the latest window's, in its first place, counts)."""
    sound = parsed.filter(_problem(MOST_ROWS).isNull())
    one = sound.select(*_WINDOW, "phase", "page", F.posexplode("rows").alias("place", "row")).withColumn("a", F.from_json("row", row_schema))
    latest = F.row_number().over(Window.partitionBy("provider", "request", F.col(f"a.{key}")).orderBy(F.col("from").desc(), F.col("to").desc(), "phase", "page", "place"))
    return one.withColumn("__n", latest).filter("__n = 1").select(*_WINDOW, "phase", "page", "a.*")


def company_search(parsed: DataFrame, wanted: DataFrame, row_schema: str) -> dict[str, DataFrame]:
    """Searches of companies (request, symbols): outcomes, a row for each window of a request, and confirmed articles.

    At most COMPANY_PAGES pages are merged.  A window is complete with an empty page, when all that was
    found is there, or, where the source does not count, with a page that is not full.  An article
    counts only if one of its entities has a symbol that was asked for; one that lacks link, title
    or time doesn't.  outcome: rate_limited or refused by the source's error, no_news if nothing is
    confirmed in a complete window, else ok.
    """
    w = Window.partitionBy(*_WINDOW).orderBy("page")
    so_far = F.sum(F.coalesce(F.size("rows"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    limit = F.when(F.col("page_limit") > 0, F.col("page_limit")).otherwise(MOST_ROWS)
    n = F.greatest(F.coalesce(F.size("rows"), F.lit(0)), F.lit(0))
    done = (n == 0) | F.coalesce(so_far >= F.col("found"), F.lit(False)) | (F.col("found").isNull() & (n < limit))
    rows = parsed.filter(F.col("page") < COMPANY_PAGES).withColumns({"bad": F.coalesce("error_code", F.lit("")) != "", "done": done, "gap": F.col("page") != F.row_number().over(w) - 1})
    # a page behind a complete, failed or missing one was never asked for
    over = F.coalesce(F.max(F.col("bad") | F.col("done")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) | F.col("gap")
    rows = rows.withColumn("over", over).filter("NOT over")
    symbols = wanted.select("request", F.transform("symbols", lambda s: F.upper(s)).alias("symbols"))
    each = rows.filter("NOT bad").select(*_WINDOW, "page", F.posexplode("rows").alias("place", "row")).withColumn("a", F.from_json("row", row_schema))
    named = each.join(symbols, "request").filter(F.exists("a.entities", lambda e: F.array_contains("symbols", F.upper(e["symbol"]))))
    whole = F.coalesce(F.col("a.url") != "", F.lit(False)) & F.coalesce(F.col("a.title") != "", F.lit(False)) & F.try_to_timestamp("a.published_at").isNotNull()
    found = named.filter(whole).select(*_WINDOW, "page", "place", "a.*")
    counts = found.groupBy(*_WINDOW).agg(F.count(F.lit(1)).alias("n_articles"))
    state = rows.groupBy(*_WINDOW).agg(F.count(F.lit(1)).alias("pages"), F.max("done").alias("complete"), F.max(F.when(F.col("bad"), F.col("error_code"))).alias("error_code"))
    state = state.join(counts, list(_WINDOW), "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    outcome = F.when(F.col("error_code").rlike("(?i)usage_limit|rate|quota"), "rate_limited").when(F.col("error_code").isNotNull(), "refused").when(F.col("complete") & (F.col("n_articles") == 0), "no_news").otherwise("ok")
    complete = F.col("complete") & F.col("error_code").isNull()
    return {"outcomes": state.select(*_WINDOW, "pages", outcome.alias("outcome"), complete.alias("complete"), "n_articles"), "articles": found}

