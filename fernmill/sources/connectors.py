"""Pages, nearby places and browser renders as data sources of Spark.

``register(spark)`` names them for ``spark.read.format``: ``fernmill_pages``,
``fernmill_places`` and ``fernmill_renders``. Each reads a folder of Parquet
requests, plans its partitions from the files' row groups (or from its slots),
takes the filters that narrow what has to be asked, and asks from its tasks.

Options they share:

* ``requests``: the folder of requests, as a URI that Arrow's file systems open;
* ``recorded``: a folder of recorded exchanges to answer from instead of the network;
* ``ledger``: a folder where calls are noted, so that a task that runs again makes none twice;
* ``pause``: waits between attempts are multiplied by it (1 by default).
"""

from __future__ import annotations

import base64
import hashlib
import json
import subprocess
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib import error, parse
from urllib import request as web

import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from fernmill.sources.fetch import FEED_PAGE, HOMEPAGE, PAGE, PLACES, Policy, Refused
from fernmill.sources.stored import Ledger, Noted

POLICIES = {"page": PAGE, "feed_page": FEED_PAGE, "homepage": HOMEPAGE}


@dataclass(frozen=True)
class Request:
    url: str
    body: str = ""
    headers: tuple[tuple[str, str], ...] = ()

    @property
    def key(self) -> str:
        return f"{self.url}\n{self.body}"


@dataclass(frozen=True)
class Answer:
    status: int
    kind: str
    body: bytes


Transport = Callable[[Request], Answer]


class Failed(Exception):
    """An answer that says the request failed."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(f"HTTP {status}: {message}" if message else f"HTTP {status}")
        self.code, self.message = status, message


class Exhausted(Refused):
    """A failure after which nobody need ask again today."""


def live(policy: Policy) -> Transport:
    """Answers of the network."""

    def run(request: Request) -> Answer:
        asked = web.Request(request.url, data=request.body.encode() or None, headers={"User-Agent": "fernmill/1", **dict(request.headers)})
        try:
            with web.urlopen(asked, timeout=policy.timeout) as answer:
                return Answer(answer.status, answer.headers.get("Content-Type", ""), answer.read(policy.most_bytes))
        except error.HTTPError as e:
            return Answer(e.code, e.headers.get("Content-Type", ""), e.read(500))

    return run


def _recording(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def recorded(folder: str) -> Transport:
    """Recorded answers: the first for the first time that a task asks, and so on, the last one for good.

    Each question leaves an empty file in ``asked/``, named after its key.
    """
    times: dict[str, int] = {}

    def run(request: Request) -> Answer:
        store, base = fs.FileSystem.from_uri(folder)
        name = _recording(request.key)
        store.create_dir(f"{base}/asked", recursive=True)
        store.open_output_stream(f"{base}/asked/{name}-{uuid.uuid4().hex}").close()
        try:
            with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                answers = json.loads(f.read())
        except FileNotFoundError as e:
            raise ConnectionError("no answer is recorded") from e
        n = times[name] = times.get(name, -1) + 1
        own = answers[min(n, len(answers) - 1)]
        return Answer(own["status"], own["kind"], base64.b64decode(own["body"]))

    return run


def recordings(answers: DataFrame, url: Column, body: Column, *given: Column) -> DataFrame:
    """(name, content) files for :func:`recorded`: of each question, structs of status, kind and body (text) in order."""
    packed = F.array(*(F.struct(g["status"].alias("status"), g["kind"].alias("kind"), F.base64(F.coalesce(g["body"], F.lit("")).cast("binary")).alias("body")) for g in given))
    kept = F.filter(packed, lambda a: a["status"].isNotNull())
    text = F.regexp_replace(F.to_json(kept, {"ignoreNullFields": "false"}), r"\\r\\n", "")
    return answers.select(F.sha2(F.concat(url, F.lit("\n"), body).cast("binary"), 256).alias("name"), text.cast("binary").alias("content"))


def asked(folder: str) -> int:
    """How many questions a folder of recordings was asked."""
    store, base = fs.FileSystem.from_uri(folder)
    return len(store.get_file_info(fs.FileSelector(f"{base}/asked", allow_not_found=True)))


def exchange(request: Request, transport: Transport, policy: Policy, pause: Callable[[float], None] = time.sleep) -> str:
    """The text of an answer, with the policy's attempts and waits.

    An answer of 429 that names a limit per day ends it for everyone: ``Exhausted``.
    """
    for attempt in range(policy.attempts):
        try:
            got = transport(request)
            if got.status >= 400:
                message = got.body[:500].decode("utf-8", "replace").strip()
                if got.status == 429 and "per day" in message.lower():
                    raise Exhausted(f"HTTP 429: {message}")
                if policy.ends(got.status):
                    raise Refused(f"HTTP {got.status}")
                raise Failed(got.status, message)
            if not any(x in got.kind for x in policy.accepts):
                raise Refused(f"unsupported type {got.kind}")
            charset = next((p.partition("=")[2].strip("\"' ") for p in got.kind.split(";") if p.strip().lower().startswith("charset=")), "utf-8")
            try:
                return got.body[: policy.most_bytes].decode(charset, "replace")
            except LookupError:
                return got.body[: policy.most_bytes].decode("utf-8", "replace")
        except Refused:
            raise
        except Exception as e:
            if attempt + 1 == policy.attempts:
                raise
            pause(policy.wait(attempt, getattr(e, "code", None)))
    raise Refused("no attempt is allowed")


def host_of(url: str) -> str:
    """Lower-case host without port, user or a leading www, as ``urls.host``."""
    try:
        name = parse.urlsplit(url).netloc.rpartition("@")[2].partition(":")[0].lower()
    except ValueError:
        return ""
    return name.removeprefix("www.")


@dataclass
class Piece(InputPartition):
    """A row group of a file of requests."""

    file: str
    group: int


class _Reader(DataSourceReader):
    """Requests by row group, narrowed by the equalities that are pushed down on ``narrows``."""

    narrows: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.schema, self.only = options, schema, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in self.narrows:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, base = fs.FileSystem.from_uri(self.options["requests"])
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet"))
        return [Piece(f, g) for f in files for g in range(pq.ParquetFile(f, filesystem=store).num_row_groups)]

    def rows(self, piece: Piece) -> Iterator[dict]:
        store, _ = fs.FileSystem.from_uri(self.options["requests"])
        for batch in pq.ParquetFile(piece.file, filesystem=store).iter_batches(1_000, row_groups=[piece.group]):
            for row in batch.to_pylist():
                if all(name not in row or row[name] in values for name, values in self.only.items()):
                    yield row

    def caller(self, policy: Policy) -> Callable[[Request], tuple[str | None, str | None]]:
        """(text, error) of requests, through the recordings, the ledger and the marker that stops all."""
        transport = recorded(self.options["recorded"]) if "recorded" in self.options else live(policy)
        ledger = Ledger(self.options["ledger"]) if "ledger" in self.options else None
        slower = float(self.options.get("pause", "1"))

        def ask(request: Request) -> str:
            return exchange(request, transport, policy, lambda s: time.sleep(s * slower))

        def run(request: Request) -> tuple[str | None, str | None]:
            try:
                if ledger and (known := ledger.answer(request.key)) is not None:
                    return known, None
                if ledger and (reason := ledger.stopped()):
                    return None, f"not asked: {reason}"
                return (ledger.once(request.key, lambda: ask(request)) if ledger else ask(request)), None
            except Exhausted as e:
                if ledger:
                    ledger.stop(str(e))
                return None, f"Exhausted: {e}"
            except Noted as e:
                return None, str(e)
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        return run


class _Pages(_Reader):
    narrows = ("url", "host")

    def read(self, partition: Piece) -> Iterator[tuple]:
        call = self.caller(POLICIES[self.options.get("policy", "page")])
        hosts = self.only.get("host")
        for row in self.rows(partition):
            host = host_of(row["url"] or "")
            if hosts is None or host in hosts:
                yield (row["url"], host, *call(Request(row["url"] or "")))


class Pages(DataSource):
    """Web pages: (url, host, body, error) for requests (url); option ``policy``: page, feed_page or homepage.

    Equalities on url and host are pushed down: other pages are not asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "fernmill_pages"

    def schema(self) -> str:
        return "url string, host string, body string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(self.options, schema)


# The fields of a place that can be asked for.
PLACE_FIELDS = ["id", "displayName", "formattedAddress", "location", "types", "primaryType", "businessStatus", "websiteUri", "googleMapsUri", "nationalPhoneNumber", "regularOpeningHours"]


def nearby(endpoint: str, key: str, row: dict, types: list[str], radius: float, most: int, fields: list[str]) -> Request:
    """A search around a cell: the kinds of places, the circle, the number and the fields are the server's to apply."""
    body = {"includedPrimaryTypes": types, "maxResultCount": most, "rankPreference": "DISTANCE", "locationRestriction": {"circle": {"center": {"latitude": row["latitude"], "longitude": row["longitude"]}, "radius": radius}}}
    headers = (("Content-Type", "application/json"), ("X-Goog-Api-Key", key), ("X-Goog-FieldMask", ",".join(f"places.{f}" for f in fields)))
    return Request(endpoint, json.dumps(body, sort_keys=True), headers)


class _Places(_Reader):
    narrows = ("city", "primary_type")

    def read(self, partition: Piece) -> Iterator[tuple]:
        o = self.options
        fields = [f for f in o.get("fields", "").split(",") if f] or PLACE_FIELDS
        if odd := set(fields) - set(PLACE_FIELDS):
            raise ValueError(f"unknown fields {sorted(odd)}")
        kinds = [t for t in o.get("types", "").split(",") if t]
        if (only := self.only.get("primary_type")) is not None:
            kinds = [t for t in kinds if t in only] if kinds else sorted(only)
            if not kinds:
                return
        call = self.caller(PLACES)
        for row in self.rows(partition):
            cell = (row["city"], row["latitude"], row["longitude"])
            asked_ = nearby(o.get("endpoint", ""), o.get("key", ""), row, kinds, float(o.get("radius", "1100")), int(o.get("most", "20")), fields)
            text, failure = call(asked_)
            if failure is None:
                try:
                    found = json.loads(text).get("places", [])
                except ValueError as e:
                    found, failure = [], f"ValueError: {e}"
                for pos, place in enumerate(found):
                    if only is None or place.get("primaryType") in only:
                        yield (*cell, pos, place.get("primaryType"), json.dumps(place, sort_keys=True), None)
            if failure is not None:
                yield (*cell, -1, None, None, failure)


class Places(DataSource):
    """Places near cells: (city, latitude, longitude, pos, primary_type, json, error) for requests (city, latitude, longitude).

    Options ``endpoint``, ``key``, ``types``, ``radius``, ``most`` and ``fields``
    go to the server. Equalities on city prune cells, those on primary_type
    narrow the kinds that the server is asked for. A cell that fails gives one row
    with the error; with a ledger, a limit per day stops all tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "fernmill_places"

    def schema(self) -> str:
        return "city string, latitude double, longitude double, pos int, primary_type string, json string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Places(self.options, schema)


@dataclass
class Slot(InputPartition):
    """Pages that one browser renders, one after the other."""

    pages: list[tuple[int, str]]


class _Renders(_Reader):
    def partitions(self) -> list[InputPartition]:
        store, base = fs.FileSystem.from_uri(self.options["requests"])
        budget, slots = int(self.options.get("budget", "8")), int(self.options.get("slots", "2"))
        queue = ds.dataset(base, filesystem=store, format="parquet")
        first = sorted((r["rank"], r["url"]) for r in queue.to_table(columns=["rank", "url"], filter=ds.field("rank") < budget).to_pylist())[:budget]
        return [Slot(first[k::slots]) for k in range(slots)]

    def read(self, partition: Slot) -> Iterator[tuple]:
        ledger, transport = Ledger(self.options["ledger"]), None
        if "recorded" in self.options:
            transport = recorded(self.options["recorded"])
        timeout = float(self.options.get("timeout", "25"))
        for rank, url in partition.pages:
            try:
                body = ledger.once(f"{rank}\n{url}", lambda u=url: transport(Request(u)).body.decode("utf-8", "replace") if transport else rendered(self.options["browser"], u, timeout))
                yield (rank, url, body, None)
            except Noted as e:
                yield (rank, url, None, str(e))
            except Exception as e:
                yield (rank, url, None, f"{type(e).__name__}: {e}")


def rendered(browser: str, url: str, timeout: float) -> str:
    """What a headless browser shows of a page, also what it wrote before its time ran out; empty unless it is markup."""
    asked_ = [browser, "--headless=new", "--no-sandbox", "--disable-gpu", "--disable-extensions", "--disable-sync", "--virtual-time-budget=8000", "--dump-dom", url]
    try:
        done = subprocess.run(asked_, capture_output=True, timeout=timeout, check=False)
        out = done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""
    except subprocess.TimeoutExpired as e:
        out = (e.stdout or b"").decode("utf-8", "replace")
    return out if "<" in out else ""


class Renders(DataSource):
    """Renders of the first pages of a queue: (rank, url, body, error) for requests (rank from 0, url).

    The budget (option ``budget``, 8) is one for the whole job: the reader plans
    the first ranks alone, dealt over exactly ``slots`` (2) partitions, so that as
    many pages are open at a time. Option ``ledger`` is needed: a task that runs
    again reads the pages it has rendered and starts none twice.
    """

    @classmethod
    def name(cls) -> str:
        return "fernmill_renders"

    def schema(self) -> str:
        return "rank int, url string, body string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Renders(self.options, schema)


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known to a session and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Pages, Places, Renders):
        spark.dataSource.register(source)
    return spark
