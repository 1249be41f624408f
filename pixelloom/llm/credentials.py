"""Secret scans with multipart linking: parts of credentials that tell only together.

Base spans are reported wherever they stand: ``assign`` (a password, secret, token or API
key with its value), ``access`` (AKIA identifiers) and ``hex`` (32 lower-case hex digits or
more). Weak candidates are common in clean texts, so each is reported only when the parts
that complete a credential stand near it:

- ``login``: a user, login, account, client or access key id with its value; reported near
  a secret (assign, hex, key);
- ``host``: an address of a service; reported near an access identifier (access, login)
  and a secret;
- ``key``: 20 characters or more of ``A-Za-z0-9+/_=-`` with an upper-case letter, a
  lower-case one and a digit; reported near an access identifier.

Near: in the same scope (a stretch without a blank line), with at most REACH code points
between the two spans. Evidence is never the same characters twice: a login that meets a
base span isn't a candidate, nor is a key that meets a base span, a login or a host.

Linking is an interval join by the nearest: of each scope's parts, in order of their
places, each candidate meets the last end before it and the first start after it of either
role. Which pairs there are is never written out.

Defined cases. Null and empty texts have no spans. Texts are taken whole, whatever their
length; places are code points, ends exclusive. Repeated rows and ids are rows of their
own, null ids stay. Columns of the input other than doc_id are left out, whatever their
names. An empty table gives an empty result.

Scale. Texts are read once, in Arrow batches, and never shuffled; spans are saved. Only
the parts of documents that have a candidate are shuffled, by row and scope, so a source or
id that holds many rows is many keys, and a group holds the parts of one text at most.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, utf8
from .token_counts import blocks

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "login", "host", "key")
BASE, ACCESS, SECRET = ("assign", "access", "hex"), ("access", "login"), ("assign", "hex", "key")
REACH = 200
# over texts whose A-Z are lower-cased; what is only looked for where a word of it occurs
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LOGIN = re.compile(rb"""(user|username|user_?id|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([a-z0-9@+/_.=-]+)""")
LOGIN_WORDS = (b"user", b"login", b"account", b"client", b"access")
HOST = re.compile(rb"(https?|wss?|ftp|s3|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|ldap)://[a-z0-9.:@/_?&=%+~#-]+")
# over texts as they are
AKIA = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEY = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
MIXED = re.compile(rb"(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])", re.S)
BLANK = re.compile(rb"\n[ \t\r]*\n")
CONTINUED = bytes(range(128, 192))

Span = tuple[int, int, str]


def disjoint(spans: list[Span], others: list[Span]) -> list[Span]:
    """The spans that meet none of ``others``."""
    joined: list[list[int]] = []
    for a, b, _ in sorted(others):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    begins = [a for a, _ in joined]

    def free(a: int, b: int) -> bool:
        k = bisect_right(begins, b - 1)
        return not k or joined[k - 1][1] <= a

    return [s for s in spans if free(s[0], s[1])]


def spans_of(text: bytes) -> list[Span]:
    """Base spans and candidates by byte places, in order of start and kind."""
    low, found = text.lower(), []

    def matched(kind: str, pattern: re.Pattern, where: bytes, words: tuple[bytes, ...], least: int, group: int = 0) -> list[Span]:
        if words and not any(w in where for w in words):
            return []
        return [(*m.span(), kind) for m in pattern.finditer(where) if m.end(group) - m.start(group) >= least]

    found += matched("assign", ASSIGN, low, ASSIGN_WORDS, 8, 2)
    found += matched("access", AKIA, text, (b"AKIA",), 16)
    found += matched("hex", HEX, text, (), 32)
    logins = disjoint(matched("login", LOGIN, low, LOGIN_WORDS, 3, 2), found)
    hosts = matched("host", HOST, low, (b"://",), 0)
    keys = [s for s in matched("key", KEY, text, (), 20) if MIXED.match(text[s[0] : s[1]])]
    found += [*logins, *hosts, *disjoint(keys, found + logins + hosts)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def by_code_points(text: bytes, spans: list[Span]) -> list[dict]:
    """The spans by code points, each with its scope's number."""
    places = sorted({p for a, b, _ in spans for p in (a, b)})
    points, at, n = {}, 0, 0
    for p in places:
        n += len(text[at:p].translate(None, CONTINUED))
        points[p], at = n, p
    breaks = [m.end() for m in BLANK.finditer(text)] if spans else []
    return [{"start": points[a], "kind": KINDS.index(k), "end": points[b], "scope": bisect_right(breaks, a)} for a, b, k in spans]


SPANS = "array<struct<start:bigint,kind:int,end:bigint,scope:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())]))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, found (base spans and candidates) of each row."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([by_code_points(t, spans_of(t)) for t in texts], SPAN_TYPE)], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(scan, f"doc_id {kind}, found {SPANS}")


def is_in(kind: Column, names: Iterable[str]) -> Column:
    return kind.isin([KINDS.index(n) for n in names])


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of rows (row, start, kind, end, scope) the candidates that have their complements near."""
    order = ["start", "kind", "end"]
    scope = Window.partitionBy("row", "scope")
    before = scope.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = scope.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)

    def near(role: Iterable[str]) -> Column:
        ends = F.max(F.when(is_in(F.col("kind"), role), F.col("end"))).over(before)
        starts = F.min(F.when(is_in(F.col("kind"), role), F.col("start"))).over(after)
        return F.coalesce(F.col("start") - ends <= reach, F.lit(False)) | F.coalesce(starts - F.col("end") <= reach, F.lit(False))

    marked = parts.withColumns({"near_access": near(ACCESS), "near_secret": near(SECRET)})
    needs = {"login": F.col("near_secret"), "key": F.col("near_access"), "host": F.col("near_access") & F.col("near_secret")}
    told = F.lit(False)
    for name, near_enough in needs.items():
        told = told | (is_in(F.col("kind"), [name]) & near_enough)
    return marked.filter(told).select("row", "start", "kind", "end", "scope")


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, base, spans of each row: arrays of (start, kind, end), in order."""
    rows = saved(scanned(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    base = F.filter("found", lambda s: is_in(s["kind"], BASE))
    candidates = F.exists("found", lambda s: ~is_in(s["kind"], BASE))
    several = candidates & (F.size("found") > 1)
    parts = rows.filter(several).select("row", F.explode("found").alias("s")).select("row", "s.*")
    more = linked(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "scope")).alias("more"))
    joined = rows.filter(several).join(more.hint("merge"), "row", "left").select("doc_id", base.alias("base"), F.coalesce("more", F.array().cast(SPANS)).alias("more"))
    alone = rows.filter(~several).select("doc_id", base.alias("base"), F.array().cast(SPANS).alias("more"))

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(kind)

    return alone.unionByName(joined).select("doc_id", bare(F.col("base")).alias("base"), F.array_sort(bare(F.concat("base", "more"))).alias("spans"))


def count_of(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(name))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
