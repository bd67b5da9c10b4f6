"""WARC revisit resolution: an as-of join of not-modified revisits to earlier full responses.

URLs are put in canonical form; each revisit takes the latest strictly earlier full response of the
same canonical URL; it is confirmed if its validators (ETag first, else Last-Modified) agree with
that response's. Headers of the two are merged: a 304 answer may renew only the permitted ones.

Per URL the time line is cut into spans of fixed length. Inside (URL, span) a window carries the
last response forward; per span only its last response is kept for the spans after it. So a URL
that holds a third of all records is worked on by many tasks, and what crosses spans is one row each.

Cases. Null URL or time: unresolved (no_url, no_time). Equal times: a response is not earlier than a revisit
of the same time; of responses with one time, the one with the larger record id counts as later.
Repeated rows: each resolved. No earlier response: no_response. Neither side has a validator:
unvalidated. Validators differ: mismatch, no headers merged. Empty table: no rows. Bodies are not carried; only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a not-modified answer may renew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SPAN_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no user part, default port, fragment, dot path or trailing slash; sorted query."""
    u = F.trim(url)
    u = F.regexp_replace(u, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@", ""))
    host = F.regexp_replace(host, r"\.(:|$)", "$1")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), r"/(?:\./)+", "/")
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(tail, r"\?(.*)$", 1), "&"), lambda x: x != "")), "&")
    return F.concat(F.when(scheme == "", F.lit("http")).otherwise(scheme), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def header(headers: Column, name: str) -> Column:
    """A field's value, its name compared without case."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.when(F.size(found) > 0, F.trim(F.try_element_at(found, F.lit(1))["value"]))


def merge_headers(full: Column, fresh: Column) -> Column:
    """The response's headers, renewed by the permitted ones of the revisit; names in lower case."""
    low = lambda m: F.transform(F.map_entries(F.coalesce(m, F.expr("cast(map() as map<string,string>)"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    allowed = F.filter(low(fresh), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(allowed, lambda e: e["key"])
    kept = F.filter(low(full), lambda e: ~F.array_contains(names, e["key"]))
    every = F.concat(allowed, kept)  # of one name given twice, the first counts
    named = F.array_sort(F.array_distinct(F.transform(every, lambda e: e["key"])))
    return F.map_from_arrays(named, F.transform(named, lambda n: F.try_element_at(F.filter(every, lambda e: e["key"] == n), F.lit(1))["value"]))


def resolve_revisits(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """records: record_id long, url string, ts timestamp, kind ('response' or 'revisit'), headers map<string,string>.

    A row per revisit: record_id, url, canonical_url, ts, response_id, response_ts, outcome, headers.
    """
    kept = records.select("record_id", "url", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.lower("kind").alias("kind"), "headers")
    kept = kept.withColumn("span", F.floor(F.unix_micros("ts") / (span_seconds * 1_000_000)))
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", F.col("record_id"), F.col("headers").alias("headers")))
    usable = kept.filter(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin("response", "revisit"))
    # Before a revisit of the same time no response of that time is visible: revisits sort first.
    late = F.when(F.col("kind") == "revisit", 0).otherwise(1)
    line = Window.partitionBy("canonical_url", "span").orderBy("ts", late, "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = usable.withColumn("near", F.last(full, ignorenulls=True).over(line)).filter("kind = 'revisit'")
    # The last response of each span, then of all spans before.
    ends = usable.filter("kind = 'response'").groupBy("canonical_url", "span").agg(F.max_by(F.struct("ts", "record_id", "headers"), F.struct("ts", "record_id")).alias("end"))
    ask = inside.filter("near is null").select("canonical_url", "span").distinct()
    spans = ends.select("canonical_url", "span", "end").unionByName(ask.withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)))
    spans = spans.groupBy("canonical_url", "span").agg(F.first("end", ignorenulls=True).alias("end"), F.lit(1).alias("one"))
    before = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("canonical_url").alias("__u"), F.col("span").alias("__s"), F.last("end", ignorenulls=True).over(before).alias("far")).filter("far is not null")
    joined = inside.join(carried, (F.col("canonical_url") == F.col("__u")) & (F.col("span") == F.col("__s")), "left").drop("__u", "__s")
    found = joined.withColumn("full", F.coalesce(F.col("near"), F.col("far")))
    broken = kept.filter((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("ts").isNull()))
    broken = broken.withColumn("full", F.lit(None).cast(found.schema["full"].dataType))
    columns = ["record_id", "url", "canonical_url", "ts", "headers", "full"]
    rows = found.select(columns).unionByName(broken.select(columns))
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    mine, theirs = F.col("headers"), F.col("full")["headers"]
    by_tag, by_date = tag(mine) == tag(theirs), header(mine, "last-modified") == header(theirs, "last-modified")
    outcome = (
        F.when(F.col("canonical_url").isNull(), "no_url").when(F.col("ts").isNull(), "no_time").when(F.col("full").isNull(), "no_response")
        .when(by_tag.isNotNull(), F.when(by_tag, "etag").otherwise("mismatch")).when(by_date.isNotNull(), F.when(by_date, "last_modified").otherwise("mismatch")).otherwise("unvalidated")
    )
    rows = rows.withColumn("outcome", outcome)
    merged = F.when(F.col("outcome").isin("etag", "last_modified"), merge_headers(theirs, mine))
    return rows.select("record_id", "url", "canonical_url", "ts", F.col("full")["record_id"].alias("response_id"), F.col("full")["ts"].alias("response_ts"), "outcome", merged.alias("headers"))


def captures(pages: DataFrame, shift: int = 7) -> DataFrame:
    """A capture log from ``pages``: a full response of every page, and a later revisit of every page.

    Response time: page_id hours after 2020-01-01. The revisit comes page_id % ``shift`` days and half an hour
    later, for the URL in another spelling; every fifth one carries a changed ETag, every third none.
    """
    base, digest = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("page_id") * 3600), F.md5(F.col("html"))
    day = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    again = F.timestamp_seconds(F.lit(1_577_836_800 + 1800) + F.col("page_id") * 3600 + (F.col("page_id") % shift) * 86_400)
    changed = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x"), digest)).otherwise(digest)
    full = F.create_map(F.lit("ETag"), digest, F.lit("Last-Modified"), day(base), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Date"), day(base))
    tagged = F.create_map(F.lit("etag"), changed, F.lit("date"), day(again), F.lit("content-length"), F.lit("0"))
    dated = F.create_map(F.lit("last-modified"), day(base), F.lit("date"), day(again), F.lit("content-length"), F.lit("0"))
    kinds = F.explode(F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("url").alias("url"), base.alias("ts"), F.lit("response").alias("kind"), full.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.col("url"), F.lit("#again")).alias("url"), again.alias("ts"), F.lit("revisit").alias("kind"), F.when(F.col("page_id") % 3 == 0, dated).otherwise(tagged).alias("headers")),
    )).alias("r")
    return pages.select(kinds).select("r.*")
