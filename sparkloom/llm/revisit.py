"""Not-modified revisit resolution for archived captures.

A revisit record stands for an answer "304 Not Modified": its body is that of the latest earlier full response of the same canonical URL, if their
validators agree, and its headers are that response's with those that a 304 may renew.

Canonical URL: no scheme, user, fragment, ``www`` label, default port or trailing slash; host in lower case; query without tracking parameters, sorted.

Validators: an ETag (compared weakly) if the revisit has one, else Last-Modified, else the payload digest; none of them: nothing to check.  A revisit is
``resolved``, ``mismatch`` (the latest earlier response differs; older ones are not tried) or ``missing`` (no earlier response).

As-of join.  Captures are dealt by (URL, block of time), so one URL with a large share of all captures spreads over its blocks; inside a block a
running last response answers; a block's own last response is carried to the next blocks by a window over one row per (URL, block).

Defined cases: responses are earlier only if their time is less, and of several at one time the greatest id counts; null URLs or times match nothing
(missing); null headers are no headers; repeated rows give repeated results; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import read_table

#: fields that a 304 answer may renew (fixed values)
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: query parameters that do not name content
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sid|phpsessid|jsessionid|sessionid)(=.*)?$"
BLOCK_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(host), r"^.*@", ""), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(tail, r"^[^?]*", 0), r"/+$", "")
    query = F.split(F.regexp_extract(tail, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def merged_headers(full: Column, renewing: Column) -> Column:
    """The stored headers with the permitted ones of the 304 put in their place."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    full, renewing = F.coalesce(full, none), F.coalesce(renewing, none)
    new = F.map_filter(renewing, lambda k, v: k.isin(RENEWED))
    return F.map_concat(F.map_filter(full, lambda k, v: ~F.map_contains_key(new, k)), new)


def resolve(captures: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """record_id, canonical_url, state, resolved_id and headers of each revisit.

    ``captures``: record_id, url, ts (seconds), kind (response or revisit), headers (map with lower-case names), digest.
    """
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "headers", "digest")
    rows = rows.withColumn("block", F.floor(F.col("ts") / block_seconds))
    full = F.when(F.col("kind") == "response", F.struct("record_id", "headers", "digest"))
    known = rows.where("canonical_url is not null and ts is not null")
    # at one time revisits come first: a response at their own time is not earlier
    inside = Window.partitionBy("canonical_url", "block").orderBy("ts", F.when(F.col("kind") == "response", 1).otherwise(0), "record_id")
    own = known.withColumn("own", F.last(full, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))).where("kind = 'revisit'")
    ends = known.groupBy("canonical_url", "block").agg(F.max_by(full, F.when(full.isNotNull(), F.struct("ts", "record_id"))).alias("end"))
    carried = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("canonical_url", "block", F.last("end", ignorenulls=True).over(carried).alias("before"))
    found = own.join(before, ["canonical_url", "block"], "left").withColumn("from", F.coalesce("own", "before")).drop("own", "before")
    lost = rows.where("kind = 'revisit' and (canonical_url is null or ts is null)").withColumn("from", F.lit(None).cast(found.schema["from"].dataType))
    found = found.unionByName(lost)
    stored, mine = F.col("from")["headers"], F.col("headers")
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    agrees = (
        F.when(get(mine, "etag").isNotNull(), F.coalesce(weak(get(mine, "etag")) == weak(get(stored, "etag")), F.lit(False)))
        .when(get(mine, "last-modified").isNotNull(), F.coalesce(get(mine, "last-modified") == get(stored, "last-modified"), F.lit(False)))
        .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("from")["digest"], F.lit(False)))
        .otherwise(True)
    )
    state = F.when(F.col("from").isNull(), "missing").when(agrees, "resolved").otherwise("mismatch")
    good = state == "resolved"
    return found.select("record_id", "canonical_url", state.alias("state"), F.when(good, F.col("from")["record_id"]).alias("resolved_id"), F.when(good, merged_headers(stored, mine)).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture history of the pages: full responses, and 304 answers with right, wrong and no validators, before and after them."""
    p = pages.select(F.col("page_id").cast("long").alias("p"), "url", F.coalesce("html", F.lit("")).alias("html"))
    t = F.lit(1_600_000_000) + (F.col("p") * 7919) % 10_000_000
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 8), F.lit('"'))
    p = p.select("p", "url", t.alias("t"), tag.alias("tag"), F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_medium=feed")).alias("again"))

    def record(number: int, url: str, ts: Column, kind: str, headers: dict[str, Column], where: Column) -> Column:
        names = [k for k in headers]
        entries = F.array(*[F.struct(F.lit(k).alias("key"), headers[k].alias("value")) for k in names])
        known = F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))
        return F.when(where, F.struct((F.col("p") * 4 + number).alias("record_id"), F.col(url).alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), known.alias("headers"), F.lit(None).cast("string").alias("digest")))

    when = lambda c, x: F.when(c, x)
    n, t = F.col("p"), F.col("t")
    tagged = n % 5 != 0
    first = {"cache-control": F.lit("max-age=60"), "content-type": F.lit("text/html"), "date": t.cast("string"), "etag": when(tagged, F.col("tag")), "last-modified": (t - 1000).cast("string"), "server": F.lit("a")}
    soon = t + 100 + n % 50
    second = {"cache-control": F.lit("max-age=120"), "date": soon.cast("string"), "etag": F.when(n % 7 == 0, F.lit('"other"')).when(tagged, F.concat(F.lit("W/"), F.col("tag"))), "last-modified": (t - 1000).cast("string"), "server": F.lit("b")}
    third = {"content-type": F.lit("text/html"), "date": (t + 5000).cast("string"), "etag": F.lit('"new"'), "server": F.lit("c")}
    late = F.when(n % 3 == 0, t + 400_000).when(n % 11 == 1, t - 50).otherwise(t + 6000)
    fourth = {"date": late.cast("string"), "etag": when(n % 3 == 0, F.lit('"new"')), "expires": (late + 60).cast("string")}
    every = F.lit(True)
    records = F.array(
        record(0, "url", t, "response", first, every), record(1, "again", soon, "revisit", second, every),
        record(2, "url", t + 5000, "response", third, n % 3 == 0), record(3, "again", late, "revisit", fourth, every),
    )
    return p.select(F.explode(F.filter(records, lambda x: x.isNotNull())).alias("c")).select("c.*")


def op5_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisits of the capture history of all pages; headers as sorted lines."""
    out = resolve(captures_of(read_table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))), "\n")
    return out.select("record_id", "canonical_url", "state", "resolved_id", lines.alias("headers"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id::BIGINT AS p, url, 1600000000 + (page_id::BIGINT * 7919) % 10000000 AS t, '"' || substr(md5(coalesce(html, '')), 1, 8) || '"' AS tag,
    regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=feed' AS again FROM pages),
c AS (
  SELECT p * 4 AS id, url, t AS ts, 'response' AS kind, 'max-age=60' AS cc, 'text/html' AS ct, t::VARCHAR AS date, CASE WHEN p % 5 <> 0 THEN tag END AS etag, NULL AS expires, (t - 1000)::VARCHAR AS lm, 'a' AS server FROM p
  UNION ALL SELECT p * 4 + 1, again, t + 100 + p % 50, 'revisit', 'max-age=120', NULL, (t + 100 + p % 50)::VARCHAR, CASE WHEN p % 7 = 0 THEN '"other"' WHEN p % 5 <> 0 THEN 'W/' || tag END, NULL, (t - 1000)::VARCHAR, 'b' FROM p
  UNION ALL SELECT p * 4 + 2, url, t + 5000, 'response', NULL, 'text/html', (t + 5000)::VARCHAR, '"new"', NULL, NULL, 'c' FROM p WHERE p % 3 = 0
  UNION ALL SELECT p * 4 + 3, again, l, 'revisit', NULL, NULL, l::VARCHAR, CASE WHEN p % 3 = 0 THEN '"new"' END, (l + 60)::VARCHAR, NULL, NULL
    FROM (SELECT *, CASE WHEN p % 3 = 0 THEN t + 400000 WHEN p % 11 = 1 THEN t - 50 ELSE t + 6000 END AS l FROM p)),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM c),
v AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(regexp_extract(rest, '^[^/?]*(.*)$', 1), '^[^?]*'), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_extract(rest, '^[^/?]*(.*)$', 1), '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|gclid|fbclid|sid|phpsessid|jsessionid|sessionid)(=.*)?$'))), '&') AS q FROM u),
w AS (SELECT * EXCLUDE (rest, host, path, q), host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS cu FROM v),
full_ AS (SELECT * FROM w WHERE kind = 'response' QUALIFY row_number() OVER (PARTITION BY cu, ts ORDER BY id DESC) = 1),
j AS (
  SELECT r.id, r.cu, s.id AS sid, r.date AS rd, r.cc AS rcc, r.etag AS re, r.expires AS rx, r.lm AS rl, s.cc, s.ct, s.date, s.etag, s.expires, s.lm, s.server
  FROM (SELECT * FROM w WHERE kind = 'revisit') r ASOF LEFT JOIN full_ s ON r.cu = s.cu AND r.ts > s.ts),
k AS (
  SELECT *, CASE WHEN sid IS NULL THEN 'missing'
    WHEN re IS NOT NULL THEN CASE WHEN coalesce(regexp_replace(re, '^W/', '') = regexp_replace(etag, '^W/', ''), FALSE) THEN 'resolved' ELSE 'mismatch' END
    WHEN rl IS NOT NULL THEN CASE WHEN coalesce(rl = lm, FALSE) THEN 'resolved' ELSE 'mismatch' END ELSE 'resolved' END AS state FROM j)
SELECT id AS record_id, cu AS canonical_url, state, CASE WHEN state = 'resolved' THEN sid END AS resolved_id,
  CASE WHEN state = 'resolved' THEN concat_ws(chr(10), 'cache-control: ' || coalesce(rcc, cc), 'content-type: ' || ct, 'date: ' || rd, 'etag: ' || coalesce(re, etag),
    'expires: ' || coalesce(rx, expires), 'last-modified: ' || lm, 'server: ' || server) END AS headers
FROM k
"""
