"""External merge of a web-archive index.

Every input partition is sorted by URL key, timestamp, record id and digest: a run. Runs are written to the shared folder
and cut into key ranges of ``RANGE_ROWS`` captures on average, whatever the size of the table; a row's run and place in it end the key, so a URL, and even one capture that is repeated without end, is cut
like anything else. The task of a range takes its slices of all runs, as they come in any order, and merges
them with a loser tree, so nothing is sorted again; capture numbers, times between captures and revisits follow from the merged order in the same pass. Only a range's first and last URL can
go on in another range: one row for each range, ``MOST_RANGES`` at most, says what its first URL had before and how many captures both have in all.

URL key: the host without ``www.``, user and port, its labels reversed and joined by commas, then ``)``, path and query in lower case; the
fragment goes, as does a trailing slash. Timestamp: ``timestamp`` if the table has that column (14 digits as in capture indexes, a number of seconds, or anything that casts to a timestamp; else it is null), else a capture time that
follows from the record id (the tables here have none): 2024-01-01 plus id * 7919 seconds modulo a year.

Defined results: a null or empty URL has the key '' and sorts first; a null timestamp sorts first, then a null id; an id that is no whole number counts as null.
Equal captures (key, time, id) keep any order among them, which doesn't show unless their other columns differ; then the digest decides.
An empty table gives no rows. Columns other than page_id, url, html and timestamp are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Table, frugal

#: Captures of a range, of which a task holds the keys, and ranges at most; beyond their product ranges grow.
RANGE_ROWS, MOST_RANGES = 200_000, 1 << 16
YEAR_S = 365 * 86400
START_S = 1704067200


class LoserTree:
    """k-way merge of sorted sequences of (comparable) keys; ``pop`` gives (sequence, position) in order.

    Inner nodes hold the loser of their match and the winner sits on top, so a pop replays one path of log2(k) matches.
    """

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.tree = [-1] * self.k  # losers; [0] is the winner
        for leaf in range(len(runs)):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether the head of a goes before that of b: an ended run loses, and ties go to the lower run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # still being built: wait here for the opponent
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        if not self.runs:
            return
        while True:
            w = self.tree[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield w, self.at[w]
            self.at[w] += 1
            self._play(w)


def url_key(url: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    u = F.regexp_replace(u, "^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(u, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, "^[^/?]*", 0), "^[^@]*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(host, "^www\\.", "")
    path = F.regexp_replace(F.regexp_replace(u, "^[^/?]*", ""), "/$", "")
    return F.when(u == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path))


def _time(stamp: Column) -> Column:
    """Seconds of a timestamp column of any type."""
    t = F.trim(stamp.cast("string"))
    return (
        F.when(t.rlike("^[0-9]{14}$"), F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))))
        .when(t.rlike("^[0-9]{9,11}$"), t.try_cast("bigint"))
        .when(t.rlike("^[0-9]{8}$"), F.unix_timestamp(F.try_to_timestamp(t, F.lit("yyyyMMdd"))))
        .otherwise(F.unix_timestamp(t.try_cast("timestamp")))
    )


def captures(pages: DataFrame) -> DataFrame:
    """(urlkey, ts, page_id, url, digest, length): ts in seconds, digest as MD5 of the record, '' for a null one."""
    ident = F.col("page_id").try_cast("bigint")
    # Remainders first: ids of any size stay within 64 bits.
    ts = _time(F.col("timestamp")) if "timestamp" in pages.columns else F.lit(START_S) + F.pmod(F.pmod(ident, F.lit(YEAR_S)) * 7919, F.lit(YEAR_S))
    return pages.select(
        url_key(F.col("url")).alias("urlkey"), ts.cast("bigint").alias("ts"), ident.alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.md5(F.col("html").cast("binary")), F.lit("")).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint").alias("length"),
    )


_COLS = ["urlkey", "ts", "page_id", "url", "digest", "length"]
#: Of each row: its range and place in it, its number among the URL's captures in the range and their count, the capture before in the range, and whether the URL is the range's first or last.
_OUT = "urlkey string, ts bigint, page_id bigint, url string, digest string, length bigint, part int, row bigint, nth bigint, here bigint, prev_ts bigint, prev_digest string, is_first boolean, is_last boolean"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range: find the sorted runs in what comes, then merge them."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables).combine_chunks()
    low = -(2**63)
    keys = list(zip(t["urlkey"].to_pylist(), [low if x is None else x for x in t["ts"].to_pylist()], [low if x is None else x for x in t["page_id"].to_pylist()], t["digest"].to_pylist()))
    runs_of: dict[int, list[int]] = {}
    for i, r in enumerate(t["run"].to_pylist()):
        runs_of.setdefault(r, []).append(i)
    runs: list[list[int]] = []
    for rows in runs_of.values():  # blocks of one run can come in any order: a descent begins a new run
        begin = 0
        for i in range(1, len(rows)):
            if keys[rows[i]] < keys[rows[i - 1]]:
                runs.append(rows[begin:i])
                begin = i
        runs.append(rows[begin:])
    n = len(keys)
    order = np.fromiter((runs[r][i] for r, i in LoserTree([[keys[i] for i in rows] for rows in runs])), dtype=np.int64, count=n)
    new = np.fromiter((k == 0 or keys[order[k]][0] != keys[order[k - 1]][0] for k in range(n)), dtype=bool, count=n)
    del keys, runs
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    here = np.diff(np.append(begin, n))
    t = t.select(_COLS)
    for at in range(0, n, 20000):
        k = np.arange(at, min(n, at + 20000))
        out, before = t.take(pa.array(order[k])).combine_chunks(), t.take(pa.array(order[np.maximum(k - 1, 0)])).combine_chunks()
        fresh = pa.array(new[k])
        seen = lambda c: pc.if_else(fresh, pa.nulls(len(k), before[c].type), before[c].combine_chunks() if before[c].num_chunks != 1 else before[c].chunk(0))  # noqa: B023, E731
        cols = [out[c].chunk(0) for c in _COLS] + [pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(k - begin[group[k]] + 1), pa.array(here[group[k]])]
        cols += [seen("ts"), seen("digest"), pa.array(group[k] == 0), pa.array(group[k] == len(begin) - 1)]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _OUT.split(", ")])


def _carried(ranges: list) -> list[tuple]:
    """(part, where it starts, what its first URL has before, the last capture of that as time and digest, all captures of its first and last URL), from a summary of each range in order."""
    out, start = [], 0
    url, seen, ts, digest = None, 0, None, None
    total: dict[str, int] = {}
    for r in ranges:
        total[r["first_url"]] = total.get(r["first_url"], 0) + r["first_n"]
        if r["last_url"] != r["first_url"]:
            total[r["last_url"]] = total.get(r["last_url"], 0) + r["last_n"]
    for r in ranges:
        goes_on = r["first_url"] == url
        out.append((r["part"], start, seen if goes_on else 0, goes_on, ts if goes_on else None, digest if goes_on else None, total[r["first_url"]], total[r["last_url"]]))
        seen = r["last_n"] + (seen if goes_on and r["last_url"] == r["first_url"] else 0)
        url, ts, digest = r["last_url"], r["last"]["ts"], r["last"]["digest"]
        start += r["n"]
    return out


def merge_index(pages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each capture: position (global, from 1), urlkey, ts, page_id, url, digest, length, capture_no,
    n_captures of the URL, seconds since the capture before (null for the first) and revisit: whether the digest is the one before."""
    spark = pages.sparkSession
    order = ["urlkey", "ts", "page_id", "digest"]
    sorted_runs = captures(pages).withColumn("run", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    runs = Table(sorted_runs, "warc-runs")
    n = runs.df.count()
    ranges = min(MOST_RANGES, max(1, -(-n // range_rows)))
    # Written, so every row's range stays the same when a task runs again.
    merged = Table(runs.df.repartitionByRange(ranges, *order, "place").mapInArrow(frugal(_merge), _OUT), "warc-merged")
    runs.drop()
    m = merged.df
    summary = m.groupBy("part").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("is_first"), F.col("urlkey"))).alias("first_url"), F.max(F.when(F.col("is_last"), F.col("urlkey"))).alias("last_url"),
        F.count_if("is_first").alias("first_n"), F.count_if("is_last").alias("last_n"), F.max_by(F.struct("ts", "digest"), "row").alias("last"),
    )
    carry = spark.createDataFrame(_carried(sorted(summary.collect(), key=lambda r: r["part"])), "part int, start bigint, seen bigint, goes_on boolean, old_ts bigint, old_digest string, first_all bigint, last_all bigint")
    first_row = F.col("is_first") & (F.col("nth") == 1) & F.col("goes_on")
    joined = m.join(F.broadcast(carry), "part")  # MOST_RANGES rows at most
    joined = joined.withColumns({"prev_ts": F.when(first_row, F.col("old_ts")).otherwise(F.col("prev_ts")), "prev_digest": F.when(first_row, F.col("old_digest")).otherwise(F.col("prev_digest"))})
    return joined.select(
        (F.col("start") + F.col("row") + 1).alias("position"), *_COLS, (F.col("nth") + F.when(F.col("is_first"), F.col("seen")).otherwise(0)).alias("capture_no"),
        F.when(F.col("is_first"), F.col("first_all")).when(F.col("is_last"), F.col("last_all")).otherwise(F.col("here")).alias("n_captures"),
        (F.col("ts") - F.col("prev_ts")).alias("since_s"), F.coalesce(F.col("digest") == F.col("prev_digest"), F.lit(False)).alias("revisit"),
    )


SQL = f"""
WITH u AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS u FROM pages),
h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*'), '^[^@]*@', ''), ':[0-9]*$', ''), '^www\\.', '') AS host,
         regexp_replace(regexp_replace(u, '^[^/?]*', ''), '/$', '') AS path FROM u),
c AS (
  SELECT CASE WHEN u = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path END AS urlkey,
         CAST({START_S} + (page_id * 7919) % {YEAR_S} AS BIGINT) AS ts, page_id, url, coalesce(md5(html), '') AS digest,
         CAST(coalesce(strlen(html), 0) AS BIGINT) AS length FROM h)
SELECT row_number() OVER (ORDER BY urlkey, ts NULLS FIRST, page_id NULLS FIRST, digest) AS position, urlkey, ts, page_id, url, digest, length,
       row_number() OVER w AS capture_no, count(*) OVER (PARTITION BY urlkey) AS n_captures, ts - lag(ts) OVER w AS since_s,
       coalesce(digest = lag(digest) OVER w, false) AS revisit
FROM c WINDOW w AS (PARTITION BY urlkey ORDER BY ts NULLS FIRST, page_id NULLS FIRST, digest)
"""
