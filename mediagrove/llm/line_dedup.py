"""Site-relative line removal: lines that stand on too large a share of a host's pages. DataFrame functions only.

Each page gives each of its distinct lines once, by digest, so counts combine before the shuffle and a hot host or line is one row a
task. A host has at most (lines a page) / ratio boilerplate lines, so they fit in one array a host. The table of these
arrays is broadcast if its measured rows are few; else pages and arrays meet by host and salt, so that a hot host's pages
spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, spread

RATIO, MIN_PAGES, SALTS, FEW = 0.1, 1, 64, 100_000
_BLANK = " \t\r"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def drop_boilerplate(df: DataFrame, host: Column, text: Column, *, out_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, few: int = FEW) -> DataFrame:
    """All columns of ``df``, with ``out_col`` holding the text without boilerplate lines, and host, n_lines, n_dropped.

    Lines are what line feeds separate, compared without blanks around them; blank lines stay and don't count. A line is boilerplate on a host
    if it stands on more than ``ratio`` of its pages, as a decimal number. ``min_pages``: a caller's further condition, the least number of these pages; by the ratio alone
    (1) every line of a host of fewer than 1 / ``ratio`` pages is boilerplate. Each row is a page, repeated or not. A null host is
    the host ''. A null text has no lines and stays null; other texts may become ''. Columns of ``df`` named host, n_lines or n_dropped are
    replaced; others may have any name. An empty table gives an empty result.
    """
    share = Decimal(str(ratio))  # compared exactly
    tag = "__"
    while any(c.startswith(tag) for c in df.columns):  # names that no column has
        tag += "_"
    own_host, lines, kept, bad_lines, salt = (tag + x for x in ("host", "lines", "kept", "bad", "salt"))
    wide = spread(df).withColumns({own_host: F.coalesce(host, F.lit("")), lines: F.split(text, "\n", -1)})
    keys = F.transform(F.filter(F.transform(lines, _key), lambda x: x != ""), F.md5)
    narrow = wide.select(own_host, F.array_distinct(keys).alias("keys"))
    counts = narrow.select(own_host, F.explode("keys").alias("key")).groupBy(own_host, "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages = narrow.groupBy(own_host).agg(F.count(F.lit(1)).alias("pages"))
    bad = counts.join(pages, own_host).where(F.col("n") > F.col("pages") * F.lit(share))
    bad = cut(bad.groupBy(own_host).agg(F.collect_list("key").alias(bad_lines)))
    if bad.count() <= few and (bad.agg(F.sum(F.size(bad_lines))).first()[0] or 0) <= few:
        joined = wide.join(F.broadcast(bad), own_host, "left")
    else:
        salted = wide.withColumn(salt, F.monotonically_increasing_id() % SALTS)
        joined = salted.join(bad.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [own_host, salt], "left")
    left = F.when(F.col(bad_lines).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains(bad_lines, F.md5(_key(x)))))
    full = lambda c: F.coalesce(F.size(F.filter(c, lambda x: _key(x) != "")), F.lit(0))
    joined = joined.withColumn(kept, left)
    return joined.withColumns({
        out_col: F.array_join(kept, "\n"), "host": F.col(own_host),
        "n_lines": F.when(F.col(lines).isNull(), 0).otherwise(full(lines)).cast("long"),
        "n_dropped": F.when(F.col(lines).isNull(), 0).otherwise(full(lines) - full(kept)).cast("long"),
    }).drop(own_host, lines, bad_lines, salt, kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def page_text(html: Column) -> Column:
    """The text of a page, a line feed for each tag."""
    return F.regexp_replace(html, "<[^>]*>", "\n")


#: The same for the table ``pages`` by DuckDB.
SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '') AS host,
         string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS lines FROM pages),
l AS (SELECT r, host, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM p),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
c AS (SELECT host, key, count(*) AS n FROM (SELECT DISTINCT r, host, key FROM k WHERE key <> '') GROUP BY host, key),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
bad AS (SELECT host, key FROM c JOIN t USING (host) WHERE n >= 5 AND n > pages * 0.1),
o AS (SELECT k.r, count(*) FILTER (WHERE k.key <> '') AS n_lines, count(bad.key) AS n_dropped,
        coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE bad.key IS NULL), '') AS text
      FROM k LEFT JOIN bad ON bad.host = k.host AND bad.key = k.key GROUP BY k.r)
SELECT p.page_id, p.host, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, o.text FROM p LEFT JOIN o ON o.r = p.r
"""
