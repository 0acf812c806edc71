"""How filters interact: every order of five filters replayed over every document.

Each document's failure conditions are computed once and written as five bits. These flags are crossed with the 120 orders (a broadcast table of 120 rows,
whatever the input), each pair gets the step of its first failure, its five steps are exploded, and conditional sums by part, order and step
follow in the same stage: the 600 rows of a document go straight into the task's partial sums, so what is shuffled is a row a task, part, order and step.

Column functions only. Equal texts meet by SHA-256, as least ids by digest (combined map-side); a digest that one row alone has goes no further.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, release, spread

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS, HOT = 50, 65, 5, "[#$%&*|]", 1000
_WHITE = r"[ \t\n\x0B\f\r]+"


def conditions(text: Column) -> list[Column]:
    """The failure conditions A to D of a text that isn't null."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"), text.rlike(SYMBOLS),
    ]


def flags(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails: a bit for each filter from the right, good, toxic) of each row.

    A null text is ''. A row fails E if a row of a smaller id has the same text; a row without an id has no smaller one and is smaller than none. Of several
    labels of one id any 1 counts; a null label, another value and a row without labels count as 0.
    """
    rows = spread(docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part")))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions(F.col("text")))]
    own = cut(rows.select("id", "part", sum(bits[1:], bits[0]).alias("bits"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    least = own.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null")
    # a text may have a third of all rows. Of texts that have more than one row in HOT there are fewer than HOT: broadcast, and their rows stay out of the join
    often = F.col("n") * HOT > own.count()
    hot, rest = least.where(often).select("digest", F.col("least").alias("hot")), least.where(~often).select(F.col("digest").alias("key"), "least")
    keyed = own.join(F.broadcast(hot), "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("id")))))
    judged = keyed.join(rest, "key", "left").select("id", "part", (F.col("bits") + F.when(F.col("id") > F.coalesce("hot", "least"), 1 << 4).otherwise(0)).alias("fails"))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("id")).agg(one("quality"), one("toxic"))
    out = judged.join(marks, "id", "left").select("part", "fails", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    out._cut_path = own._cut_path
    return out


def orders(spark) -> DataFrame:
    """The 120 orders: (filter_order, b1 to b5: the bit of each step's filter)."""
    rows = [("".join(p), *(1 << FILTERS.index(x) for x in p)) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"b{k} int" for k in range(1, 6)))


def replay(flagged: DataFrame) -> DataFrame:
    """A row a part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    fails, step, bit = F.col("fails"), F.col("step"), F.col("bit")
    first = F.lit(6)
    for k in range(5, 0, -1):
        first = F.when(fails.bitwiseAND(F.col(f"b{k}")) != 0, k).otherwise(first)
    pairs = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession))).withColumn("first", first)
    steps = pairs.select("part", "filter_order", "fails", "good", "toxic", "first", F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"b{k}").alias("bit")) for k in range(1, 6)])))
    here, count = F.col("first") == step, lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    sums = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > step, "kept"), count(here, "removed"), count((fails.bitwiseAND(bit) != 0) & (F.col("first") < step), "redundant"),
        count(fails == bit, "unique_fails"), count(here & (F.col("good") == 1), "good_lost"), count(here & (F.col("toxic") == 1), "toxic_lost"),
    )
    return sums.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a part (each value of ``part_col``; null: ''), filter_order and step (1 to 5), zeros included, with long counts of the part's rows: kept (after
    this step), removed (here), redundant (failing the step's filter, removed before), unique_fails (failing this filter alone), good_lost and toxic_lost
    (removed here with label 1), shapley (removed by the step's filter, summed over all orders).

    Failure conditions (``conditions`` and ``flags``): A few words, B few distinct words, C many capitals, D a symbol, E the text of a smaller id. Each row is a document,
    repeated or not. Texts are judged whole, however long; empty ones fail A alone, or A and E. An empty table gives an empty result. Other columns aren't read,
    whatever their names. Writes the flags once, when called.
    """
    flagged = flags(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    sums = cut(replay(flagged))  # parts * 600 rows
    release(flagged)
    values = sums.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return sums.join(values, ["part", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, len(ws) < 50 AS A, 100 * len(list_distinct(ws)) < 65 * len(ws) AS B, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS C,
        regexp_matches(t, '[#$%&*|]') AS D, coalesce(w.doc_id > least, false) AS E, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
s AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END) AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
p AS (SELECT part, filter_order, unnest(range(1, 6)) AS step, fails, good, toxic, n, coalesce(list_min(list_transform(fails, lambda y: strpos(filter_order, y))), 6) AS first FROM s, o),
q AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS letter,
        sum(CASE WHEN first > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN list_contains(fails, filter_order[step]) AND first < step THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = [filter_order[step]] THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN first = step AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN first = step AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM p GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM q
"""
