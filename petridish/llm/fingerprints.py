"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the words whose document frequency lies in a band. A document's distinct words
in the lexicon are sorted, and those in each of several randomised subsets of the lexicon are
hashed together. The subsets are REPEATS independent draws at LEVELS densities, from a half of the
lexicon down, so that short and long documents both have subsets with a few words.

The lexicon is sent to all tasks: at most COMMON * mean distinct words per document can reach the
lower end of the band, whatever the number of documents; its size is checked all the same, and a
larger one is joined by shuffling. Each document is shuffled once, to its neighbours by doc_id.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petridish.llm import shared

#: The band: words in at least one of COMMON documents and two of them, at most one of RARE.
COMMON, RARE = 2000, 20
REPEATS, LEVELS = 4, 8
#: Lexicon words up to which it is broadcast.
SENT = 1_000_000
#: Characters of a subset's part of a fingerprint: of the hash, and of the number of its words.
HASH, SIZE = 8, 3
#: Divided by the words of a subset, this is its weight in a likeness.
WEIGHT = 840
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Distinct lower-cased words, runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def lexicon(docs: DataFrame) -> DataFrame:
    """(word, levels): words in the band, and to which density each draw keeps them.

    levels has four bits for each draw; 0 there means that it keeps the word at no density.
    """
    counts = (
        docs.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("df"))
    )
    n = docs.count()
    df = F.col("df")
    kept = counts.filter((df >= 2) & (df * COMMON >= n) & (df * RARE <= n))
    draws = []
    for r in range(REPEATS):
        spot = F.substring(F.md5(F.col("word").cast("binary")), 4 * r + 1, 4)
        level = F.lit(0)
        for below in range(1, LEVELS + 1):
            level = F.when(spot < f"{65536 >> below:04x}", below).otherwise(level)
        draws.append(F.shiftleft(level, 4 * r))
    return shared.materialise(kept.select("word", sum(draws[1:], draws[0]).alias("levels")))


def _with_fingerprints(
    rows: DataFrame, keys: list[str], info: list[str], sets: list[str], lex: DataFrame
) -> DataFrame:
    """Replace the columns `sets` (one or two arrays of distinct words) by their fingerprints.

    Rows are told apart by `keys`; the columns in `info` are kept. Words are looked up one by one
    and gathered again where the rows already are: nothing is shuffled if these are dealt by a key.
    """
    element = lambda mask: lambda x: F.struct(F.lit(mask).alias("sets"), x.alias("word"))
    if len(sets) == 1:
        lists = [F.transform(sets[0], element(1))]
    else:  # a word of both sets is looked up once
        a, b = sets
        lists = [
            F.transform(F.array_intersect(a, b), element(3)),
            F.transform(F.array_except(a, b), element(1)),
            F.transform(F.array_except(b, a), element(2)),
        ]
    # one more element keeps the other columns, and rows without words
    mark = F.array(F.struct(F.lit(0).alias("sets"), F.lit("").alias("word")))
    own = F.struct(*info) if info else F.struct(F.lit(0).alias("_none"))
    each = rows.select(*keys, own.alias("info"), F.explode(F.concat(mark, *lists)).alias("x"))
    each = each.select(*keys, F.when(F.col("x.sets") == 0, F.col("info")).alias("info"), "x.*")
    sent = F.broadcast(lex) if lex.count() <= SENT else lex
    each = each.join(sent, "word", "left").filter("levels is not null or sets = 0")
    found = each.groupBy(*keys).agg(
        F.max("info").alias("info"),
        *[
            F.array_sort(
                F.collect_list(
                    F.when(F.col("sets").bitwiseAND(1 << i) > 0, F.struct("word", "levels"))
                )
            ).alias(c)
            for i, c in enumerate(sets)
        ],
    )
    kept = lambda r, n: lambda x: F.shiftright(x["levels"], 4 * r).bitwiseAND(15) >= n
    for level in range(1, LEVELS + 1):
        # each density keeps a part of the words of the one before
        found = found.select(
            "*",
            *[
                F.filter(f"{c}_{r}_{level - 1}" if level > 1 else c, kept(r, level)).alias(
                    f"{c}_{r}_{level}"
                )
                for c in sets
                for r in range(REPEATS)
            ],
        )
    return found.select(
        *keys,
        *[F.col("info")[c].alias(c) for c in info],
        *[
            F.concat(
                *[_part(F.col(f"{c}_{r}_{n}")) for r in range(REPEATS) for n in range(1, LEVELS + 1)]
            ).alias(c)
            for c in sets
        ],
    )


def _part(own: Column) -> Column:
    joined = F.array_join(F.transform(own, lambda x: x["word"]), " ").cast("binary")
    size = F.lpad(F.least(F.size(own), F.lit(10**SIZE - 1)).cast("string"), SIZE, "0")
    return F.when(F.size(own) == 0, "0" * (HASH + SIZE)).otherwise(
        F.concat(F.substring(F.md5(joined), 1, HASH), size)
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with the same words, those with fewer words weighing more; 0 to 1.

    Subsets without words in both count for nothing; two fingerprints without any words are alike.
    """
    step = HASH + SIZE

    def sums(have: Column, i: Column) -> Column:
        one, two = (F.substring(x, i * step + 1, F.lit(step)) for x in (a, b))
        size = F.greatest(
            *[F.substring(x, i * step + 1 + HASH, F.lit(SIZE)).cast("int") for x in (a, b)]
        )
        weight = F.when(size == 0, 0).otherwise(
            F.greatest(F.lit(1), F.floor(F.lit(WEIGHT) / size)).cast("int")
        )
        return F.struct(
            (have["same"] + F.when(one == two, weight).otherwise(0)).alias("same"),
            (have["all"] + weight).alias("all"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(REPEATS * LEVELS - 1)),
        F.struct(F.lit(0).alias("same"), F.lit(0).alias("all")),
        sums,
        lambda x: F.when(x["all"] == 0, F.lit(1.0)).otherwise(x["same"] / x["all"]),
    )


def fingerprints(docs: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint) of each whole text; rows with one doc_id and text are given once."""
    lex = lexicon(docs) if lex is None else lex
    rows = docs.select(
        "doc_id", F.sha2("text", 256).alias("_digest"), words(F.coalesce("text", F.lit(""))).alias("fingerprint")
    )
    rows = rows.dropDuplicates(["doc_id", "_digest"])
    keys = ["doc_id", "_digest"]
    return _with_fingerprints(rows, keys, [], ["fingerprint"], lex).drop("_digest")


def _by_neighbours(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a bucket that is a range of doc_id, and the first text of each next bucket.

    Buckets are cut at quantiles of doc_id, so each holds about as many documents; a null id comes
    first. After the last bucket comes the first.
    """
    spark = docs.sparkSession
    number = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))
    shares = [i / number for i in range(1, number)]
    cuts = docs.select(place.alias("x")).agg(F.percentile_approx("x", shares, 20 * number)).first()[0]
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
    )
    # a whole number, as a double would be rewritten, and dealt anew, as a key of groups
    bucketed = bucketed.withColumn("bucket", F.col("bucket").cast("int"))
    least = bucketed.groupBy("bucket").agg(F.min("place").alias("place"))
    order = sorted(r["bucket"] for r in least.select("bucket").collect())
    before = dict(zip(order, [order[-1], *order[:-1]])) if order else {}
    pairs = spark.createDataFrame(list(before.items()) or [(0, 0)], "bucket int, to int")
    # one row per bucket
    firsts = (
        bucketed.join(F.broadcast(least), ["bucket", "place"])
        .groupBy("bucket")
        .agg(F.min("text").alias("first_text"))
        .join(F.broadcast(pairs), "bucket")
        .select(F.col("to").alias("bucket"), "first_text")
    )
    return bucketed.drop("place"), shared.materialise(firsts)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they are.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as
    many of the next document by doc_id, or all that it has; the first follows the last. A null text
    counts as empty. Rows with one doc_id follow each other by text, a null doc_id comes first. A
    single document is its own next. An empty table gives an empty result; only doc_id and text are
    read.
    """
    lex = lexicon(docs)
    bucketed, firsts = _by_neighbours(docs)
    own = _with_fingerprints(
        firsts.select("bucket", words(F.col("first_text")).alias("first_print")),
        ["bucket"],
        [],
        ["first_print"],
        lex,
    )
    firsts = firsts.join(own, "bucket")
    by_id = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = bucketed.select(
        "bucket",
        "doc_id",
        "text",
        F.row_number().over(by_id).alias("place"),
        F.lead("text").over(by_id).alias("next_text"),
    )
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    rows = rows.join(firsts.select("bucket", "first_text"), "bucket").select(
        "bucket",
        "place",
        "doc_id",
        size.cast("long").alias("n_chars"),
        "text",
        F.concat(
            F.substring("text", F.lit(1), size - quarter),
            F.substring(F.coalesce("next_text", "first_text"), F.lit(1), quarter),
        ).alias("edited"),
    )
    rows = rows.select(
        "bucket",
        "place",
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        words(F.col("text")).alias("fingerprint"),
        words(F.col("edited")).alias("edited_fingerprint"),
    )
    found = _with_fingerprints(
        rows,
        ["bucket", "place"],
        ["doc_id", "n_chars", "edited_sha256"],
        ["fingerprint", "edited_fingerprint"],
        lex,
    )
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    return (
        found.withColumn("following", following)
        .join(firsts.select("bucket", "first_print"), "bucket")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.coalesce("following", "first_print")).alias("near_next"),
        )
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(shared.read(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rule in DuckDB SQL, for a table with distinct ids."""
    draws = ", ".join(
        "(case " + " ".join(
            f"when substr(md5(word), {4 * r + 1}, 4) < '{65536 >> n:04x}' then {n}"
            for n in range(LEVELS, 0, -1)
        ) + " else 0 end)"
        for r in range(REPEATS)
    )
    step = HASH + SIZE
    parts = " || ".join(
        f"coalesce(substr(md5(string_agg(word, ' ' order by word) filter (levels[{r + 1}] >= {n})), 1, {HASH})"
        f" || lpad(least(count(*) filter (levels[{r + 1}] >= {n}), {10**SIZE - 1})::varchar, {SIZE}, '0'),"
        f" '{'0' * step}')"
        for r in range(REPEATS)
        for n in range(1, LEVELS + 1)
    )
    empty = "0" * step * REPEATS * LEVELS

    def like(a: str, b: str) -> str:
        size = f"greatest(substr({a}, i * {step} + {HASH + 1}, {SIZE})::int, substr({b}, i * {step} + {HASH + 1}, {SIZE})::int)"
        weight = f"(case when {size} = 0 then 0 else greatest(1, {WEIGHT} // {size}) end)"
        same = f"substr({a}, i * {step} + 1, {step}) = substr({b}, i * {step} + 1, {step})"
        every = f"list_sum([{weight} for i in range(0, {REPEATS * LEVELS})])"
        alike = f"list_sum([case when {same} then {weight} else 0 end for i in range(0, {REPEATS * LEVELS})])"
        return f"case when {every} = 0 then 1.0::double else {alike}::double / {every}::double end"

    return f"""
with d as (
  select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id) as p,
    count(*) over () as n from documents
), e as (
  select d.doc_id, d.p, x.p as q, d.text, length(d.text) as n_chars,
    substr(d.text, 1, length(d.text) - length(d.text) // 4)
      || substr(x.text, 1, length(d.text) // 4) as edited
  from d join d x on x.p = d.p % d.n + 1
), own as (select p, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) as word from d),
edits as (select p, unnest(list_distinct(regexp_extract_all(lower(edited), '{WORD}'))) as word from e),
lex as (
  select word, [{draws}] as levels from (
    select word, count(*) as df from own group by word
  ) where df >= 2 and df * {COMMON} >= (select count(*) from d) and df * {RARE} <= (select count(*) from d)
), a as (select p, {parts} as f from own join lex using (word) group by p),
b as (select p, {parts} as f from edits join lex using (word) group by p),
f as (
  select e.*, coalesce(a.f, '{empty}') as fingerprint, coalesce(b.f, '{empty}') as edited_fingerprint,
    coalesce(c.f, '{empty}') as following
  from e left join a on e.p = a.p left join b on e.p = b.p left join a c on e.q = c.p
)
select doc_id, n_chars, sha256(edited) as edited_sha256, fingerprint, edited_fingerprint,
  {like('fingerprint', 'edited_fingerprint')} as near_edited,
  {like('fingerprint', 'following')} as near_next
from f
"""


SQL = _sql()
