"""Line dedup over content-defined chunks of lines, in DataFrame operations only.

Each line is hashed, and a rolling hash runs over the hashes of ``WINDOW`` lines.
A chunk ends where the rolling hash is lower than at its neighbours, so boundaries
depend on nearby lines only and move with inserted or deleted ones, and a chunk
has two lines at least (all lines of a shorter text).  A chunk of two or more
lines that occurs more than once in the corpus stays at its first place (smallest
id, then hash of the text, then first line) and goes elsewhere, once its bytes
equal those of the first.  Counting shuffles hashes only and combines before the
shuffle, so a chunk held by a third of all documents is one row for each task;
where chunks then meet their first place, the few chunks with over a thousandth of
all rows are spread over ``SALTS`` keys.

Edge cases: a null text stays null; an empty text is one empty line; a text of
one line never changes; a text whose chunks all go becomes empty; rows with the
same id and the same text count as one document, and are all kept or changed
alike; a null id counts as the smallest; other columns pass through, but for the
two that are added, which replace columns of the same names; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoflow.llm._common import OWN, Scratch, free_name

#: Lines under the rolling hash.
WINDOW = 2
#: Keys over which a very frequent chunk is spread.
SALTS = 32
_BASE, _PRIME = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    """31 bits of the line's md5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(_PRIME))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later expressions read instead of repeating (inlining would make lambdas quadratic)."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, version, start, n_lines, chunk) of every text; joined by line feeds, a text's chunks give it back.

    version is a hash that tells apart texts of the same id.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.split(text_col, "\n", -1).alias("lines"))
    rows = _held(rows, "hashes", F.transform("lines", line_hash))
    rolled = F.col("hashes")
    for back in range(1, WINDOW):
        before = F.concat(F.array_repeat(F.lit(0).cast("long"), back), F.slice("hashes", 1, F.greatest(F.size("hashes") - back, F.lit(0))))
        rolled = F.zip_with(rolled, before, lambda a, b: (a * _BASE + b) % _PRIME)
    rows = _held(rows, "rolled", rolled)
    last = F.size("lines") - 1
    lower = lambda r, i: (r < F.get("rolled", i - 1)) & (r <= F.get("rolled", i + 1))
    ends = F.filter(F.transform("rolled", lambda r, i: F.when((i == last) | (i.between(1, last - 2) & lower(r, i)), i)), lambda i: i.isNotNull())
    rows = _held(rows, "ends", ends)
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get("ends", j - 1) + 1)
    cut = F.transform("ends", lambda e, j: F.struct(begin(j).alias("start"), (e - begin(j) + 1).alias("n_lines"), F.array_join(F.slice("lines", begin(j) + 1, e - begin(j) + 1), "\n").alias("chunk")))
    return rows.select("id", "version", F.explode(cut).alias("c")).select("id", "version", "c.start", "c.n_lines", "c.chunk")


def _salted(rows: DataFrame, hot: Column) -> DataFrame:
    """Each row once for every salt if it is hot, else under salt 0."""
    all_salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return rows.withColumn("salt", F.explode(F.when(hot, all_salts).otherwise(F.array(F.lit(0)))))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, version, start, n_lines) of the chunks to remove."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    place, key = F.struct("id", "version", "start"), ["hash", "check"]
    many = chunks(docs, id_col, text_col).where("n_lines >= 2").withColumns({"hash": F.xxhash64("chunk"), "check": F.xxhash64(F.lit(1), "chunk")})
    firsts = many.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last")
    firsts = scratch.keep(firsts.drop("last"), "firsts")
    limit = (firsts.agg(F.sum("n")).first()[0] or 0) // 1000
    # Fewer than a thousand chunks can have over a thousandth of all rows.
    hot = firsts.where(F.col("n") > limit).select(*key, F.lit(True).alias("hot"))
    rows = many.join(F.broadcast(hot), key, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "version", "start"), F.lit(SALTS)).cast("int")).otherwise(0))
    some = rows.join(_salted(firsts.drop("n").join(F.broadcast(hot), key, "left"), F.col("hot")).drop("hot"), [*key, "salt"])
    some = some.withColumn("is_first", place.eqNullSafe(F.col("first"))).drop("first")
    some = scratch.keep(some, "repeated")  # a small part of the text; read twice
    source = _salted(some.where("is_first").select(*key, "hot", F.col("chunk").alias("source")).dropDuplicates(key), F.col("hot")).drop("hot")
    return some.where("not is_first").join(source, [*key, "salt"]).where("chunk = source").select("id", "version", "start", "n_lines").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with repeated chunks cut out of the text.

    Two columns are added: ``__ethoflow_removed_chunks`` and ``__ethoflow_removed_lines``.
    """
    own = {n: OWN + n for n in ("removed_chunks", "removed_lines")}
    docs = docs.drop(*own.values())
    own |= {n: free_name(docs, OWN + n) for n in ("gone", "id", "version", "lines")}
    gone = repeats(docs, id_col, text_col).groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "n_lines"))).alias(own["gone"]))
    gone = gone.withColumnsRenamed({"id": own["id"], "version": own["version"]})
    same = docs[id_col].eqNullSafe(gone[own["id"]]) & (F.xxhash64(docs[text_col]) == gone[own["version"]])
    rows = docs.join(gone, same, "left").select(*(docs[c] for c in docs.columns), gone[own["gone"]])
    cut = F.col(own["gone"])
    rows = _held(rows, own["lines"], F.when(cut.isNotNull(), F.split(text_col, "\n", -1)))
    # What is left are the stretches before, between and after the removed chunks; each is cut out once.
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get(cut, j - 1)["start"] + F.get(cut, j - 1)["n_lines"])
    end = lambda j: F.when(j == F.size(cut), F.size(own["lines"])).otherwise(F.get(cut, j)["start"])
    whole = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda j: F.when(end(j) > begin(j), F.array_join(F.slice(own["lines"], begin(j) + 1, end(j) - begin(j)), "\n")))
    text = F.when(cut.isNull(), F.col(text_col)).otherwise(F.array_join(F.array_compact(whole), "\n"))
    return rows.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.coalesce(F.when(cut.isNotNull(), F.size(cut)), F.lit(0)).cast("long").alias(own["removed_chunks"]),
        F.coalesce(F.aggregate(cut, F.lit(0).cast("long"), lambda n, g: n + g["n_lines"]), F.lit(0).cast("long")).alias(own["removed_lines"]),
    )
