"""Spelling variants by permuterm rotations.

A word is closed by a terminator and turned to every rotation. Two words that differ in one character share a rotation
but for that character: turned so that the edited place comes last, one rotation is the other with its last character
exchanged, or dropped. So all rotations are sorted by what precedes the edited place, and words that meet under one such
prefix are one edit apart. A prefix and the length of its rotations fix all but one character, so a group holds at most
as many words as the alphabet has letters, and one more; it is scanned once and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.session import cut_lineage

#: Closes a word; words must not hold it.
TERMINATOR = "\u0000"
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is this many times as frequent as its variant, at least.
TIMES = 10


def runs(docs: DataFrame, identifier: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """`(id, run)`: each maximal run of letters of at least `least` characters, A to Z lower-cased, as often as it stands.

    Null and empty texts have no runs. Other columns are not read. Greedy matching takes a run whole, and a run too short
    to match is left whole.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    small = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(identifier).alias("id"), F.explode(found).alias("run"))
    return rows.select("id", small.alias("run"))


def slipped(identifier: Column, run: Column, every: int = 31) -> Column:
    """The run, less one character where the checksum of id and run is a multiple of `every`: made misspellings that any
    engine can repeat. A run whose id is null stays as it is."""
    checksum = F.crc32(F.concat(identifier.cast("string"), F.lit(":"), run).cast("binary"))
    place = F.pmod(checksum, F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))
    return F.when(checksum % every == 0, shorter).otherwise(run)


def vocabulary(words: DataFrame, word: str = "word", length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """`(word, n)`: the different words of `length` characters or more that stand `least` times or more. Null is no word.

    Counted in the tasks that read them first, so a word that fills the corpus costs a row a task.
    """
    long = words.where(F.char_length(word) >= length).select(F.col(word).alias("word"))
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """`(key, skips, opens, word, n)`: each rotation of each closed word, whole and without its last character.

    Whole, a rotation is the key under which the word lacks a character; without the last one, the key under which that
    character is exchanged or too much. `opens` marks the first character of a run of equal ones: a word that is longer by
    one of them meets the shorter one there and nowhere else.
    """
    size, word = F.char_length("word"), F.col("word")

    def turned(after: Column, before: Column) -> Column:
        return F.concat(F.substring(word, after + 1, size), F.lit(TERMINATOR), F.substring(word, F.lit(1), before))

    def character(i: Column) -> Column:
        return F.substring(word, i + 1, F.lit(1))

    whole = F.transform(
        F.sequence(F.lit(0), size), lambda i: F.struct(turned(i, i).alias("key"), F.lit(False).alias("skips"), F.lit(False).alias("opens"))
    )
    skipping = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            turned(i + 1, i).alias("key"), F.lit(True).alias("skips"), ((i == 0) | (character(i) != character(i - 1))).alias("opens")
        ),
    )
    return words.select(F.inline(F.concat(whole, skipping)), "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """`(word, n_near, best)`: how many of `words` are one edit away, and of these the one of largest `n`, among equals the
    smallest, as `best.less` (minus n) and `best.word`. Words without such have no row.

    `words` are different and not empty. One sort by key brings each group together, most frequent words first, and
    each row sees the head of its group.
    """
    order = [F.desc("skips"), F.desc("n"), "word"]
    group = Window.partitionBy("key").orderBy(*order)
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    scanned = rotations(words).select(
        "word",
        "skips",
        "opens",
        F.row_number().over(group).alias("place"),
        F.count_if(F.col("skips")).over(every).alias("longer"),
        F.count_if(F.col("opens")).over(every).alias("openings"),
        F.count_if(~F.col("skips")).over(every).alias("shorter"),
        F.first(F.when(F.col("skips"), own), True).over(every).alias("head"),
        F.nth_value(F.when(F.col("skips"), own), 2).over(every).alias("next"),
        F.first(F.when(F.col("opens"), own), True).over(every).alias("opening"),
        F.first(F.when(~F.col("skips"), own), True).over(every).alias("short"),
    )
    exchanged = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("head"))
    dropped = F.when(F.col("opens"), F.col("short"))
    met = scanned.where(F.col("longer") + F.col("shorter") > 1).select(
        "word",
        F.when(F.col("skips"), F.col("longer") - 1 + F.when(F.col("opens"), F.col("shorter")).otherwise(0)).otherwise(F.col("openings")).alias("met"),
        F.when(F.col("skips"), F.least(exchanged, dropped)).otherwise(F.col("opening")).alias("best"),
    )
    return met.where(F.col("met") > 0).groupBy("word").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)` for each row of `words(word, n)`.

    `form` is the most frequent word one edit away (among equals the smallest), if `n` is `times` the word's own at least;
    `root` follows the forms to the last and is the word itself where it has none. `words` must be different, without
    nulls or empty ones, as `vocabulary` gives them; an empty table gives no rows.
    """
    words = cut_lineage(words.select("word", "n"))
    near = words.join(neighbours(words), "word", "left")
    frequent = -F.col("best.less") >= times * F.col("n")
    told = near.select(
        "word",
        F.when(frequent, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    told = cut_lineage(told)
    return told.join(roots(told.where(F.col("form").isNotNull()).select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(forms: DataFrame) -> DataFrame:
    """`(word, root)`: the end of each word's chain in `forms(word, form)`.

    Every round doubles the steps taken. A form is more frequent than its word by a factor, so chains are as long as
    the logarithm of the largest count at most, and few rounds do.
    """
    ends = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = ends.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        stepped = cut_lineage(stepped)
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        ends = stepped.select("word", "root")


_POLYNOMIAL = 0xEDB88320

ORACLE = f"""
WITH RECURSIVE step0 AS (SELECT r AS b, r::BIGINT AS c, 0 AS k FROM range(256) t(r)),
bits AS (
  SELECT * FROM step0 UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, {_POLYNOMIAL}::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS u FROM documents)),
counted AS (SELECT doc_id, w, count(*) AS m FROM runs WHERE length(w) >= 7 GROUP BY ALL),
summed AS (
  SELECT w, m, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(doc_id || ':' || w))) // 2),
      lambda i: ('0x' || substr(hex(encode(doc_id || ':' || w)), 2 * i + 1, 2))::BIGINT)),
    lambda acc, b: xor(acc >> 8, t[xor(acc, b) % 256 + 1])), 4294967295::BIGINT) AS h
  FROM counted, tab),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, m FROM summed),
vocab AS (SELECT word, sum(m)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || '_' || substr(word, i + 2) AS gap, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS top FROM near GROUP BY word),
named AS (
  SELECT best.word, n_near, top, min(other) AS other FROM best JOIN near ON near.word = best.word AND m = top GROUP BY ALL),
told AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN other END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM vocab v LEFT JOIN named USING (word)),
chain AS (
  SELECT word, word AS ending, 0 AS k FROM told UNION ALL
  SELECT chain.word, told.form, k + 1 FROM chain JOIN told ON told.word = chain.ending WHERE told.form IS NOT NULL),
ended AS (SELECT word, max_by(ending, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM told JOIN ended USING (word)
"""
