"""Line deduplication by winnowing over line hashes, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, keyed, real_id

#: Lines of a gram and grams of a winnowing window: any common run of GRAM + WINDOW - 1 lines has a common fingerprint.
GRAM, WINDOW = 2, 2
#: Lines of the shortest run that is deleted whatever its words.
SHORTEST = GRAM + WINDOW - 1
#: Words from which a run of fewer lines is deleted too.
LONG = 50


def line_table(rows: DataFrame) -> DataFrame:
    """doc, twin, hashes and words: of the lines that hold more than white space, in order, trimmed."""
    lines = F.transform(F.split("text", "\n"), trimmed)
    rows = rows.select("doc", "twin", F.filter(lines, lambda x: x != "").alias("full"))
    return rows.select("doc", "twin", F.transform("full", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("full", lambda x: F.size(F.split(x, "[ \t\x0b\x0c\r]+"))).alias("words"))


def window_minima(hashes: Column) -> Column:
    """Places and hashes of the grams that are the least (the last of equals) of some window of grams."""
    count = F.size(hashes) - (GRAM - 1)
    gram = lambda i: F.xxhash64(F.slice(hashes, i + 1, GRAM))
    grams = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(gram(i).alias("gram"), (-i).alias("back")))
    chosen = F.transform(F.sequence(F.lit(0), F.greatest(count - WINDOW, F.lit(0))), lambda j: F.array_min(F.slice(grams, j + 1, WINDOW)))
    return F.when(count > 0, F.array_distinct(chosen))


def marks_of(hashes: Column, words: Column) -> Column:
    """Fingerprints of a document as (gram, at, lines): the winnowed grams, and the pairs of lines and single lines that have LONG words."""
    gram = lambda n: lambda at: F.struct(F.xxhash64(F.slice(hashes, at + 1, n)).alias("gram"), at.alias("at"), F.lit(n).alias("lines"))
    long = lambda n: F.filter(F.transform(words, lambda x, i: F.when(is_long(words, i, n), i)), lambda i: i.isNotNull())
    winnowed = F.transform(window_minima(hashes), lambda m: F.struct(m["gram"].alias("gram"), (-m["back"]).alias("at"), F.lit(GRAM).alias("lines")))
    return F.array_distinct(F.concat(F.coalesce(winnowed, F.array()), *[F.transform(long(n), gram(n)) for n in range(1, SHORTEST)]))


def is_long(words: Column, at: Column, n: int) -> Column:
    """Whether n lines from here exist and have LONG words together."""
    return (at + n <= F.size(words)) & (sum((F.get(words, at + k) for k in range(1, n)), F.get(words, at)) >= LONG)


def shared_marks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, twin, marks): places and lines of each document's fingerprints that stand elsewhere too."""
    marks = lines.select("doc", "twin", F.explode(marks_of(F.col("hashes"), F.col("words"))).alias("m")).select("doc", "twin", "m.*")
    marks = scratch.save(marks, "marks")
    shared = marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return marks.join(shared, "gram").groupBy("doc", "twin").agg(F.collect_set(F.struct("at", "lines")).alias("marks"))


def pieces(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(run, doc, twin, at): runs around shared fingerprints, as their line hashes, with all their places in a document.

    The runs are those of SHORTEST lines and the shorter ones of LONG words. Equal runs have their
    fingerprint at the same place, so a run that stands twice is found from either."""
    here = lines.dropDuplicates(["doc", "twin"])
    both = here.join(shared_marks(lines, scratch), ["doc", "twin"])
    piece = lambda at, n: F.struct(at.alias("at"), F.lit(n).alias("n"))
    around = lambda m: F.when(m["lines"] == GRAM, F.array(*[piece(m["at"] - k, SHORTEST) for k in range(WINDOW)], piece(m["at"], GRAM))).otherwise(F.array(piece(m["at"], 1)))
    fits = lambda p: (p["at"] >= 0) & F.when(p["n"] == SHORTEST, p["at"] + SHORTEST <= F.size("hashes")).when(p["n"] == GRAM, is_long(F.col("words"), p["at"], GRAM)).otherwise(True)
    begins = F.array_distinct(F.filter(F.flatten(F.transform("marks", around)), fits))
    found = both.select("doc", "twin", F.explode(F.transform(begins, lambda p: F.struct(F.slice("hashes", p["at"] + 1, p["n"]).alias("run"), p["at"].alias("at")))).alias("p"))
    return found.select(F.col("p.run").alias("run"), "doc", "twin", F.col("p.at").alias("at")).groupBy("run", "doc", "twin").agg(F.collect_set("at").alias("at"))


def repeated_lines(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, twin, gone): places of each document's lines that are in a later run.

    A run of more than SHORTEST lines is the union of its runs of SHORTEST lines, so it is enough to
    know for each of these, and for the shorter ones of LONG words, whether it stood earlier: in a
    smaller doc, or before in the same document.
    The smallest doc of each run is aggregated and joined back, so a passage that a third of all
    documents hold costs one row a document, not a pair of documents."""
    found = scratch.save(pieces(lines, scratch), "pieces")
    first = found.groupBy("run").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = found.join(first, "run", "left")
    later = F.when(F.col("first") < F.col("doc"), F.col("at")).otherwise(F.array_except("at", F.array(F.array_min("at"))))
    gone = joined.select("doc", "twin", F.explode(F.flatten(F.transform(later, lambda i: F.sequence(i, i + F.size("run") - 1)))).alias("at"))
    return gone.groupBy("doc", "twin").agg(F.collect_set("at").alias("gone"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def without(text: Column, gone: Column) -> Column:
    """The text without those of its full lines whose places are given; blank lines stay."""
    lines = F.split(text, "\n")
    full = F.filter(F.transform(lines, lambda x, i: F.when(trimmed(x) != "", i)), lambda i: i.isNotNull())
    drop = F.transform(gone, lambda k: F.element_at(full, k + 1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")


def deduplicated(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows of docs as doc_id, text (without later repeated runs), n_lines, n_removed and the given columns."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = keyed(docs, *[F.col(c) for c in columns])
    lines = scratch.save(line_table(rows), "lines")
    gone = scratch.save(repeated_lines(lines, scratch), "gone")
    scratch.drop("lines", "marks", "pieces")
    # Merged at every size: the text side never depends on whether the other would fit a broadcast.
    joined = rows.join(gone.hint("merge"), ["doc", "twin"], "left")
    changed = F.col("gone").isNotNull()
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: trimmed(x) != "")).cast("long")
    return joined.select(
        real_id().alias("doc_id"),
        F.when(changed, without(F.col("text"), F.col("gone"))).otherwise(F.col("text")).alias("text"),
        n_lines.alias("n_lines"),
        F.when(changed, F.size("gone")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        *[F.col(c) for c in columns],
    )


def remove_repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every row.

    A line is trimmed of ASCII white space; lines without anything else are never counted nor
    removed. Grams of GRAM lines are hashed and the minima of windows of WINDOW grams are a
    document's fingerprints, with each line and pair of lines of LONG words (parts between white
    space). Every run of at least SHORTEST lines or LONG words that stood earlier (in any document with a smaller doc_id, null smallest; or before in the same document, where the two may overlap) is
    deleted. Whatever runs of SHORTEST lines have one fingerprint at least, and each run of SHORTEST
    lines around a fingerprint is compared with the first place of that very run, so none is missed.

    Null and empty texts have no lines; rows that repeat a doc_id and text are one document and get the
    same result; rows that repeat a doc_id with other texts are not compared; texts with fewer lines
    than SHORTEST and words than LONG lose nothing; an empty table gives no rows; other columns are ignored."""
    return deduplicated(docs)
