"""Line dedup by a log-template tree of fixed depth, as DataFrame functions only.

The tree's levels are a line's number of tokens and its leading tokens; a token with a digit is a variable field
from the start.  A leaf holds as many templates as its lines have: two neighbouring tokens, in their place, are constant
if they recur there in ``needed`` documents (a document counts once for a pair, whichever of its lines hold it), and what
isn't constant is a variable field.  A line follows a template of its leaf if at least ``similarity`` of its neighbours after
the leading tokens are constant.  Such lines are dropped, and so are lines that occur in ``needed`` documents
just so, digits masked.  More documents only add constants, so growth and unrelated lines turn no template off.

``needed`` falls with a line's length: a sentence of five words may well be in ten documents, one of fifty words
recurs in two by no accident.  For lines under ``long_line`` tokens it is a share of all documents at least, so that in a
large corpus common short sentences stay.

Lines travel as hashes: counts combine before the shuffle, and tokens are exploded only for leaves that occur in enough
documents and hold lines that the plain count leaves open.  Defined results: a null text has no line and stays null; blank
lines are no template and stay; repeated rows and ids count as one document; rows with a null id are a document for each
different text; of several lines of a leaf in one document all count, in any order; a very long text is split whole; extra
columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrove.llm.common import materialise, spread_join


@dataclass(frozen=True)
class Settings:
    depth: int = 3
    """Leading tokens that are levels of the tree."""
    similarity: float = 0.6
    most: int = 10
    words: int = 100
    """Documents needed: ``words`` over the line's tokens, from 2 to ``most``."""
    long_line: int = 20
    share: float = 1e-6


FIELD = "<*>"


def masked(line: Column) -> Column:
    """Single spaces between tokens; tokens with a digit become FIELD.  Patterns run only on lines that need them."""
    tidy = F.trim(F.when(line.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(line, r"[\x09-\x0D\x20]+", " ")).otherwise(line))
    return F.when(tidy.rlike("[0-9]"), F.regexp_replace(tidy, "[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(tidy)


def _tokens(text: Column) -> Column:
    """How many there are in a masked line."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_key (of id and text), doc, at and the masked line, of all lines with a token."""
    key = _key(id_col, text_col)
    doc = F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.lit("no id"), key)).otherwise(F.xxhash64(F.lit("id"), F.col(f"`{id_col}`").cast("string")))
    own = docs.select(key.alias("row_key"), doc.alias("doc"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("at", "raw"))
    return own.select("row_key", "doc", "at", masked(F.col("raw")).alias("masked")).filter("masked <> ''")


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Each line's place in the tree: row_key, doc, at, its leaf, size and own hash.  Written once, as it is read often."""
    m = F.col("masked")
    leaf = F.xxhash64(_tokens(m), F.substring_index(m, " ", settings.depth))
    return materialise(_lines(docs, id_col, text_col).select("row_key", "doc", "at", leaf.alias("leaf"), _tokens(m).alias("size"), F.xxhash64(m).alias("line")), "lines")


def needed(size: Column, documents: int, settings: Settings) -> Column:
    """Documents in which a line of so many tokens has to recur."""
    by_length = F.least(F.lit(settings.most), F.greatest(F.lit(2), F.ceil(settings.words / size).cast("int")))
    return F.when(size < settings.long_line, F.greatest(by_length, F.ceil(F.lit(settings.share) * documents).cast("int"))).otherwise(by_length)


def recurring(lines: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The different lines (leaf, line) that follow a template or recur as they are."""
    enough = needed(F.col("size"), docs.count(), settings)
    held = lines.select("doc", "leaf", "size").distinct().groupBy("leaf").agg(F.min("size").alias("size"), F.count("*").alias("docs"))
    leaves = materialise(held.filter(F.col("docs") >= enough).select("leaf"), "leaves")
    # From here on only lines in leaves that enough documents have.
    own = materialise(lines.join(leaves, "leaf"), "own")
    kinds = own.select("doc", "leaf", "line", "size").distinct().groupBy("leaf", "line").agg(F.min("size").alias("size"), F.count("*").alias("n"))
    kinds = materialise(kinds.withColumn("again", F.col("n") >= enough), "kinds")
    again = kinds.filter("again").select("leaf", "line")
    unsettled = materialise(kinds.filter(~F.col("again") & (F.col("size") > settings.depth)).select("leaf").distinct(), "unsettled")
    # Documents with several different lines in a leaf: pair by pair, each counts once.  All others count as numbers of a line.
    there = own.join(unsettled, "leaf", "left_semi")
    mixed = there.groupBy("doc", "leaf").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low <> high").select("doc", "leaf")
    several = materialise(there.join(mixed, ["doc", "leaf"], "left_semi").select("doc", "line").distinct(), "several")
    shared = several.groupBy("line").agg(F.count("*").alias("shared"))
    wanted = kinds.join(unsettled, "leaf", "left_semi").join(shared, "line", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    wanted = wanted.withColumn("weight", (F.col("n") - F.col("shared")).cast("int")).withColumn("shared", F.col("shared") > 0)
    places = there.groupBy("leaf", "line").agg(F.min(F.struct("row_key", "at")).alias("place"))
    wanted = materialise(wanted.join(places, ["leaf", "line"]).select("leaf", "line", "size", "weight", "shared", "again", "place.row_key", "place.at"), "wanted")
    # One occurrence of each such line gives its text.
    # Their documents grow with the table, so the plan is the same at every size: a shuffle, never a broadcast.
    keys = wanted.select(F.col("row_key").alias("wanted_key")).distinct().hint("merge")
    source = docs.join(keys, _key(id_col, text_col) == F.col("wanted_key"), "left_semi")
    texts = _lines(source, id_col, text_col).join(wanted, ["row_key", "at"]).groupBy("leaf", "line", "size", "weight", "shared", "again").agg(F.split(F.first("masked"), " ").alias("tokens"))
    texts = materialise(texts, "tokens")
    rest = F.col("size") - settings.depth
    neighbours = F.zip_with(F.slice("tokens", F.lit(settings.depth), rest), F.slice("tokens", F.lit(settings.depth + 1), rest), lambda a, b: F.xxhash64(a, b))

    def pairs(of: DataFrame, *columns: str) -> DataFrame:
        return of.select("leaf", "size", *columns, F.posexplode(neighbours).alias("i", "pair")).withColumn("pair", F.xxhash64("leaf", "i", "pair"))

    each = pairs(texts, "line", "weight", "again")
    # A line's hash holds its leaf's tokens, so it is a key by itself.
    spoken = spread_join(several, texts.filter("shared").select("leaf", "line", "size", "tokens"), "line")
    once = pairs(spoken, "doc").select("doc", "size", "pair").distinct().select("size", "pair", F.lit(1).alias("weight"))
    counted = each.filter("weight > 0").select("size", "pair", "weight").unionByName(once).groupBy("pair").agg(F.min("size").alias("size"), F.sum("weight").alias("docs"))
    constant = counted.filter(F.col("docs") >= enough).select("pair")
    follows = each.filter(~F.col("again")).select("leaf", "line", "size", "pair").join(constant, "pair", "left_semi").groupBy("leaf", "line").agg(F.min("size").alias("size"), F.count("*").alias("fixed"))
    follows = follows.filter(F.col("fixed") >= settings.similarity * (F.col("size") - settings.depth)).select("leaf", "line")
    return materialise(again.unionByName(follows), "templates")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """row_key and the places of the lines that go, for documents that lose any."""
    lines = placed(docs, id_col, text_col, settings)
    gone = lines.join(recurring(lines, docs, id_col, text_col, settings), ["leaf", "line"], "left_semi").select("row_key", "at")
    return gone.groupBy("row_key").agg(F.collect_set("at").alias("gone"))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A struct ``row`` of the document, n_lines, n_dropped and kept_text."""
    gone = dropped_lines(docs, id_col, text_col, settings)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id_col, text_col).alias("row_key"))
    joined = packed.join(gone.hint("merge"), "row_key", "left")
    lines = F.split(F.col(f"row.`{text_col}`").cast("string"), "\n")
    # The places that stay, in order; a hash set does the work, so long texts cost no more per line.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`").cast("string")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    counted = joined.withColumn("lines", lines)
    return counted.select("row", F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
